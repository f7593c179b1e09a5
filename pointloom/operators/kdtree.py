"""Per-node neighbour trees of the exchange form: a balanced k-d tree as an array of entries, left before right.

An entry is 25 bytes: position (float32), the point's number in its node, the axis that splits there, and the entries of
both children (-1: none). Entry k's left child is entry k + 1, so a tree follows from the order alone.
"""

from __future__ import annotations

import struct

import numpy as np

#: The entry's fields.
ENTRY = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("point", "<u4"), ("axis", "u1"), ("left", "<i4"), ("right", "<i4")])
_HEAD = struct.Struct("<Ii")


def build(xyz: np.ndarray) -> np.ndarray:
    """Entries of a tree whose subtree of n points splits at its point n // 2 by the axis of its depth, modulo three."""
    out = np.zeros(len(xyz), ENTRY)
    xyz = np.asarray(xyz, np.float32)
    todo = [(np.arange(len(xyz)), 0, 0)] if len(xyz) else []
    while todo:
        own, at, depth = todo.pop()
        half, axis = len(own) // 2, depth % 3
        own = own[np.argpartition(xyz[own, axis], half)]
        right = at + 1 + half
        out[at] = (*xyz[own[half]], own[half], axis, at + 1 if half else -1, right if half + 1 < len(own) else -1)
        if half:
            todo.append((own[:half], at + 1, depth + 1))
        if half + 1 < len(own):
            todo.append((own[half + 1 :], right, depth + 1))
    return out


def pack(entries: np.ndarray) -> bytes:
    return _HEAD.pack(len(entries), 0 if len(entries) else -1) + entries.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """Entries with the root first; an empty array for less than a head."""
    if len(data) < _HEAD.size:
        return np.zeros(0, ENTRY)
    n, root = _HEAD.unpack_from(data)
    if len(data) < _HEAD.size + n * ENTRY.itemsize:
        raise ValueError("the neighbour tree ends before its last entry")
    if n and root != 0:
        raise ValueError("the root of a neighbour tree is its first entry")
    return np.frombuffer(data, ENTRY, n, _HEAD.size)


def within(entries: np.ndarray, at: tuple[float, float, float], radius: float) -> np.ndarray:
    """Numbers of the points at most `radius` away, sorted; none for a radius of 0 or less."""
    found: list[np.ndarray] = []
    live = np.zeros(1 if len(entries) and radius > 0 else 0, np.int64)
    q = np.asarray(at, np.float32)
    while len(live):  # a level of the tree at a time
        e = entries[live]
        p = np.stack([e["x"], e["y"], e["z"]], axis=1)
        found.append(e["point"][((p - q) ** 2).sum(axis=1) <= np.float32(radius) ** 2])
        gap = q[e["axis"]] - p[np.arange(len(e)), e["axis"]]
        both = np.abs(gap) <= radius
        live = np.concatenate((e["left"][both | (gap <= 0)], e["right"][both | (gap > 0)]))
        live = live[live >= 0]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint32)
