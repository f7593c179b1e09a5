"""Vectorised text kernels: words `[^\\x20\\x09-\\x0D]+` of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240229)
_STEP = (_RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)).astype(np.uint64)
#: Of the eight bytes read at a place, those that belong to a word with so many bytes left.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Longer words, in bytes, are hashed one at a time.
_LONG = 128


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look independent."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def joined(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts with a line end after each, and where each text starts (one more entry for the end)."""
    parts = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8), starts


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings data[begin:end], eight bytes at a time; equal strings of whatever places have equal ones.

    Each step goes through mix(), which is not linear, so that texts with a regular structure collide no more than others.
    """
    size = end - begin
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    h = mix((eights[begin] & _OWN[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _STEP[40]))
    at = 8
    more = np.flatnonzero((size > at) & (size <= _LONG))
    while len(more):
        h[more] = mix(h[more] * _STEP[41] + (eights[begin[more] + at] & _OWN[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]], digest_size=8).digest(), "little")
    return h


def words(texts: list[str | bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash of each word, number of words before each text (one more entry), the bytes, each word's start and end in them."""
    data, starts = joined(texts)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate((np.zeros(1, edge.dtype), edge))
    begin, end = edge[0::2], edge[1::2]  # the bytes end with a space, so edges come in pairs
    h = hashes(_LOWER[data] if lower else data, begin, end)
    first = np.searchsorted(begin, starts)
    return h, first, data, begin, end


def many_words(texts: list[str | None], size: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """words() of many texts, hashed about `size` characters at a time: hash of each word, number before each text."""
    parts, firsts, base, at = [], [np.zeros(1, np.int64)], 0, 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to] or "") <= size):
            total += len(texts[to] or "")
            to += 1
        h, first, *_ = words(texts[at:to])
        parts.append(h)
        firsts.append(first[1:] + base)
        base, at = base + len(h), to
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(firsts)


def shingles(h: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word shingles by text (with repeats), and the number before each text.

    A text with fewer words, but one at least, has one shingle: the whole sequence.
    """
    count = np.diff(first)
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    long = count >= size
    n = np.where(long, count - size + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(n, out=at[1:])
    padded = np.concatenate((h, np.zeros(size, np.uint64)))
    every = np.zeros(len(h), dtype=np.uint64)
    for k in range(size):
        every += padded[k : k + len(h)] * _STEP[k]
    keep = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    out = mix(every[keep])
    for i in np.flatnonzero(~long & (count > 0)):
        own = h[first[i] : first[i + 1]]
        short = np.uint64(0)
        for k, x in enumerate(own):
            short = short + x * _STEP[8 + k]
        out[at[i]] = mix(np.array([short + _STEP[20 + len(own)]]))[0]
    return out, at


def unique_by_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and the number before each."""
    if len(values) == 0:
        return values, np.zeros(len(at), np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, owner)) if len(at) > 2 else np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.empty(len(values), dtype=bool)
    new[0] = True
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(len(at), dtype=np.int64)
    np.cumsum(np.bincount(owner[new], minlength=len(at) - 1), out=out[1:])
    return values[new], out
