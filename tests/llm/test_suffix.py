import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from pointloom.llm import _text, suffix

from .conftest import ODD


def chosen(b):
    """Grams of 26 words, the smallest by hash of each 26 in a row, found one passage of 51 words at a time."""
    h = _text.words([b], lower=False)[0]
    grams = _text.shingles(h, np.array([0, len(h)]), 26)[0].tolist()
    out = set()
    for k in range(len(h) - 50):
        out.add(min(enumerate(grams[k : k + 26]), key=lambda x: (x[1] >> 32, x[0]))[1])
    return out


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    holders = defaultdict(set)
    for d, b in set(texts):
        for g in chosen(b):
            holders[g].add((d, b))
    copies = Counter(texts)
    seen = Counter(b[k : k + 400] for _, b in texts for k in range(len(b) - 399))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        shared = copies[d, b] * sum(len(holders[g]) > 1 for g in chosen(b))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), shared))
    return sorted(out, key=str)


def passages(seed=1):
    rng = random.Random(seed)
    letters = "abcdefghij klé"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    p, q = text(700), text(450)
    rows = [(k, text(rng.randrange(900)) + p[rng.randrange(50) :] + text(rng.randrange(300)) + (q if k % 3 else "") + text(20)) for k in range(40)]
    rows += [(100, p), (101, "ab" * 900), (102, "ab" * 350), (103, text(399)), (104, rows[0][1]), (105, rows[0][1][:600]), (106, "x" * 400), (107, "x" * 401)]
    return rows


@pytest.mark.parametrize("group", [2000, 5, 1])
def test_equals_brute_force(make, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = passages()
    got = sorted((tuple(r) for r in suffix.remove_repeats(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows_and_empty_table(odd, make):
    assert sorted((tuple(r) for r in suffix.remove_repeats(odd).collect()), key=str) == brute([r for r in ODD])
    assert suffix.remove_repeats(make([])).count() == 0


def test_repeated_long_rows(make):
    rows = [(1, "abc " * 200), (1, "abc " * 200), (None, "xyz1" * 150), (None, "xyz1" * 150)]
    got = suffix.remove_repeats(make(rows)).collect()
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in got)


def test_passages_of_over_50_words_in_two_documents_are_told(make):
    """Also those under 400 bytes, which stay."""
    rng = random.Random(2)
    words = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(n)]
    passage = words(51)
    assert len(" ".join(passage)) < 400
    rows = [(k, " ".join(words(150) + (passage if k in (3, 8) else []) + words(90))) for k in range(12)] + [(20, " ".join(passage[:25] + words(80)))]
    got = {r["doc_id"]: (r["n_removed"], r["n_shared"] > 0) for r in suffix.remove_repeats(make(rows)).collect()}
    assert got == {k: (0, k in (3, 8)) for k, _ in rows}


def test_multikey_quicksort_and_prefix_nodes():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(40))) for _ in range(300)] + [b"ab" * 17, b"ab" * 17, b""]
    group = np.sort(np.array([rng.randrange(4) for _ in parts]))
    order, common = suffix.sort_strings(group, parts, 40)
    want = sorted(range(len(parts)), key=lambda k: (group[k], parts[k]))
    assert [parts[k] for k in order] == [parts[k] for k in want]

    def shared(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    assert common[1:].tolist() == [shared(parts[a], parts[b]) if group[a] == group[b] else 0 for a, b in zip(order, order[1:], strict=False)]
    nodes = set(zip(*(x.tolist() for x in suffix.prefix_nodes(common, 2)), strict=True))
    brute_nodes = set()
    for k in range(1, len(parts)):
        if (c := int(common[k])) >= 2:
            lo, hi = k - 1, k
            while common[lo] >= c:
                lo -= 1
            while hi + 1 < len(parts) and common[hi + 1] >= c:
                hi += 1
            brute_nodes.add((lo, hi, c))
    assert nodes == brute_nodes


def nested(n, seed=5):
    """Surroundings of one gram whose nodes lie within each other at all depths."""
    rng = random.Random(seed)
    same = rng.randbytes(700)
    out = []
    for k in range(n):
        own = rng.randbytes(700)
        right = 400 if k >= 600 else 100 + k // 2
        out.append(own[: 300 - k % 300] + same[300 - k % 300 : 300 + right] + own[300 + right :])
    return np.zeros(n, np.int64), np.full(n, 300, np.int64), out


def test_memory_of_a_group_of_nested_nodes_is_bounded():
    """A group of GROUP rows: 270 MB when all pairs of a node and a row were held at once."""
    group = nested(suffix.GROUP)
    tracemalloc.start()
    begin, end = suffix.compare_groups(*group)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    assert (end[600:] == 700).all()  # these share all 400 bytes to the right


@pytest.mark.parametrize("pairs", [1, 50])
def test_pairs_in_parts_give_the_same(monkeypatch, pairs):
    group = nested(900)
    whole = [x.tolist() for x in suffix.compare_groups(*group)]
    monkeypatch.setattr(suffix, "_PAIRS", pairs)
    assert [x.tolist() for x in suffix.compare_groups(*group)] == whole
