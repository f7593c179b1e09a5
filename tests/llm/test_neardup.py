import random

import numpy as np
import pytest

from pointloom.llm import neardup
from pointloom.llm.components import connected_components
from pointloom.llm._spark import Scratch

from .conftest import ODD


def brute(rows, similarity=85):
    sets = {}
    for d, t in rows:
        if d is None:
            continue
        w = (t or "").encode().lower().split()
        sets.setdefault(d, set()).update([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= similarity * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: top(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def near_copies(n, words=140, edits=6, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_equals_brute_force_on_a_family_of_near_copies(make, monkeypatch, block_rows):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block_rows)
    rng = random.Random(7)
    texts = near_copies(120) + near_copies(40, seed=2, edits=9) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += texts[:30] + [t.upper() for t in texts[:5]]
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(make(rows)).toPandas()
    want, sizes = brute(rows)
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want
    assert dict(zip(got.doc_id, got.n_shingles, strict=True)) == sizes
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_odd_rows(odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    want, _ = brute([r for r in ODD if r[0] is not None])
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_empty_table_and_clashing_columns(spark, make):
    assert neardup.near_duplicates(make([])).count() == 0
    d = make([(1, "a b c d e f"), (2, "a b c d e f")]).selectExpr("*", "1 as n_shingles", "2 as key", "3 as u", "4 as component_id")
    assert neardup.near_duplicates(d).where("kept").count() == 1
    with pytest.raises(ValueError):
        neardup.near_duplicates(d, similarity=50)


def test_words_of_a_regular_structure_are_different_words(make):
    """A word of 1,024 letters by the parity of their number's bits, and the same with both letters exchanged."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    got = neardup.near_duplicates(make([(1, a), (2, b), (3, f"x y z {a} {b}"), (4, f"x y z {b} {a}")])).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 256, neardup.SYMBOLS)
        b = a.copy()
        where = rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False)
        b[where] = (b[where] + 1) % 256
        errors = np.add.reduceat((a != b).astype(int), neardup._EDGES[:-1])
        assert errors.min() <= 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert all(got.get(x, x) == top(x) for x in up)
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0
