"""The pipeline's stages against what brute force says about their input."""

import math
import random

import pytest

import corpus_pipeline
from pointloom.llm import neardup

from .conftest import ODD
from .test_models import prose
from .test_neardup import brute


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    rows = prose(60, seed=9)
    rng = random.Random(0)
    item = " ".join(f"bench{rng.randrange(10**6)}" for _ in range(30))
    rows += [(200, rows[0][1] + " one two three four five six"), (201, rows[0][1] + " one two three four five six"), (202, rows[1][1] + " " + item), (203, "write to a.b@c.org please"), (204, "??? 123"), (205, None)]
    make(rows + [(300 + k, t) for k, (_, t) in enumerate(ODD)]).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in after} == {d for d, t in before.items() if t and any(map(str.isalpha, t))}
    before, after = seen["near_dedup"]
    want, _ = brute(list(before.items()))
    assert sorted(r["doc_id"] for r in after) == sorted(d for d in before if want[d] == d)
    before, after = seen["decontamination"]
    assert set(before) - {r["doc_id"] for r in after} == {202}
    before, after = seen["pii"]
    assert {r["doc_id"] for r in after if r["text"] != before[r["doc_id"]]} == {203}
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == set(before)


def test_run_equals_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert not {201, 202, 204, 205} & set(got.doc_id)


def test_repeated_rows_and_rows_without_id(spark, make, folder):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "x y z")]
    got = corpus_pipeline.drop_near_duplicates(spark, make(rows), folder).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, make([]), folder).count() == 0
    assert neardup.near_duplicates(make(rows)).count() == 4


def test_near_copies_from_four_fifths_on_are_dropped(spark, make, folder):
    rng = random.Random(12)
    rows = []
    for k in range(20):
        w = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        edited = list(w)
        for at in (20, 70, 120, 170):  # 20 of 196 shingles change: 176 of 216 in common
            edited[at] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(edited))]
    got = corpus_pipeline.drop_near_duplicates(spark, make(rows), folder).collect()
    want, _ = brute(rows, 80)
    assert sorted(r["doc_id"] for r in got) == sorted(d for d in want if want[d] == d) == list(range(0, 40, 2))


@pytest.mark.parametrize("plan, least", [(neardup.USUAL, 0.85), (neardup.WIDE, 0.8)])
def test_a_link_at_the_threshold_is_hardly_missed(plan, least):
    n, p = plan.symbols, 1 - least
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(plan.distance + 1, n + 1)) < 1e-5
    assert plan.distance // plan.chunks == 1
