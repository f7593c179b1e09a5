"""A text longer than a kernel's block, with what is looked for at its very end, through all ten operators."""

import hashlib
import random

import pytest

from pointloom.llm import _spark, decontam, fingerprint, langid, licenses, lm, neardup, packing, pii, suffix, tokencount
from pointloom.llm.queries import tokenizer_file

from .test_models import WORDS


@pytest.fixture(scope="module")
def long(make):
    rng = random.Random(12)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{k}" for k in range(4000)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, passage = pick(40), pick(120)
    notice = licenses.TEMPLATES["MIT"][2]
    text = " ".join([pick(170_000), item, notice, "mail a.b@c.org", passage])
    assert len(text) > 1.1 * _spark.BLOCK_BYTES
    rows = [(1, text), (2, pick(50) + " " + passage), (3, pick(60)), (4, text + " more")]
    return make(rows), rows, item, passage


def test_spans_and_searches(spark, long):
    docs, rows, item, _ = long
    got = {r["doc_id"]: r for r in pii.extract_pii(docs).collect()}
    at = rows[0][1].index("a.b@c.org")
    assert got[1]["spans"] == got[4]["spans"] == f"email:{at}:{at + 9}" and got[2]["n_found"] == got[3]["n_found"] == 0
    bench = spark.createDataFrame([(7, item), (8, "words that are nowhere in these texts at all")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(docs, bench).collect()} == {(1, 7), (4, 7)}
    assert {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()} == {(1, "MIT"), (4, "MIT")}


def test_repeats_and_copies(long):
    docs, rows, _, passage = long
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs).collect()}
    assert got[1]["n_removed"] == len(rows[0][1]) and got[3]["n_removed"] == 0
    assert len(passage) + 1 >= got[2]["n_removed"] >= len(passage) and got[2]["n_spans"] == 1
    near = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert [near[k]["component_id"] for k in (1, 2, 3, 4)] == [1, 2, 3, 1]
    w = rows[0][1].split()
    assert near[1]["n_shingles"] == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})


def test_tokens_and_scores(long):
    from tokenizers import Tokenizer

    docs, rows, *_ = long
    scored = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert all(scored[d]["n_tokens"] == len(t.split()) + 1 and scored[d]["score"] < 0 for d, t in rows)
    path = tokenizer_file("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    packed = packing.pack_documents(docs, path).toPandas().groupby("doc_id").length.sum()
    assert all(packed[d] == len(whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows)
    counted = {r["doc_id"]: r for r in tokencount.count_tokens(docs, tokenizer_file("piece_bpe_32k.model")).collect()}
    assert counted[1]["n_tokens"] < counted[4]["n_tokens"] < counted[1]["n_tokens"] + 10


def test_fingerprints_and_languages(make, long):
    docs, rows, *_ = long
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    t, third = rows[3][1], len(rows[3][1]) // 3
    assert got[4]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + rows[2][1][:third]).encode()).hexdigest()
    rng = random.Random(1)
    prose = [(k, " ".join(rng.choice(WORDS[x]) for _ in range(30)), x) for k, x in enumerate(["en", "de"] * 40)]
    prose.append((500, " ".join(rng.choice(WORDS["de"]) for _ in range(300_000)), None))
    assert {r["lang_pred"] for r in langid.identify_languages(make(prose)).collect() if r["doc_id"] == 500} == {"de"}
