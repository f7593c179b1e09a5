"""Decontamination, licenses and token counts."""

import random

import pytest

from pointloom.llm import decontam, licenses, tokencount
from pointloom.llm.queries import tokenizer_file

from .conftest import ODD


def words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, rng.randrange(15, 60))) + ".") for k in range(40)] + [(90, None), (91, "too short"), (92, "the same words that are everywhere in here")]
    docs = [(k, " ".join(words(rng, rng.randrange(5, 300)))) for k in range(150)]
    planted = {}
    for k in range(0, 150, 6):
        item, text = items[k % 40]
        w = text.split()
        if k % 12 == 0:  # a paraphrase: one word in eight another
            w = [x if j % 8 != 3 else f"other{j}" for j, x in enumerate(w)]
        own = docs[k][1].split()
        at = rng.randrange(len(own))
        docs[k] = (k, " ".join(own[:at] + w + own[at:]))
        planted[k] = item
    docs[148] = (148, items[3][1].upper())
    planted[148] = 3
    return items, docs, planted


def test_planted_items_are_found_and_clean_documents_left_alone(spark, make, corpus):
    items, docs, planted = corpus
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(make(docs), bench).collect()}
    assert got == set(planted.items())
    kept = {r["doc_id"] for r in decontam.drop_contaminated(make(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - set(planted)


def test_an_item_in_a_third_of_the_rows_and_a_table_of_one_document(spark, make):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, 35)) + ".") for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rare = [w for _, t in items[1:] for w in t.split()]
    docs, hot = [], set()
    for k in range(240):
        own = [rng.choice(rare) if rng.random() < 0.4 else w for w in words(rng, rng.choice([25, 65, 165, 265]))]
        if k % 3 == 0:
            at = rng.randrange(len(own))
            own[at:at] = items[0][1].split()
            hot.add((k, 0))
        docs.append((k, " ".join(own)))
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(make(docs), bench).collect()} == hot
    for n in (1, 3, 6):
        few = [(k, " ".join([*words(rng, 50), items[k][1], *words(rng, 50)])) for k in range(n)]
        assert {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(make(few), bench).collect()} == {(k, k) for k in range(n)}


def test_recall_against_the_longest_common_subsequence_of_all_pairs(spark, make, monkeypatch):
    """160 items of 8 to 90 words, over 200 passages in 128 dimensions; verbatim, and with 0 to 27 percent other words."""
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in "aeiou" for c in "lmnrstx"]  # 490, shared by both sides
    pick = lambda n: [words[min(int(rng.expovariate(1 / 90)), len(words) - 1)] for _ in range(n)]
    items = [(k, " ".join(pick(rng.randrange(8, 90))) + ".") for k in range(160)]
    docs = []
    for k in range(160):
        w = items[k][1].split()
        w = [x if rng.random() > k % 10 * 0.03 else rng.choice(words) for x in w]
        own = pick(rng.randrange(0, 250))
        at = rng.randrange(len(own) + 1)
        docs.append((k, " ".join([*own[:at], *w, *own[at:]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(make(docs), bench).collect()}
    (shards,) = decontam._shards(make(docs).select("text"), bench)
    assert [len(x.rows) > x.latent.shape[1] == decontam.RANK for x in shards] == [True]
    for name, value in (("COVERED", -1e9), ("COSINE", -2.0)):  # no search: every passage against every window
        monkeypatch.setattr(decontam, name, value)
    want = {(k, item) for k, own in enumerate(decontam._hits_of(shards, [t for _, t in docs])) for item in own}
    assert len(want) >= 100 and got <= want and len(got) >= 0.95 * len(want)


def test_long_items_fill_several_shards(spark, make, monkeypatch):
    monkeypatch.setattr(decontam, "PASSAGES", 16)
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, 200)) + ".") for k in range(12)] + [(12, " ".join(words(rng, 700)) + ".")]  # 8 and 29 passages
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, planted = [(k, " ".join(words(rng, 200))) for k in range(30)], set()
    for k in range(13):
        own = docs[k][1].split()
        w = [x if k % 2 or j % 8 != 3 else f"other{j}" for j, x in enumerate(items[k][1].split())]
        docs[k] = (k, " ".join([*own[:77], *w, *own[77:]]))
        planted.add((k, k))
    docs.append(docs[12])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_contamination(make(docs), bench).collect())
    assert got == sorted([*planted, (12, 12)])
    whole = decontam._index(items)
    cut = [index for index, _ in decontam._cut(whole)]
    assert len(cut) > 5 and all(len(x.rows) <= 16 for x in cut) and sum(len(x.rows) for x in cut) == len(whole.rows)


def test_shards_find_the_same(spark, make, corpus, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 12)
    items, docs, planted = corpus
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(make(docs), bench).collect()} == set(planted.items())


def test_decontamination_of_odd_rows(spark, odd, make, corpus):
    bench = spark.createDataFrame(corpus[0], "item_id long, text string")
    assert decontam.find_contamination(odd, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench).count() == len(ODD)
    assert decontam.find_contamination(make([]), bench).count() == 0
    assert decontam.find_contamination(odd, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)


def test_longest_common_subsequence():
    import numpy as np

    rng = random.Random(0)
    for _ in range(100):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 40))], [rng.randrange(6) for _ in range(rng.randrange(0, 40))]
        row = [0] * (len(b) + 1)
        for x in a:
            last = list(row)
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        assert decontam._common(np.array(a, np.uint64), np.array(b, np.uint64)) == row[-1]


def test_licenses_against_all_windows(make):
    rng = random.Random(1)
    notices = [(n, t) for n in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[n]]
    rows, want = [], set()
    for k in range(120):
        before, after = words(rng, rng.randrange(200)), words(rng, rng.randrange(200))
        name, text = notices[k % len(notices)]
        w = text.split()
        if k % 3 == 0:
            rows.append((k, " ".join(before + after)))
            continue
        if k % 3 == 1 and len(w) > 30:
            w[len(w) // 2] = "changed"  # costs five shingles
        rows.append((k, " ".join(before + ["\n".join([" ".join(w[:3]).upper(), " ".join(w[3:])])] + after)))
        want.add((k, name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(make(rows)).collect()}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_license_scan_of_odd_rows(odd, make):
    assert licenses.scan_licenses(odd).count() == 0
    assert licenses.scan_licenses(make([])).count() == 0
    assert licenses.scan_licenses(odd, {"none": ["short"]}).count() == 0
    assert [tuple(r) for r in licenses.scan_licenses(make([(1, "Released under the MIT License.")])).collect()] == [(1, "MIT", 1.0)]


TEXTS = ["", None, "a", " a", "  a  b ", "\n\n", "日本語🎉 x", "<s> </s><0x41>", " ▁▁ x", "x\n y", "\t\tq", "é́", "the quick brown fox " * 30, "   " * 40, "antidisestablishmentarianism\x00"]


def test_counts_equal_the_tokenizer(make):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_file("piece_bpe_32k.model")
    pieces = tokencount.pieces_of(path)
    whole = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeghilmnorstu éñ日 \n") for _ in range(rng.randrange(200))) for _ in range(100)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(make(list(enumerate(texts))), path).collect()}
    for k, t in enumerate(texts):
        assert got[k] == len(whole.encode(t or "", add_special_tokens=False).ids), repr(t)


def test_ties_go_to_the_longer_first_piece():
    c = tokencount.UnigramCounter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -1.0), ("▁", -1.0)])
    assert c.segment("ab") == (1, -2.0)  # one piece of -2 before two of -1
    assert c.segment("abc") == (2, -2.0)
    assert c.segment("x日") == (4, 2 * c.unknown)


def test_counts_of_odd_rows(odd, make):
    path = tokenizer_file("piece_bpe_32k.model")
    got = tokencount.count_tokens(odd, path).collect()
    assert len(got) == len(ODD) and sum(r["n_tokens"] == 0 for r in got) == 2
    assert tokencount.count_tokens(make([]), path).count() == 0


def test_licenses_equal_brute_force(spark, make, monkeypatch):
    """Templates with 0 to 40 percent other words: found where a window as long as the template holds 0.8 of its shingles,
    and nowhere that the whole document does not."""
    rng = random.Random(31)
    table = spark.createDataFrame([(f"L{k}", " ".join(words(rng, rng.choice([6, 20, 90, 400])))) for k in range(12)] + [("none", None)], "license string, text string")
    known = licenses.templates_of(table)
    docs = []
    for k in range(120):
        own = words(rng, rng.randrange(0, 300))
        t = known[f"L{k % 12}"][0].split()
        t = [w if rng.random() > k % 5 * 0.02 else f"zz{rng.randrange(999)}" for w in t]
        docs.append((k, " ".join(own + t + words(rng, 30))))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(make(docs), known).collect()}
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    least, most = set(), set()
    for d, text in docs:
        g = grams(text.split())
        for name, (t,) in known.items():
            whole = set(grams(t.split()))
            if len(whole & set(g)) >= 0.8 * len(whole):
                most.add((d, name))
                if max(len(whole & set(g[i : i + len(whole)])) for i in range(len(g))) >= 0.8 * len(whole):
                    least.add((d, name))
    assert len(least) >= 60 and least <= got <= most
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 100)
    with pytest.raises(ValueError):
        licenses.templates_of(table)
