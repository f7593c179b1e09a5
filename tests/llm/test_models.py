"""Language identification, the language model, and fingerprints."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import fingerprint, langid, lm

from .conftest import ODD

WORDS = {
    "en": "the of and to in is that it for was with this are have from which they".split(),
    "de": "der die und das ist nicht mit auf eine für sich auch werden über schön".split(),
    "fr": "les des est dans une pour que qui avec sur plus été être même très".split(),
    "es": "los las que una para con por más como pero sus también año señor está".split(),
}


def prose(n, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(8, 60))), lang))
    return out


def held(k, m):
    return zlib.crc32(str(k).encode()) % m == 0


def test_held_out_accuracy(make):
    rows = prose(400)
    got = {r["doc_id"]: r for r in langid.identify_languages(make(rows)).collect()}
    out = [k for k, _, _ in rows if held(k, 5)]
    assert all(got[k]["held_out"] == held(k, 5) for k, _, _ in rows)
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in out]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_documents_are_not_learned_from(make):
    rows = prose(200)
    other = [(k, t, "xx" if held(k, 5) else lang) for k, t, lang in rows]
    both = [sorted(tuple(r) for r in langid.identify_languages(make(x)).collect()) for x in (rows, other)]
    assert both[0] == both[1]


def test_languages_of_odd_rows(odd, make):
    got = langid.identify_languages(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == "en"
    assert langid.identify_languages(make([])).count() == 0
    none = langid.identify_languages(make([(1, "text", None), (2, "more", None)])).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def base_scores(rows):
    counts, docs = Counter(), {}
    for k, (d, t) in enumerate(rows):
        docs[k] = (t or "").encode().lower().split() + [None]
        if d is not None and not held(d, 10):
            counts.update(docs[k])
    n, v = sum(counts.values()), len(counts)
    return n, sorted(((rows[k][0], len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for k, w in docs.items()), key=str)


@pytest.mark.parametrize("head", [1 << 18, 5])
def test_base_scores(make, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "VOCABULARY", 5)
    rows = [(k, t) for k, t, _ in prose(60)] + ODD
    n, want = base_scores(rows)
    got = lm.score_documents(make(rows)).collect()
    assert {r["train_tokens"] for r in got} == {n}
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=str)
    for a, b in zip(mine, want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    assert all(r["score"] < 0 for r in got)


def test_no_training_documents(make):
    assert lm.score_documents(make([])).count() == 0
    k = next(k for k in range(100) if held(k, 10))
    r = lm.score_documents(make([(k, "a b")])).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) == (0, 0, 3, pytest.approx(0.0))


def test_output_is_a_distribution_and_gradients_are_right():
    rng = np.random.default_rng(0)
    share = rng.random(150)
    m = lm.Gru(share / share.sum())
    h = rng.normal(0, 1, (3, lm.STATE)).astype(np.float32)
    total = np.zeros(3)
    for t in range(150):
        total += np.exp(m.log_probabilities(h, np.full(3, t)))
    assert total == pytest.approx(np.ones(3), abs=1e-3)

    ids = rng.integers(0, 150, (5, 4)).astype(np.int64)
    into, reset, valid = np.roll(ids, 1, axis=0), np.zeros((5, 4), bool), np.ones((5, 4), bool)
    reset[0] = True
    reset[3, 1] = True
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}

    def loss():
        state, out = np.zeros((lm.STATE, 4)), 0.0
        for t in range(5):
            state = m.step(state * ~reset[t], m.gates(into[t]))[0]
            out -= m.log_probabilities(state.T, ids[t]).sum()
        return out / valid.sum()

    grads = {}
    trainer = lm._Trainer(m)
    trainer._apply = lambda name, where, grad: grads.setdefault(name, []).append((where, grad))
    trainer.window(np.zeros((lm.STATE, 4)), into, ids, reset, valid)
    for name in m.w:
        whole = np.zeros_like(m.w[name])
        for where, g in grads[name]:
            whole[where] += g
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in whole.shape) if name != "input" else (int(rng.choice(into.ravel())), int(rng.integers(0, lm.STATE)))
            if name == "word_bias" and m.w[name][at] < -1e3:
                continue
            kept = m.w[name][at]
            m.w[name][at] = kept + 1e-4
            up = loss()
            m.w[name][at] = kept - 1e-4
            down = loss()
            m.w[name][at] = kept
            assert (up - down) / 2e-4 == pytest.approx(whole[at], abs=2e-4)


def test_state_is_carried_through_whole_documents():
    rng = np.random.default_rng(1)
    vocabulary = lm.Vocabulary(np.arange(10, 20, dtype=np.uint64), np.arange(10, 0, -1), 3)
    m = lm.Gru(np.full(12, 1 / 12))
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in (200, 3, 0, 77, 150)]
    together, *_ = lm._score_block(texts, vocabulary, m)
    alone = [lm._score_block([t], vocabulary, m)[0][0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)


def test_network_learns_an_order(make, monkeypatch):
    rows = [(k, " ".join("a b c d e f g h".split() * 20)) for k in range(300)]
    got = lm.score_documents(make(rows)).toPandas()
    out = got[got.held_out]
    assert len(out) and out.score.sum() > 0.9 * out.base_score.sum()


def test_network_learns_from_every_training_document(make, monkeypatch):
    seen = []
    train = lm._train
    monkeypatch.setattr(lm, "_train", lambda training, *rest: (seen.extend(r["doc_id"] for r in training.collect()), train(training, *rest)))
    lm.score_documents(make([(k, "a b c d e f g h") for k in range(200)])).count()
    assert sorted(seen) == [k for k in range(200) if not held(k, 10)]


def test_rounds_share_out_the_documents_and_weights_are_averaged_in_a_tree(make, monkeypatch):
    rows = [(k, f"a b c d e f g{k}") for k in range(200)]
    plain = sorted((r["doc_id"], r["score"]) for r in lm.score_documents(make(rows)).collect())
    monkeypatch.setattr(lm, "FAN", 2)
    assert sorted((r["doc_id"], pytest.approx(r["score"], rel=1e-5)) for r in lm.score_documents(make(rows)).collect()) == plain


def test_words_that_all_occur_once_still_give_a_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 1000)
    counts = spark.range(3000).selectExpr("xxhash64(id) as word", "1L as n").union(spark.range(5).selectExpr("id as word", "9L as n"))
    words, n = lm._head(counts)
    assert 900 < len(words) <= 1000 and n[:6].tolist() == [9] * 5 + [1]


def test_edits_neighbours_and_likeness(make):
    rng = random.Random(4)
    rows = [(k * 37 % 1009, " ".join(f"é{rng.randrange(300)}" for _ in range(rng.randrange(0, 200)))) for k in range(300)]
    rows += [(2000, rows[0][1]), (2001, None), (2002, "")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(make(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    errors = []
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = Counter(t.split()), Counter(edited.split())
        union = sum((a | b).values())
        errors.append(r["near_edited"] - (sum((a & b).values()) / union if union else 1.0))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    assert got[2000]["fingerprint"] == got[rows[0][0]]["fingerprint"]
    assert got[2001]["fingerprint"] == got[2002]["fingerprint"] == ""


def test_fingerprints_of_odd_rows(odd, make):
    got = fingerprint.fingerprint_documents(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.fingerprint_documents(make([])).count() == 0
    one = fingerprint.fingerprint_documents(make([(5, "abcdef")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    nulls = fingerprint.fingerprint_documents(make([(None, "a"), (None, "b")])).collect()
    assert len(nulls) == 2


def test_documents_without_id_follow_by_their_hashes(spark, make, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 4)
    monkeypatch.setattr(fingerprint, "SPAN", 3)
    rows = [(k if k % 3 else None, f"t{k} " * (k % 7 + 1)) for k in range(90)]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in fingerprint.fingerprint_documents(make(rows)).collect()) == want
