import zlib

import numpy as np
import pytest

from pointloom.llm import packing
from pointloom.llm.queries import tokenizer_file

from .conftest import ODD

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return tokenizer_file("word_bpe_49k.json")


TRICKY = ["l'été d'ÉTÉ ª²³ ½x1½ don'TS'S 'LL ß÷×Ø µ!!a", "a\x1cb c", "x\x85y", "Foo<|endoftext|>bar baz", "é ́x", "İstanbul ΣΑΣ", "", None, "I'm 's 'll", "\xa0 a　b​c﻿ d", "<|startoftext|> x", "日本語 テスト 🎉🎉"]


def test_ids_equal_the_tokenizer(path):
    t = tokenizers.Tokenizer.from_file(path)
    c = packing.ChunkTokenizer(path)
    for texts in (TRICKY, TRICKY[::-1], [x for _, x in ODD]):
        ids, at = c.encode(texts)
        for k, text in enumerate(texts):
            assert t.encode(text or "", add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist()


def test_caches_may_overflow(path, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    monkeypatch.setattr(packing, "CORE", 7)
    t, c = tokenizers.Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    for k in range(8):
        texts = [f"some{j} words, {k * j} and.more w{j % 5}" for j in range(20)]
        ids, at = c.encode(texts)
        assert all(t.encode(x, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist() for i, x in enumerate(texts))


def test_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, packing.CAPACITY + 1, 500)
    own = packing.best_fit(lengths)
    fill = np.bincount(own, weights=lengths)
    assert fill.max() <= packing.CAPACITY and (fill > 0).all()
    small = rng.integers(1, 40, 3000)
    assert packing.best_fit(small).max() + 1 == -(-int(small.sum()) // packing.CAPACITY)


@pytest.mark.parametrize("task_items", [200_000, 7])
def test_every_piece_is_packed_once(make, path, monkeypatch, task_items):
    monkeypatch.setattr(packing, "TASK_ITEMS", task_items)
    rows = [(k, f"alpha beta {k} " * (k * 7 % 400 + 1)) for k in range(60)] + [r for r in ODD]
    got = packing.pack_documents(make(rows), path).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    t = tokenizers.Tokenizer.from_file(path)
    want = []
    for d, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    mine = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(mine, key=str) == sorted(want, key=str)
    if task_items > 100:
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_empty_table(make, path):
    assert packing.pack_documents(make([]), path).count() == 0


def test_files_with_another_pre_tokenizer_are_encoded_directly():
    from tokenizers import Tokenizer

    texts = ["It's  two\nlines, 12 naïve <|endoftext|> words", "", "日本 a\x85b", " x" * 300]
    for name, by_chunks in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = tokenizer_file(name)
        own = packing.ChunkTokenizer(path)
        assert own.by_chunks == by_chunks
        ids, at = own.encode([*texts, None])
        whole = Tokenizer.from_file(path)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
        assert at[-1] == at[-2]
