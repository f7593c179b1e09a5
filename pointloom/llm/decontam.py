"""Benchmark decontamination by latent semantic retrieval.

The space is a randomised SVD of TF-IDF passages: those of the benchmark and a bounded sample of the documents', at equal
weight, with word frequencies over all documents. Its products are summed over Spark's partitions of passages, and its
rank is RANK, below their number. Benchmark passages are the index side; the passages of whole documents (72 words, every
24 words) are folded into the space and searched by cosine, and by how much of the benchmark passage they hold there. What
the search brings up is checked on words: the longest common subsequence of benchmark item and the document's region, and
whether the item's answer (its last sentence) is there too, which lets a paraphrase through to a lower share.

One scan of the documents gives the frequencies and the sample, and a second one searches. Benchmarks of more than ITEMS
items are taken in parts of that size, each with two scans, so that what the driver and a task hold is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _text
from ._spark import Scratch, blocks

BLOCK, WINDOW_BLOCKS, ITEM_WINDOW = 24, 3, 48
#: Items that the driver holds at once (about three quarters of it), passages of one index, dimensions of its space, and
#: document passages that the space is fitted on, of which a task offers OFFERED.
ITEMS, PASSAGES, RANK, POWER_ROUNDS, SAMPLE, OFFERED = 2048, 8192, 128, 2, 4096, 64
#: Cosine that makes a window a candidate where it holds COVERED of a passage; HELD of it is enough for any window.
COSINE, COVERED, HELD = 0.35, 0.3, 0.5
SAME, PARAPHRASE, ANSWER, LEAST_WORDS = 0.8, 0.6, 0.8, 5
_FILTER_BITS = 20


@dataclass
class Index:
    """One shard: passages of items, sorted vocabulary hashes, weights, and the latent space."""

    item: np.ndarray
    words: list[np.ndarray]  # of each passage's whole item
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    rows: list[np.ndarray]  # of each passage, as vocabulary places
    idf: np.ndarray | None = None
    fold: np.ndarray | None = None  # vocabulary x rank: weight times right singular vectors
    latent: np.ndarray | None = None  # passages x rank
    norm: np.ndarray | None = None
    size: np.ndarray | None = None  # of the passages' weights, by length

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are in the vocabulary, and their places there."""
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << _FILTER_BITS, bool)
            self._bits[self.vocabulary >> np.uint64(64 - _FILTER_BITS)] = True
        at = np.flatnonzero(self._bits[h >> np.uint64(64 - _FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[place] == h[at]
        return at[real], place[real]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_bits"}


def _item_words(text: str) -> np.ndarray:
    return _words([text])[0]


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case, all alphabets, and the number before each text."""
    return _text.words([t and t.lower() for t in texts], lower=False)[:2]


def _index(items: list[tuple[int, str]]) -> Index:
    ids, whole, answers, passages = [], [], [], []
    for item, text in items:
        w = _item_words(text)
        parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if p.strip()]
        answer = _item_words(parts[-1]) if parts else w
        for start in range(0, max(1, len(w) - ITEM_WINDOW // 2), ITEM_WINDOW // 2):
            ids.append(item)
            whole.append(w)
            answers.append(answer)
            passages.append(w[start : start + ITEM_WINDOW])
    vocabulary = np.unique(np.concatenate(passages)) if passages else np.zeros(0, np.uint64)
    return Index(np.array(ids, np.int64), whole, answers, vocabulary, [np.searchsorted(vocabulary, p) for p in passages])


def _block_ids(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each word (blocks end with their text) and the number of blocks before each text."""
    n = np.diff(first)
    per = -(-n // BLOCK)
    before = np.zeros(len(first), np.int64)
    np.cumsum(per, out=before[1:])
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.repeat(before[:-1], n) + place // BLOCK, before


def _offered(h: np.ndarray, at: np.ndarray, place: np.ndarray, owner: np.ndarray, before: np.ndarray) -> list[tuple[int, bytes]]:
    """Of the passages, OFFERED with the smallest hashes of their first words: hash, vocabulary places."""
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    order = _text.mix(np.add.reduceat(h, edge)).view(np.int64)
    own = owner[at]
    out = []
    for k in np.argsort(order)[:OFFERED].tolist():
        end = min(k + WINDOW_BLOCKS, int(before[np.searchsorted(before, k, "right")]))
        words = place[np.searchsorted(own, k) : np.searchsorted(own, end)]
        if len(words):
            out.append((int(order[k]), words.astype(np.int32).tobytes()))
    return out


def _frequencies(docs: DataFrame, index: Index, scratch: Scratch, name: str) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """In how many blocks of all documents each vocabulary word is, how many blocks there are, and a sample of passages."""
    size = len(index.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        total, n = np.zeros(size, np.int64), 0
        offered: dict[int, bytes] = {}
        for b in blocks(batches):
            h, first = _words(b.column("text").to_pylist())
            if not len(h):
                continue
            owner, before = _block_ids(first)
            at, place = index.places(h)
            n += int(before[-1])
            total += np.bincount(np.unique(owner[at] * size + place) % size, minlength=size)
            offered.update(_offered(h, at, place, owner, before))
            offered = dict(sorted(offered.items())[:OFFERED])
        where = np.flatnonzero(total)
        places = [*where.tolist(), -1, *[-2] * len(offered)]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([*total[where].tolist(), n, *offered], pa.int64()), pa.array([None] * (len(where) + 1) + list(offered.values()), pa.binary())], names=["place", "n", "words"])

    counted = scratch.keep(docs.select("text").mapInArrow(count, "place long, n long, words binary"), name)
    df, blocks_n = np.zeros(size, np.int64), 0
    for r in counted.where("place >= -1").groupBy("place").agg(F.sum("n").alias("n")).collect():
        if r["place"] < 0:
            blocks_n = r["n"]
        else:
            df[r["place"]] = r["n"]
    sample = counted.where("place = -2").groupBy("n").agg(F.min("words").alias("words")).orderBy("n").limit(SAMPLE).collect()
    return df, blocks_n, [np.frombuffer(r["words"], np.int32).astype(np.int64) for r in sample]


def _weighted(index: Index, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Vocabulary places and TF-IDF weights of a passage, of length one, and their length before."""
    place, tf = np.unique(row, return_counts=True)
    value = (1 + np.log(tf)) * index.idf[place]
    norm = float(np.linalg.norm(value))
    return place, (value / norm if norm else value).astype(np.float32), norm


def _fit(spark: SparkSession, index: Index, df: np.ndarray, n_blocks: int, sample: list[np.ndarray]) -> None:
    """Randomised SVD: range finder with power rounds, A'(A Q) and (A Q)'(A Q) summed over Spark's partitions of passages."""
    index.idf = np.log1p((n_blocks + 1) / (df + 1.0)).astype(np.float32)  # at least log 2, however frequent the word
    own, rows = len(index.rows), index.rows + sample
    m = len(rows)
    share = np.float32(len(sample) / own if sample else 1.0)  # of a benchmark passage, so that both sides weigh the same
    rng = np.random.default_rng(7)
    q = rng.standard_normal((len(index.vocabulary), max(1, min(RANK, m - 1)))).astype(np.float32)
    passages = spark.range(0, m, 1, max(1, min(8, m // 32)))
    shared = spark.sparkContext.broadcast((rows, index.idf))

    def summed(q: np.ndarray, inside: bool) -> np.ndarray:
        held = spark.sparkContext.broadcast(q)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (rows, idf), q = shared.value, held.value
            like = Index(np.zeros(0), [], [], np.zeros(0), [], idf)
            total = np.zeros((q.shape[1],) * 2 if inside else q.shape, np.float32)
            for b in batches:
                for k in b.column("id").to_pylist():
                    place, value, _ = _weighted(like, rows[k])
                    scale = share if k < own else np.float32(1)
                    if inside:
                        y = value @ q[place]
                        total += scale * np.outer(y, y)
                    else:
                        total[place] += scale * value[:, None] * (value @ q[place])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = passages.mapInArrow(product, "part binary").collect()
        out = sum(np.frombuffer(p["part"], np.float32) for p in parts)
        held.unpersist()
        return out.reshape((q.shape[1],) * 2 if inside else q.shape)

    for _ in range(POWER_ROUNDS):
        q = np.linalg.qr(summed(q, False))[0].astype(np.float32)
    _, turn = np.linalg.eigh(summed(q, True).astype(np.float64))
    q = (q @ turn[:, ::-1]).astype(np.float32)  # right singular vectors, the largest first
    shared.unpersist()
    weighted = [_weighted(index, r) for r in index.rows]
    index.latent = np.stack([value @ q[place] for place, value, _ in weighted]).astype(np.float32)
    index.norm = np.maximum(np.linalg.norm(index.latent, axis=1), np.float32(1e-6))
    index.size = np.array([norm for *_, norm in weighted], np.float32)
    index.fold = index.idf[:, None] * q


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _hits(index: Index, texts: list[str | None]) -> list[dict[int, tuple[float, float]]]:
    """For each text: item -> (cosine, share of the item's words in order), checked."""
    found: list[dict[int, tuple[float, float]]] = [{} for _ in texts]
    h, first = _words(texts)
    owner, before = _block_ids(first)
    at, place = index.places(h)
    if not len(at):
        return found
    own = owner[at]
    total = int(before[-1])
    text_of = np.repeat(np.arange(len(texts)), np.diff(before))
    last = before[1:][text_of]
    # A window that holds PARAPHRASE of an item has so many words of the vocabulary.
    known = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=total))))
    known = known[np.minimum(np.arange(total) + WINDOW_BLOCKS, last)] - known[:total]
    some = np.flatnonzero(known >= PARAPHRASE * min(LEAST_WORDS, min(len(r) for r in index.rows)))
    if not len(some):
        return found
    # Latent sums of the blocks that those windows need.
    need = np.zeros(total + WINDOW_BLOCKS, bool)
    for d in range(WINDOW_BLOCKS):
        need[some + d] = True
    number = np.cumsum(need) - 1
    use = need[own]
    own, place = number[own[use]], place[use]
    sums = np.zeros((int(need.sum()) + 1, index.fold.shape[1]), np.float32)
    edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    for lo in range(0, len(edge), 8192):
        e = edge[lo : lo + 8192]
        stop = edge[lo + 8192] if lo + 8192 < len(edge) else len(own)
        sums[own[e]] = np.add.reduceat(index.fold[place[e[0] : stop]], e - e[0], axis=0)
    step = max(64, min(8192, 4_000_000 // len(index.rows)))
    for lo in range(0, len(some), step):
        s = some[lo : lo + step]
        x = np.zeros((len(s), index.fold.shape[1]), np.float32)
        for d in range(WINDOW_BLOCKS):
            inside = s + d < last[s]
            x[inside] += sums[number[s[inside] + d]]
        dot = x @ index.latent.T
        held = dot / (index.norm**2 * index.size)[None, :]
        length = np.linalg.norm(x, axis=1)
        # Where a passage is frequent itself, rarer words around it outweigh it and no window with them is near; then what
        # the window holds of it tells.
        rows, cols = np.nonzero(held >= COVERED)
        cosine = dot[rows, cols] / np.maximum(length[rows] * index.norm[cols], 1e-9)
        near = (cosine >= COSINE) | (held[rows, cols] >= HELD)
        rows, cols, cosine = rows[near], cols[near], cosine[near]
        for r, c, near in zip(rows.tolist(), cols.tolist(), cosine.tolist(), strict=True):
            doc = int(text_of[s[r]])
            item, words = int(index.item[c]), index.words[c]
            if found[doc].get(item, (0.0, 0.0))[1] == 1.0:
                continue
            start = first[doc] + (int(s[r]) - before[doc]) * BLOCK
            margin = max(BLOCK, len(words))
            region = h[max(first[doc], start - margin) : min(first[doc + 1], start + BLOCK * WINDOW_BLOCKS + margin)]
            share = _common(words, region) / len(words)
            if share < PARAPHRASE or (share < SAME and _common(index.answers[c], region) < ANSWER * len(index.answers[c])):
                continue
            if share > found[doc].get(item, (0.0, 0.0))[1]:
                found[doc][item] = (round(min(near, 1.0), 6), round(share, 6))
    return found


def _hits_of(shards: list[Index], texts: list[str | None]) -> list[dict[int, tuple[float, float]]]:
    """_hits of all shards; of an item that several hold, what covers most of it."""
    found = _hits(shards[0], texts)
    for other in shards[1:]:
        for own, more in zip(found, _hits(other, texts), strict=True):
            for item, what in more.items():
                own[item] = max(own.get(item, what), what, key=lambda x: x[1])
    return found


def _cut(whole: Index) -> Iterator[tuple[Index, np.ndarray]]:
    """whole in indexes of at most PASSAGES passages, with their places in its vocabulary."""
    for lo in range(0, len(whole.rows), PASSAGES):
        hi = lo + PASSAGES
        places = np.unique(np.concatenate(whole.rows[lo:hi]))
        yield Index(whole.item[lo:hi], whole.words[lo:hi], whole.answers[lo:hi], whole.vocabulary[places], [np.searchsorted(places, r) for r in whole.rows[lo:hi]]), places


def _shards(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Index]]:
    """Fitted indexes that are searched together, one part of the benchmark after another."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    n = items.count()
    parts = max(1, -(-n // (ITEMS * 3 // 4)))
    np.seterr(over="ignore")
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in own.collect())
        whole = _index([r for r in rows if len(_item_words(r[1])) >= LEAST_WORDS])
        if not whole.rows:
            continue
        df, n_blocks, sample = _frequencies(docs, whole, scratch, f"counted{k}")
        shards = []
        for index, places in _cut(whole):
            inside = np.full(len(whole.vocabulary), -1)
            inside[places] = np.arange(len(places))
            own_sample = [w for w in (inside[s] for s in sample) if (w >= 0).any()]
            _fit(spark, index, df[places], n_blocks, [w[w >= 0] for w in own_sample])
            shards.append(index)
        yield shards


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common) of every document that holds a benchmark item, for each such item.

    docs (doc_id, text), benchmark (item_id, text); other columns are not read. Null and empty texts hold nothing; items
    without text, or of fewer than LEAST_WORDS words, are not searched for. Texts of any length are whole; of windows that
    hold equal shares of an item the first one's cosine is told. Repeated rows give a row each; an empty table on either
    side gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common double")
    for shards in _shards(rows, benchmark):

        def search(batches: Iterator[pa.RecordBatch], shards: list[Index] = shards) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for b in blocks(batches):
                ids = b.column("doc_id").to_pylist()
                hits = [(ids[k], item, *what) for k, own in enumerate(_hits_of(shards, b.column("text").to_pylist())) for item, what in sorted(own.items())]
                if hits:
                    columns = list(zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "cosine", "common"])

        out = out.union(rows.mapInArrow(search, out.schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns."""
    schema = T.StructType(list(docs.schema.fields))
    for shards in _shards(docs.select(F.col("text").cast("string").alias("text")), benchmark):

        def clean(batches: Iterator[pa.RecordBatch], shards: list[Index] = shards) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for b in blocks(batches):
                yield b.filter(pa.array([not own for own in _hits_of(shards, b.column("text").to_pylist())]))

        docs = docs.mapInArrow(clean, schema)
    return docs
