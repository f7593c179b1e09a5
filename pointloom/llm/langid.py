"""Hierarchical language identification: family first, then one-versus-one linear support vector machines within it.

Features are hashed two- and four-byte sequences of the whole text (letters of ASCII lower-cased, its other characters a
space, further UTF-8 bytes as they are), as shares of their number. All machines are linear, so a text's value is the mean
of its features' weights and texts of any length cost the same per byte.

Every labelled document that is not held out is learned from. Up to TOGETHER of them are fitted at once; more are dealt by
a hash and fitted in blocks of BLOCK_DOCS, and each machine is the mean of those of the blocks that have both its sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text
from ._spark import blocks

#: Documents that are fitted at once, on the driver, and documents of a block where there are more.
TOGETHER, BLOCK_DOCS = 1200, 128
#: Tasks that add up the machines of all others.
_SUMS = 32
UNDETERMINED = "und"
_BITS = 13
_SIZE = 2 << _BITS

#: Branches of common ISO 639-1 codes. Other codes form the branch "other".
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "sl", "bs", "pl", "cs", "sk"],
    "celtic": ["ga", "gd", "cy", "br"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt", "am"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), "other")


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the two- and four-byte features at each byte, and where texts start. A text's features stay within it."""
    data, starts = _text.joined(texts)
    b = _FOLD[data].astype(np.uint32)
    b = np.concatenate((b, np.full(3, 32, np.uint32)))
    n = len(data)
    two = b[:n] | b[1 : n + 1] << np.uint32(8)
    four = two | (b[2 : n + 2] | b[3 : n + 3] << np.uint32(8)) << np.uint32(16)
    for d in (1, 2):  # four-byte sequences over a text's end count as its two bytes
        at = starts[1:] - 1 - d
        at = at[at >= 0]
        four[at] = two[at]
    at = starts[1:] - 1
    two[at], four[at] = 32 | 32 << 8, 32 | 32 << 8
    shift = np.uint32(32 - _BITS)
    return (two * np.uint32(2654435761)) >> shift, ((four * np.uint32(2246822519)) >> shift) + np.uint32(1 << _BITS), starts


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for b in blocks(batches):
        two, four, starts = _features(b.column("text").to_pylist())
        at, n = [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            counts = np.bincount(np.concatenate((two[lo:hi], four[lo:hi])), minlength=_SIZE)
            where = np.flatnonzero(counts)
            at.append(where.astype(np.uint16).tobytes())
            n.append((counts[where] / (hi - lo)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])


def _svm(products: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 10.0) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge machine by accelerated gradient steps; classes weigh the same.

    products: those of all pairs of rows. The weights are a sum of rows; returned are each row's share in it and the bias.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(len(y), np.float32)
    bias = 0.0
    ahead, ahead_bias, last, last_bias = w, bias, w, bias
    step = 1.0 / (1.0 + 2 * c * float((weight * (np.diagonal(products) + 1)).sum()))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (products @ ahead + ahead_bias)) * weight * y
        w = ahead - step * (ahead - 2 * c * slack)
        bias = ahead_bias + step * 2 * c * float(slack.sum())
        m = k / (k + 3)
        ahead, ahead_bias = w + m * (w - last), bias + m * (bias - last_bias)
        last, last_bias = w, bias
    return w, bias


class Model:
    """Weights of the family machines (one against the rest) and of the one-versus-one machines of each family."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.families = sorted({family(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        n = (len(self.families) if len(self.families) > 1 else 0) + len(self.pairs)
        self.weights, self.bias = np.zeros((n, _SIZE), np.float32), np.zeros(n)

    def sides(self, lang: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Machine, rows and sides (1 or -1), of the machines that have rows on both sides."""
        own = np.array([family(v) for v in lang])
        many = len(self.families) if len(self.families) > 1 else 0
        for k in range(len(self.bias)):
            a, b = (self.families[k], None) if k < many else self.pairs[k - many]
            rows = np.arange(len(lang)) if k < many else np.flatnonzero((lang == a) | (lang == b))
            y = np.where((own if k < many else lang)[rows] == a, 1, -1)
            if len(rows) and y.min() < y.max():
                yield k, rows, y.astype(np.float32)

    def fit(self, x: np.ndarray, lang: np.ndarray, only: set[int] | None = None) -> dict[int, float]:
        """Fits the machines (of `only`) that have rows on both sides; for each of these the harmonic mean of its sides' rows."""
        gain = (1 / np.sqrt(x.mean(axis=0) + 1e-6)).astype(np.float32)
        x *= gain
        products = x @ x.T
        mass = {}
        for k, rows, y in self.sides(lang):
            if only is None or k in only:
                share, self.bias[k] = _svm(products[np.ix_(rows, rows)], y)
                self.weights[k] = (share @ x[rows]) * gain
                mass[k] = 2 / (1 / (y > 0).sum() + 1 / (y < 0).sum())
        return mass

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        two, four, starts = _features(texts)
        n = np.diff(starts)
        value = np.empty((len(self.bias), len(texts)))
        for k, w in enumerate(self.weights):
            value[k] = (np.add.reduceat(w[two], starts[:-1], dtype=np.float64) + np.add.reduceat(w[four], starts[:-1], dtype=np.float64)) / n + self.bias[k]
        sure = 1 / (1 + np.exp(-2 * np.clip(value, -30, 30)))
        many = len(self.families) if len(self.families) > 1 else 0
        langs, scores = [], []
        for i, text in enumerate(texts):
            if not self.langs or text is None or not any(map(str.isalpha, text)):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            chosen = int(np.argmax(value[:many, i])) if many else 0
            score = float(sure[chosen, i]) if many else 1.0
            members = self.members[self.families[chosen]]
            votes = dict.fromkeys(members, 0.0)
            won = dict.fromkeys(members, 1.0)
            for k, (a, b) in enumerate(self.pairs, many):
                if a in votes and b in votes:
                    p = float(sure[k, i])
                    votes[a] += (p > 0.5) + p / 1e3
                    votes[b] += (p <= 0.5) + (1 - p) / 1e3
                    won[a], won[b] = min(won[a], p), min(won[b], 1 - p)
            best = max(members, key=lambda x: (votes[x], x))
            langs.append(best)
            scores.append(min(score, won[best]))
        return langs, scores


def train(docs: DataFrame, together: int = TOGETHER) -> Model:
    """Fit on all labelled documents (lang and text not null) that are not held out."""
    usable = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out_column() == F.lit(False)))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    model = Model(list(counts))
    if len(model.bias) == 0:
        return model
    if sum(counts.values()) <= together:
        model.fit(*_dense(usable.mapInArrow(_histograms, "lang string, at binary, n binary").collect()))
        return model
    mass = dict.fromkeys(range(len(model.bias)), 0.0)
    total = np.zeros((len(model.bias), _SIZE + 1))
    for r in sorted(_machines(usable, model.langs).collect(), key=lambda r: (r["machine"], r["mass"], bytes(r["total"]))):
        mass[r["machine"]] += r["mass"]
        total[r["machine"]] += np.frombuffer(r["total"])
    for k, m in mass.items():
        if m:
            model.weights[k], model.bias[k] = total[k, :-1] / m, total[k, -1] / m
    left = {k for k, m in mass.items() if not m}
    if left:  # rare languages that met in no block: an equal share of each, which is all of those that have no more
        share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, together / len(counts) / n) * (1 << 30)))]), F.col("lang"))
        place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string")), F.lit(1 << 30)).cast("long")
        model.fit(*_dense(usable.where(place < share).mapInArrow(_histograms, "lang string, at binary, n binary").collect()), left)
    return model


def _dense(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Features and languages of rows (lang, at, n), in an order of their own."""
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    x = np.zeros((len(rows), _SIZE), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
    return x, np.array([r["lang"] for r in rows])


def _machines(usable: DataFrame, langs: list[str]) -> DataFrame:
    """(machine, mass, total): weights and bias of the blocks' machines times their mass, added up by _SUMS tasks."""
    schema = "part int, machine int, mass double, total binary"

    def added(found: dict[int, list], part: int) -> pa.RecordBatch:
        keys = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int32()), pa.array([found[k][0] for k in keys], pa.float64()), pa.array([found[k][1].tobytes() for k in keys], pa.binary())], names=["part", "machine", "mass", "total"])

    def add(found: dict[int, list], k: int, mass: float, total: np.ndarray) -> None:
        own = found.setdefault(k, [0.0, np.zeros(_SIZE + 1)])
        own[0] += mass
        own[1] += total

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, list] = {}
        held: list[dict] = []

        def block() -> None:
            model = Model(langs)
            for k, m in model.fit(*_dense(held)).items():
                add(found, k, m, np.append(model.weights[k].astype(np.float64), model.bias[k]) * m)
            held.clear()

        for b in _histograms(batches):
            for r in b.to_pylist():
                held.append(r)
                if len(held) == BLOCK_DOCS:
                    block()
        if held:
            block()
        yield added(found, TaskContext.get().partitionId() % _SUMS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                add(found, r["machine"], r["mass"], np.frombuffer(r["total"]))
        yield added(found, 0)

    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    dealt = usable.repartition(order).sortWithinPartitions(order)
    return dealt.mapInArrow(fitted, schema).repartition(_SUMS, "part").sortWithinPartitions("part", "machine", "total").mapInArrow(summed, schema).drop("part")


def held_out_column():
    """True where crc32 of the id as text leaves 0 modulo 5; null ids are neither held out nor learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def predict(docs: DataFrame, model: Model, language: str, score: str) -> DataFrame:
    """docs with the columns `language` and `score` added; every other column is passed through."""
    fields = [*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in blocks(batches):
            langs, scores = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, language, score])

    return docs.mapInArrow(run, T.StructType(fields))


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score; one row per row.

    A null text and a text without a letter are UNDETERMINED with score 0, as is everything where nothing is labelled.
    lang is read for fitting only. Texts of any length are whole; of languages with equal votes the last in the alphabet is
    taken. Repeated rows are told once each. Extra columns are not read. An empty table gives an empty table.
    """
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = predict(rows, model, "lang_pred", "score")
    return out.select("doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), "lang_pred", "score")
