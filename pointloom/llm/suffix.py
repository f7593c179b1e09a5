"""Exact removal of repeated byte strings through a sparse suffix array.

Every string of LENGTH bytes has one anchor: the 100-byte gram with the smallest hash among its 301 (the leftmost of
equals). Equal strings have the anchor at the same place, so only suffixes at anchors, about one in 150 bytes, enter the
array. Grams that occur once are gone after a count, and surroundings that are equal as a whole are one entry with a
count; if that is two or more everything in them repeats.

Where a gram has different surroundings, the suffixes at it are fetched from the texts and dealt to buckets by splitters
that Spark samples from their leading bytes, so that a bucket holds a range of the suffix order. A bucket sorts its
suffixes, and what comes before them read backwards, by multikey quicksort with eight bytes as a character, and compares
neighbours: a node of the tree of longest common prefixes holds the suffixes that share its depth in bytes to the right,
and within it the neighbours in the backward order share most to the left. Where both together reach LENGTH, the bytes
repeat. Equal leading bytes are never on both sides of a splitter; a group too large for a bucket is cut into ranges of
starts, whose suffixes are dealt again by the bytes that all of a range share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._spark import Scratch, blocks

LENGTH, GRAM = 400, 100
_REACH = LENGTH - GRAM  # an anchor's string starts at most so many bytes before it
_U = np.uint64
_LOW = _U((1 << 32) - 1)
#: The most rows that one group may have in a bucket, and rows that are sorted at a time. Where nodes lie within each other
#: at all depths, a row is in up to REACH + 1 of them; so many pairs of a node and a row are held at a time.
GROUP, _ROWS = 8000, 8000
_PAIRS = 200_000
#: Words of a gram that is looked for in other documents: of so many in a row, one is chosen, so that every passage of
#: PASSAGE words has a chosen gram.
PASSAGE, WORDS = 51, 26
#: Starts in a range, by level of cutting.
_WIDTHS = (_REACH + 1, 76, 19, 5, 2, 1)
_ROW = "gram long, times long, doc long, key long, base int, low int, at int, around binary"
_ROW_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_RUN = "doc long, key long, start int, end int"
_RANDOM = np.random.default_rng(8)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes in a row. It chooses and deals; what is equal is decided on bytes."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    n = len(data) - GRAM + 1
    return _text.mix((total[GRAM:] - total[:n]) * inverse[:n])


def _chosen(h: np.ndarray, width: int, inside: np.ndarray) -> np.ndarray:
    """Places of the smallest of every `width` hashes in a row (by 32 bits, of equals the leftmost), where `inside`."""
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    place = (low[inside[: len(low)]] & _LOW).astype(np.int64)
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents data[starts[k] : starts[k + 1] - 1] -> of each anchor: document, place in data, gram hash, surroundings hash."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    gram = _gram_hashes(data)
    ends = starts[1:] - 1
    doc = np.searchsorted(starts, np.arange(len(gram)), "right") - 1
    place = _chosen(gram, _REACH + 1, np.arange(len(gram)) + LENGTH <= ends[doc])
    doc = doc[place]
    lo, hi = np.maximum(starts[doc], place - _REACH), np.minimum(ends[doc], place + LENGTH)
    whole = memoryview(data)
    digests = [hashlib.blake2b(whole[x:y], digest_size=8).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
    span = np.frombuffer(b"".join(digests), np.uint64) + (place - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    return doc, place, gram[place].view(np.int64), span.view(np.int64)


def word_anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each chosen gram of WORDS words, once a document: document, hash. Every PASSAGE words in a row have one."""
    h, first, *_ = _text.words(texts, lower=False)
    if len(h) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram, at = _text.shingles(h, np.array([0, len(h)]), WORDS)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))[: len(gram)]
    place = _chosen(gram, PASSAGE - WORDS + 1, np.arange(len(gram)) + PASSAGE <= first[1:][doc])
    value, before = _text.unique_by_text(gram[place], np.searchsorted(doc[place], np.arange(len(texts) + 1)))
    return np.repeat(np.arange(len(texts)), np.diff(before)), value.view(np.int64)


_FOUND = "doc long, key long, place int, gram long, span long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of bytes, and of words (place -1)."""
    np.seterr(over="ignore")
    for b in blocks(batches):
        texts = b.column("text").to_pylist()
        data, starts = _text.joined(texts)
        doc, place, gram, span = anchors(data, starts)
        place = (place - starts[doc]).astype(np.int32)
        for own in ((doc, place, gram, span), (*(w := word_anchors(texts))[:1], np.full(len(w[0]), -1, np.int32), w[1], np.zeros(len(w[0]), np.int64))):
            who = pa.array(own[0])
            yield pa.RecordBatch.from_arrays([b.column("doc").take(who), b.column("key").take(who), *(pa.array(x) for x in own[1:])], names=["doc", "key", "place", "gram", "span"])


def _batches(rows: list[tuple], names: str, types: tuple, size: int = 5000) -> Iterator[pa.RecordBatch]:
    names_only = [x.split()[0] for x in names.split(", ")]
    for k in range(0, len(rows), size):
        columns = zip(*rows[k : k + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_only)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text with the places asked for -> a row for each place with its surroundings.

    base: where these start in the document; low: which of the REACH + 1 strings about the anchor is their first; at: where
    in them the bytes that all the group's strings share start, which is the anchor.
    """
    for b in blocks(batches):
        out = []
        for doc, key, text, spots in zip(*(b.column(c).to_pylist() for c in ("doc", "key", "text", "spots")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for s in spots:
                lo = max(0, s["place"] - _REACH)
                out.append((s["gram"], s["times"], doc, key, lo, _REACH - (s["place"] - lo), s["place"] - lo, data[lo : s["place"] + LENGTH]))
        yield from _batches(out, _ROW, _ROW_TYPES)


def _hash(data: bytes, *salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=b"".join(x.to_bytes(8, "little", signed=True) for x in salt)).digest(), "little", signed=True)


def _cutter(width: int):
    """Cuts surroundings into ranges of `width` starts, dealt by the bytes that all strings of a range share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for gram, times, doc, key, base, low, _, around in zip(*(b.column(c).to_pylist() for c in (x.split()[0] for x in _ROW.split(", "))), strict=True):
                last = low + len(around) - LENGTH
                for cell in range(low // width, last // width + 1):
                    first, end = max(low, cell * width), min(last, (cell + 1) * width - 1)
                    pivot = (cell + 1) * width - 1
                    shared = around[pivot - low : cell * width + LENGTH - low]
                    own = around[first - low : end + LENGTH - low]
                    out.append((_hash(shared, gram, cell), times, doc, key, base + first - low, first, pivot - first, own, _hash(own, first)))
            yield from _batches(out, f"{_ROW}, span long", (*_ROW_TYPES, pa.int64()))

    return cut


def sort_strings(group: np.ndarray, parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings (at most `size` bytes) within their groups, which are next to each other, and how many bytes
    each has in common with the one before it; 0 at the start of a group.

    Multikey quicksort: all runs of strings that are equal so far are sorted by their next eight bytes and cut where
    these differ.
    """
    n, words = len(parts), -(-size // 8)
    length = np.array([len(p) for p in parts], np.int64)
    own = np.frombuffer(b"".join(p.ljust(8 * words, b"\0") for p in parts), ">u8").reshape(n, words).astype(np.uint64)
    order = np.arange(n)
    cut = np.ones(n + 1, bool)  # where a run starts
    cut[1:n] = group[1:] != group[:-1]
    for k in range(words):
        live = np.flatnonzero(~(cut[:-1] & cut[1:]))  # positions in runs of two or more
        if not len(live):
            break
        run = np.cumsum(cut[:-1])[live]
        key = own[order[live], k]
        turn = np.lexsort((key, run))
        order[live] = order[live][turn]
        key = key[turn]
        cut[live[1:]] |= key[1:] != key[:-1]
    order = order[np.lexsort((length[order], np.cumsum(cut[:-1])))]  # a string comes before those that go on
    common = np.zeros(n, np.int64)
    if n > 1:
        x = own[order[1:]] ^ own[order[:-1]]
        first = (x != 0).argmax(axis=1)
        value = x[np.arange(n - 1), first]
        lead = sum((value < _U(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        equal = np.where(value == 0, 8 * words, 8 * first + lead)
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], np.minimum(equal, np.minimum(length[order[1:]], length[order[:-1]])), 0)
    return order, common


def prefix_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the tree of common prefixes of `least` or more: first and last position, depth."""
    out, stack = [], []
    for k, c in enumerate([*common.tolist()[1:], 0], 1):
        lo = k - 1
        while stack and stack[-1][1] > c:
            lo, depth = stack.pop()
            out.append((lo, k - 1, depth))
        if c >= least and (not stack or stack[-1][1] < c):
            stack.append((lo, c))
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo + 1 : hi + 1] for each lo < hi."""
    levels = [values]
    span = hi - lo
    while (2 << len(levels) - 1) <= int(span.max(initial=0)):
        half = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out = np.zeros(len(lo), np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(levels[k][lo[own] + 1], levels[k][hi[own] + 1 - (1 << k)])
    return out


def compare_groups(gram: np.ndarray, at: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each row, first byte and end within its surroundings of those that are in a LENGTH-byte string over the byte
    `at` which another row of its gram has too; 0, 0 where there are none. Rows of a gram are next to each other.
    """
    n = len(around)
    begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, common = sort_strings(gram, [x[a : a + LENGTH] for x, a in zip(around, at.tolist(), strict=True)], LENGTH)
    lo, hi, depth = prefix_nodes(common, LENGTH - _REACH)
    if not len(lo):
        return begin, end
    back, shared = sort_strings(gram, [x[max(0, a - _REACH) : a][::-1] for x, a in zip(around, at.tolist(), strict=True)], _REACH)
    rank = np.empty(n, np.int64)
    rank[back] = np.arange(n)
    size = hi - lo + 1
    total = np.cumsum(size)
    first = 0
    while first < len(lo):  # each pair of a node and a row of it is looked at by itself, so that they can come in parts
        last = max(first + 1, int(np.searchsorted(total, total[first] - size[first] + _PAIRS, "right")))
        part = slice(first, last)
        node = np.repeat(np.arange(last - first), size[part])
        position = np.arange(len(node)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + lo[part][node]
        row = order[position]
        turn = np.lexsort((rank[row], node))
        row = row[turn]
        where = rank[row]
        next_to = np.flatnonzero(node[1:] == node[:-1])
        left = np.zeros(len(row), np.int64)
        near = _least_between(shared, where[next_to], where[next_to + 1])
        left[next_to] = near
        left[next_to + 1] = np.maximum(left[next_to + 1], near)
        right = depth[part][node]
        real = np.flatnonzero(left + right >= LENGTH)
        np.maximum.at(begin, row[real], left[real])
        np.maximum.at(end, row[real], right[real])
        first = last
    hit = end > 0
    return np.where(hit, at - begin, 0), np.where(hit, at + end, 0)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leading bytes and gram within the task; groups are held whole.

    Rows that stand for several equal surroundings (times over 1) are compared, but get no runs.
    """
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        begin, end = compare_groups(table.column("gram").to_numpy(), table.column("at").to_numpy().astype(np.int64), table.column("around").to_pylist())
        base = table.column("base").to_numpy()
        some = np.flatnonzero((end > 0) & (table.column("times").to_numpy() == 1))
        who = pa.array(some)
        return pa.RecordBatch.from_arrays([*(table.column(c).take(who).combine_chunks() for c in ("doc", "key")), *(pa.array((base + x)[some].astype(np.int32)) for x in (begin, end))], names=["doc", "key", "start", "end"])

    for b in batches:
        for k in range(0, b.num_rows, _ROWS):
            held.append(b.slice(k, _ROWS))
            if sum(x.num_rows for x in held) < _ROWS:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            other = np.flatnonzero(gram != gram[-1])
            if len(other):
                yield out(table.slice(0, int(other[-1]) + 1))
                held = table.slice(int(other[-1]) + 1).to_batches()
    if held and sum(x.num_rows for x in held):
        yield out(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, removed, spans, shas = [], [], [], []
        for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            kept, at, gone, n = hashlib.sha256(), 0, 0, 0
            for lo, hi in merged(runs or []):
                kept.update(data[at:lo])
                gone += hi - lo
                at, n = hi, n + 1
            kept.update(data[at:])
            for column, value in zip((size, removed, spans, shas), (len(data), gone, n, kept.hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(shas, pa.string()), b.column("n_shared")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["start"], r["end"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared; one row per row.

    Every byte in a LENGTH-byte string that also starts elsewhere, in the same document or another, is removed. n_shared:
    how many of the document's chosen grams of WORDS words are in another document too; a passage of PASSAGE words or more
    that another document has gives one at least, also where it is shorter than LENGTH bytes and stays. Null texts
    are empty. Repeated rows are documents of their own, so what they hold of LENGTH bytes or more repeats; for n_shared
    they are one document, and each has the sum over them. Texts of any length are whole. Ties (equal grams, equal strings) are decided by place, which
    changes no result. Extra columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63) + 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"))
    every = scratch.keep(docs.select("doc", "key", "text").mapInArrow(_scan, _FOUND), "found")
    words = every.where("place < 0").select("doc", "key", "gram")
    elsewhere = scratch.keep(words.groupBy("gram").agg(F.min(F.struct("doc", "key")).alias("a"), F.max(F.struct("doc", "key")).alias("b")).where("a <> b").select("gram"), "elsewhere")
    shared = scratch.keep(words.join(elsewhere, "gram", "left_semi").groupBy("doc", "key").agg(F.count("*").alias("n_shared")), "shared")
    found = every.where("place >= 0")
    spans = scratch.keep(found.groupBy("gram", "span").agg(F.count("*").alias("times"), F.min(F.struct("doc", "key", "place")).alias("at")), "spans")
    scratch.settle()
    whole = found.join(spans.where("times > 1").select("gram", "span"), ["gram", "span"], "left_semi")
    whole = whole.select("doc", "key", F.greatest(F.col("place") - _REACH, F.lit(0)).alias("start"), (F.col("place") + LENGTH).alias("end"))
    runs = [scratch.keep(whole, "runs_whole")]
    # Written first, so that the join can split a gram with very many surroundings.
    mixed = scratch.keep(spans.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "mixed")
    spots = spans.join(mixed, "gram", "left_semi").select("at.*", "gram", "times")
    spots = spots.groupBy("doc", "key").agg(F.collect_list(F.struct("place", "gram", "times")).alias("spots"))
    asked = docs.select("doc", "key", "text").join(spots, ["doc", "key"])
    around = scratch.keep(asked.mapInArrow(_around, _ROW), "around0")
    scratch.drop("found", "spans", "elsewhere")
    scratch.settle()
    for level in range(len(_WIDTHS)):
        large = around.groupBy("gram").agg(F.count("*").alias("n")).where(f"n > {GROUP}").select("gram")
        large = scratch.keep(large, f"large{level}")
        some = bool(large.take(1))
        small = around.join(large, "gram", "left_anti") if some else around
        # Spark samples the splitters from these leading bytes, as many as the session has shuffle partitions.
        lead = F.expr(f"substring(around, at + 1, {GRAM})")
        dealt = small.withColumn("lead", lead).repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram").drop("lead")
        runs.append(scratch.keep(dealt.mapInArrow(_compare, _RUN), f"runs{level}"))
        if not some:
            break
        parts = around.join(large, "gram", "left_semi").mapInArrow(_cutter(_WIDTHS[level + 1]), f"{_ROW}, span long")
        parts = scratch.keep(parts, f"parts{level}")
        entry = (F.sum("times").alias("times"), F.min(F.struct("doc", "key", "base", "low")).alias("whose"), F.first("at").alias("at"), F.first("around").alias("around"))
        told = scratch.keep(parts.groupBy("gram", "span").agg(*entry), f"told{level}")
        equal = parts.where("times = 1").join(told.where("times > 1").select("gram", "span"), ["gram", "span"], "left_semi")
        equal = equal.select("doc", "key", F.col("base").alias("start"), (F.col("base") + F.length("around")).alias("end"))
        runs.append(scratch.keep(equal, f"equal{level}"))
        around = told.select("gram", "times", "whose.*", "at", "around")
    every = runs[0]
    for more in runs[1:]:
        every = every.union(more)
    scratch.settle()
    runs = every.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    last = F.octet_length("text")
    out = docs.join(runs, ["doc", "key"], "left").join(shared, ["doc", "key"], "left")
    out = out.select("doc_id", "text", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], last).alias("end"))).alias("runs"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")
