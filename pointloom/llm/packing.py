"""Best-fit packing of tokenised documents: local best fit, then a tree of merges of what stayed underfull.

Every task packs the pieces it holds best-fit decreasing. Bins filled to CAPACITY - SLACK leave for good; the others
become items of the next round, in which fewer tasks hold more of them, until a single bounded task packs the last ones
or a round joins nothing. An item carries its pieces, so that rounds need no joins.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._spark import Kept, Scratch, blocks

CAPACITY, SLACK = 2048, 8
#: Items that one task packs at a time.
TASK_ITEMS = 200_000
#: Distinct chunks that a worker keeps with their ids, and distinct parts of chunks; those it met first, mostly the
#: frequent ones, stay when there are too many.
CACHE, CORE = 150_000, 110_000
PARTS, PARTS_CORE = 700_000, 600_000
END = 0

_MARKS = frozenset(".,;:!?)|")

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = f"sequence_id long, fill int, pieces array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in _PIECE.split(', ')))}>>"
_PIECE_TYPE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class _Numbers(dict):
    """Numbers its keys in the order of their first lookup; `fresh` has the keys that are new."""

    def __init__(self, *args):
        super().__init__(*args)
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class _Ids:
    """Ids by number: one growing array, and where each number's ids end."""

    def __init__(self):
        self.numbers = _Numbers()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # entry k + 1 is the end of number k
        self.known = 0

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.ends[self.known])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.known + len(lengths) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[used : used + len(ids)] = ids
        self.ends[self.known + 1 : self.known + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.known += len(lengths)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers one after another, and the ids before each number."""
        begin = self.ends[which]
        n = self.ends[which + 1] - begin
        before = np.zeros(len(which) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        return self.ids[np.arange(before[-1]) + np.repeat(begin - before[:-1], n)], before

    def forget(self, keep: int) -> None:
        self.numbers = _Numbers(islice(self.numbers.items(), keep))
        self.known = keep


class ChunkTokenizer:
    """Ids of whole texts by a tokenizer whose pre-tokenizer never joins text across white space.

    Each chunk between white space is encoded once and its ids are kept; texts are then gathered from these. A new chunk
    of Latin-1 characters is put together from the pre-tokenizer's parts, which repeat more. Texts with control
    characters that Python and the tokenizer treat differently are encoded directly, and so are all texts where the
    file's normalizer or pre-tokenizer is another one than is written out here.
    """

    #: The normalizer and the pre-tokenizer that chunks and parts are right for.
    _NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    _PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    _ODD = r"[\x{1c}-\x{1f}\x{85}]"
    #: The pre-tokenizer's pattern, its classes written out for lower-cased Latin-1.
    _PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.parts = _Ids(), _Ids()
        form = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.by_chunks = form == [self._NORMALIZER, self._PRE_TOKENIZER]

    def _direct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
        at = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=at[1:])
        return np.fromiter((i for x in lists for i in x), np.uint32, at[-1]), at

    def _learn_parts(self) -> None:
        fresh, self.parts.numbers.fresh = self.parts.numbers.fresh, []
        for at in range(0, len(fresh), 4000):
            some = fresh[at : at + 4000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)  # each part is one word to the pre-tokenizer
            self.parts.append(np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))

    def _learn_chunks(self) -> None:
        fresh, self.chunks.numbers.fresh = self.chunks.numbers.fresh, []
        which, n, direct = [], [], {}
        number = self.parts.numbers.__getitem__
        for k, chunk in enumerate(fresh):
            if "<|" in chunk or not (chunk.isascii() or ord(max(chunk)) < 256):
                direct[k] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint32)
                n.append(0)
            elif chunk.isalpha():
                which.append(number(chunk.lower()))
                n.append(1)
            elif chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                which += (number(chunk[:-1].lower()), number(chunk[-1]))
                n.append(2)
            else:
                own = list(map(number, self._PARTS.findall(chunk.lower())))
                which += own
                n.append(len(own))
        self._learn_parts()
        ids, before = self.parts.gather(np.array(which, np.int64))
        at = before[np.concatenate(([0], np.cumsum(n, dtype=np.int64)))]
        if direct:
            cut = [at[k] for k in direct]
            pieces, last = [], 0
            for c, own in zip(cut, direct.values(), strict=True):
                pieces += [ids[last:c], own]
                last = c
            ids = np.concatenate([*pieces, ids[last:]])
        lengths = np.diff(at)
        for k, own in direct.items():
            lengths[k] = len(own)
        self.chunks.append(ids, lengths)
        if len(self.parts.numbers) > PARTS:
            self.parts.forget(PARTS_CORE)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number before each text.

        Arrow splits the texts and finds the distinct chunks, so that Python sees each of these once.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_chunks:
            return self._direct(texts)
        lists = pc.utf8_split_whitespace(texts)
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if len(self.chunks.numbers) > CACHE:
            self.chunks.forget(CORE)
        distinct = np.fromiter(map(self.chunks.numbers.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        which = distinct[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        odd = np.flatnonzero(pc.match_substring_regex(texts, self._ODD).to_numpy(zero_copy_only=False)).tolist()
        if odd:
            which[np.isin(np.repeat(np.arange(len(lengths)), lengths), odd)] = self.chunks.numbers[""]
        self._learn_chunks()
        ids, before = self.chunks.gather(which)
        at = before[np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))]
        for i in reversed(odd):
            own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids = np.insert(ids, at[i], own)
            at[i + 1 :] += len(own)
        return ids, at


_tokenizers = Kept(ChunkTokenizer)


def _kept() -> Kept:
    """The worker's own; a task would otherwise carry the driver's."""
    return _tokenizers


def _cutter(path: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _kept().use(path) as encoder:
            for b in blocks(batches, size=2_000_000):
                yield _pieces(encoder, b)

    return cut


def _pieces(encoder: ChunkTokenizer, b: pa.RecordBatch) -> pa.RecordBatch:
    docs = b.column("doc_id").to_pylist()
    ids, at = encoder.encode(b.column("text"))
    rows: tuple[list, ...] = ([], [], [], [], [])
    for k, doc in enumerate(docs):
        own = np.append(ids[at[k] : at[k + 1]], np.uint32(END)).astype("<u4")
        for piece, start in enumerate(range(0, len(own), CAPACITY)):
            part = own[start : start + CAPACITY]
            for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _PIECE_TYPE, strict=True)], names=[f.name for f in _PIECE_TYPE])


def best_fit(lengths: np.ndarray) -> np.ndarray:
    """The bin of each item, best-fit decreasing, bins of CAPACITY; ties go to the bin that got that room last."""
    bins = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
    free, made = 0, 0  # bit r of free: some bin has room for r more
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := free >> n:
            room = n + (fits & -fits).bit_length() - 1
            own = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            own, room, made = made, CAPACITY, made + 1
        bins[i] = own
        if room > n:
            open_bins[room - n].append(own)
            free |= 1 << (room - n)
    return bins


def _packed(fill: np.ndarray, values: pa.Array, counts: np.ndarray, serial: int) -> pa.RecordBatch:
    """Bins of items; item i has the next counts[i] of values."""
    own = best_fit(fill)
    order = np.argsort(own, kind="stable")
    at = np.zeros(len(fill) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    n = counts[order]
    before = np.cumsum(n) - n
    rows = np.arange(n.sum()) + np.repeat(at[:-1][order] - before, n)
    size = np.bincount(own, weights=counts).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    total = np.bincount(own, weights=fill).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(serial + np.arange(len(size))), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(rows)))], names=["sequence_id", "fill", "pieces"])


def _packer(level: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = (level << 58) + (TaskContext.get().partitionId() << 36)
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if level == 0:
                values = pa.StructArray.from_arrays([table.column(f.name).combine_chunks().cast(f.type) for f in _PIECE_TYPE], fields=list(_PIECE_TYPE))
                fill, counts = table.column("length").to_numpy(), np.ones(len(table), np.int64)
            else:
                lists = table.column("pieces").combine_chunks()
                values, counts, fill = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64), table.column("fill").to_numpy()
            got = _packed(fill, values, counts, serial)
            serial += got.num_rows
            for k in range(0, got.num_rows, 10_000):
                yield got.slice(k, 10_000)

        for b in batches:
            for k in range(0, b.num_rows, 10_000):
                held.append(b.slice(k, 10_000))
                if sum(x.num_rows for x in held) >= TASK_ITEMS:
                    yield from out()
        if held:
            yield from out()

    return pack


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids, then END; null and empty texts are END alone. Only documents longer than CAPACITY are cut.
    Texts of any length are whole; of bins that fit equally well the one that got that room last takes an item. Repeated rows are packed once
    each, a null doc_id stays null, extra columns are not read, an empty table gives an empty table.
    path: the tokenizer's file.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(docs.mapInArrow(_cutter(path), _PIECE), "pieces")
    level = 0
    bins = scratch.keep(pieces.mapInArrow(_packer(0), _BIN), "bins0")
    done, before = [], None
    while True:
        full = F.col("fill") >= CAPACITY - SLACK
        left = bins.where(~full)
        n = left.count()
        if n == 0 or n == before or level >= 30:
            done.append(bins)
            break
        done.append(bins.where(full))
        level, before = level + 1, n
        tasks = -(-n // TASK_ITEMS)
        bins = scratch.keep(left.coalesce(tasks).mapInArrow(_packer(level), _BIN), f"bins{level}")
        if tasks == 1:
            done.append(bins)
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    offsets = "transform(pieces, (p, i) -> named_struct('p', p, 'offset', aggregate(slice(pieces, 1, i), 0L, (s, x) -> s + x.length)))"
    return out.select("sequence_id", F.explode(F.expr(offsets)).alias("e")).select("e.p.*", "sequence_id", F.col("e.offset").alias("offset"))
