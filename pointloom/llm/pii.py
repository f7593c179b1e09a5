"""Personal data: fixed formats, and identifiers found by bootstrapped contextual extraction.

One scan of the whole texts gives the spans of the fixed formats (email, ip, card, phone) and candidate identifiers with
their lexical patterns: the two words before a candidate and the signs that open it, and the signs that close it with the
word after. Seeds are the fixed-format entities and candidates in an unmistakable key format, each of its kind. Spark
scores the bipartite graph of patterns and instances for a few rounds, kind by kind: a pattern is as sure as the share of
sure instances it occurs with, an instance as sure as its patterns say together. Patterns that end with high confidence
discover the candidates they stand with, as spans of their kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ._spark import Scratch, blocks

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "key"
ROUNDS, SMOOTHING, LEAST_SEEDS, CONFIDENT = 3, 1.0, 3, 0.7
#: An identifier has so many characters at least; a context word of more than LONG is told by its hash.
LEAST, LONG = 6, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What marks a word as a candidate: a digit, an inner sign of identifiers, or a capital after a small letter.
_MARK = re.compile(r"[0-9]|[A-Za-z][_@#][A-Za-z]|[a-z][A-Z]")
_BLANK = re.compile(r"\s")
_OPENING, _CLOSING = "\"'`([{<=:", "\"'`)]}>,;:.!?|*&%$#"
_KEY_FORMAT = re.compile(r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}|(?=[A-Z0-9]*[0-9])[A-Z]{4}[A-Z0-9]{16}")
_NO_DIGITS = str.maketrans("0123456789", "0000000000")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        at, run, starts = m.start(), 0, []
        for part in parts:
            run = run + 1 if part else 0
            starts.append(at)
            at += len(part) + 1
            if run == 4:
                four = parts[len(starts) - 4 : len(starts)]
                if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in four)):
                    yield starts[-4], starts[-1] + len(part)
                run = 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.start(), m.end()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.start(), m.end()


_FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    return sorted((s, k, e) for k, find in enumerate(_FINDERS) for s, e in find(text))


def _context(word: str) -> str:
    return word if len(word) <= LONG else word[:8] + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _patterns(text: str, start: int, end: int, opening: str, closing: str) -> list[str]:
    """What is left and right of text[start:end]; a side without a word gives none."""
    size = 96
    while len(before := text[max(0, start - size) : start].split()) < 3 and size < start:
        size *= 4  # the first of three words may be cut, the last two are whole
    size = 48
    while len(after := text[end : end + size].split(None, 1)) < 2 and end + size < len(text):
        size *= 4
    out = []
    if before:
        out.append("< " + " ".join(map(_context, before[-2:])) + " " + opening)
    if after:
        out.append("> " + closing + " " + _context(after[0]))
    return [x.lower().translate(_NO_DIGITS) for x in out]


def _instance(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str], int, str | None, bool]]:
    """(start, end, patterns, instance, kind of a seed, base) of the base entities and of other marked words."""
    out = [(s, e, _patterns(text, s, e, "", ""), _instance(text[s:e]), KINDS[k], True) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    at = k = 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = gap.start() if (gap := _BLANK.search(text, m.end())) else len(text)
        at = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        word = text[start:end]
        core = word.lstrip(_OPENING).rstrip(_CLOSING)
        first = start + len(word) - len(word.lstrip(_OPENING))
        last = first + len(core)
        # A word that a base span covers is that span's; one that only holds such a span may be an identifier of its own.
        j, covered = k, False
        while j < len(taken) and taken[j][0] < end and not covered:
            s, e = taken[j]
            covered = s < first or e > last or 4 * (e - s) > 3 * len(core)
            j += 1
        if not covered and len(core) >= LEAST:
            out.append((first, last, _patterns(text, start, end, text[start:first], text[last:end]), _instance(core), DISCOVERED if _KEY_FORMAT.fullmatch(core) else None, False))
    return out


_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string())), ("instance", pa.int64()), ("seed", pa.string()), ("base", pa.bool_())])
_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("label", pa.string())])
_SCAN = (
    "row long, doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:int,rank:int,label:string>>, found array<struct<start:int,end:int,patterns:array<string>,instance:long,seed:string,base:boolean>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial = TaskContext.get().partitionId() << 40
    for b in blocks(batches, size=8 << 20):
        counts: list[list[int]] = [[], [], [], []]
        shas, spans, found = [], [], []
        for text in b.column("text").to_pylist():
            base = base_spans(text) if text else []
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base) if base else 0)
            labels = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
            shas.append(hashlib.sha256(",".join(labels).encode()).hexdigest())
            spans.append([{"start": s, "rank": k, "label": x} for (s, k, _), x in zip(base, labels, strict=True)])
            found.append([dict(zip(("start", "end", "patterns", "instance", "seed", "base"), c, strict=True)) for c in (candidates(text, base) if text else [])])
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([
            pa.array(range(serial, serial + n), pa.int64()), b.column("doc_id"), b.column("text_key"), *(pa.array(c, pa.int64()) for c in counts),
            pa.array(shas, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE)),
        ], names=["row", "doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"])
        serial += n


def score_patterns(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (pattern, instance, n, seed: a kind or null) -> (pattern, kind, sure) of the patterns that end confident."""
    totals = scratch.keep(edges.groupBy("pattern").agg(F.sum("n").alias("total")), "totals")
    seeds = edges.where("seed is not null").select("pattern", "instance", "n", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    score = seeds
    for k in range(ROUNDS):
        sums = score.groupBy("pattern", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("held"), F.sum((F.col("score") >= 0.5).cast("int")).alias("support"))
        patterns = sums.where(f"support >= {LEAST_SEEDS}").join(totals, "pattern").select("pattern", "kind", (F.col("held") / (F.col("total") + SMOOTHING)).alias("sure"))
        if k == ROUNDS - 1:
            best = patterns.where(f"sure >= {CONFIDENT}").groupBy("pattern").agg(F.max(F.struct("sure", "kind")).alias("best"))
            return best.select("pattern", "best.kind", "best.sure")
        patterns = scratch.keep(patterns, f"patterns{k}")
        told = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("sure")))))).alias("score"))
        every = edges.select("pattern", "instance", "n").join(told, "instance").select("pattern", "instance", "n", "kind", "score").union(seeds)
        score = scratch.keep(every.groupBy("pattern", "instance", "n", "kind").agg(F.max("score").alias("score")), f"score{k}")
    raise AssertionError


def _extracted(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    scanned = scratch.keep(rows.mapInArrow(_scan, _SCAN), "scanned")
    edges = scanned.select(F.inline("found")).select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    sure = score_patterns(scratch.keep(edges, "edges"), scratch)
    found = scanned.select("row", F.inline("found")).where("not base").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    found = found.join(sure, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("sure", "kind")).alias("kind"))
    rank = F.array_position(F.array(*[F.lit(x) for x in (*KINDS, DISCOVERED)]), F.col("kind")).cast("int") - 1
    label = F.concat_ws(":", F.col("kind"), F.col("start").cast("string"), F.col("end").cast("string"))
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), label.alias("label"))).alias("more"))
    out = scanned.drop("found").join(found, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,rank:int,label:string>>)"))))
    return out.withColumn("spans", F.array_join(F.transform(every, lambda s: s["label"]), ",")).withColumn("n_found", F.size(every).cast("long"))


def extract_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found; one row per row.

    spans: kind:start:end by start, then kind, in code points, end exclusive; n_found is their number. A null text is taken
    as empty: no spans, the hash of the empty string. Texts of any length are whole. Of patterns that are equally sure of a
    candidate, the kind that is last in the alphabet holds. Repeated rows count as often as they occur. Extra columns are
    not read. An empty table gives an empty table.
    """
    return _extracted(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by [KIND] and n_chars, where there is one, set anew; all rows, all columns.

    Columns of any other names are kept as they are.
    """
    spans = _extracted(docs).where("spans <> ''").groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans"))
    schema = T.StructType(list(docs.schema.fields))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("whole"))
    same = F.col("whole.doc_id").cast("long").eqNullSafe(spans["doc_id"]) & (F.xxhash64(F.col("whole.text").cast("string")) == spans["text_key"])
    marked = rows.join(spans, same, "left").select("whole", "spans")
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.column("whole").flatten())
            texts = [replaced(t, s) if s else t for t, s in zip(columns[at].to_pylist(), b.column("spans").to_pylist(), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = marked.mapInArrow(run, schema)
    if "n_chars" in schema.names:
        kind = schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*schema.names)
    return out


def replaced(text: str, spans: str) -> str:
    """text with its spans replaced; of overlapping spans the one that starts first names the whole."""
    out, at, name, until = [], 0, "", 0
    for span in spans.split(","):
        kind, start, end = span.split(":")
        start, end = int(start), int(end)
        if start >= until:
            if until:
                out.append(f"[{name.upper()}]")
            out.append(text[max(at, until) : start])
            name = kind
        until = max(until, end)
        at = until
    out.append(f"[{name.upper()}]" + text[until:])
    return "".join(out)
