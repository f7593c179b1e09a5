"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words (white space apart, lower case) weighted by how often they occur. For each of SAMPLES
samples, every term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; with t = floor(ln w / r + b) its value is
ln c - r (t - b + 1), and the sample is the (term, t) of the smallest value. Two documents agree in a sample with a
probability equal to their generalised Jaccard similarity, sum of smaller over sum of larger weights.

Rows are dealt once, by ranges of doc_id; the window that finds the next document, the counts of terms and the minima
over terms all use that dealing, so texts cross the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._spark import Scratch

SAMPLES = 32
#: About so many documents are in one range of ids; ids are dealt by COARSE quantiles, and evenly within them.
RANGE_ROWS, COARSE = 256, 256
#: Ranges whose order one task finds; about a millionth of the documents, at RANGE_ROWS each, are left for the last step.
SPAN = 4096
_UNIT = float(2**-21)


def _uniform(h: str, slot: int) -> str:
    return f"(((shiftrightunsigned({h}, {21 * slot}) & 2097151L) + 0.5D) * {_UNIT!r}D)"


def _sample(k: int) -> Column:
    """The smallest value of sample k over a group's terms, packed above 32 bits of the hash of its (term, t)."""
    g, h = f"xxhash64(term, {2 * k}L)", f"xxhash64(term, {2 * k + 1}L)"
    r = f"(-ln({_uniform(g, 0)} * {_uniform(g, 1)}))"
    c = f"(-ln({_uniform(h, 0)} * {_uniform(h, 1)}))"
    b = _uniform(g, 2)
    t = f"floor(weight / {r} + {b})"
    value = f"(ln({c}) - {r} * ({t} - {b} + 1D))"
    packed = f"shiftleft(cast(least(greatest(({value} + 96D) * 16777216D, 0D), 2147483647D) as bigint), 32) | (xxhash64(term, {t}) & 4294967295L)"
    return F.expr(f"min({packed})").alias(f"s{k}")


def _ranged(docs: DataFrame) -> DataFrame:
    """docs with `range`: greater for greater ids; null ids have those under 0, the greater the smaller the hash of the text."""
    facts = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE + 1)], 10000).alias("cuts")).first()
    cuts = sorted(set(facts["cuts"] or []))
    pieces = max(1, round(facts["nulls"] / RANGE_ROWS))
    place = (F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * pieces
    without = -1 - F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(pieces - 1))
    if not cuts:
        return docs.withColumn("range", without)
    parts = max(1, round(facts["n"] / RANGE_ROWS / len(cuts)))
    lows = F.array(*[F.lit(x).cast("long") for x in cuts])
    k = F.greatest(F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(lows, k), F.element_at(lows, F.least(k + 1, F.lit(len(cuts))))
    share = (F.col("doc_id") - low).cast("double") / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    inside = F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))
    return docs.withColumn("range", F.when(F.col("doc_id").isNull(), without).otherwise(k.cast("long") * parts + inside))


def _heads(heads: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """heads (range, head) -> (range, head of the range that follows it; the greatest range follows the last)."""
    heads = scratch.keep(heads, f"{name}_own")
    # Which range follows is found on the ranges' numbers alone, within spans of them, and over the spans' first ranges.
    top = heads.agg(F.max("range")).first()[0]
    spans = heads.select("range", F.floor(F.col("range") / SPAN).alias("span"))
    firsts = spans.groupBy("span").agg(F.max("range").alias("first"))
    firsts = firsts.select("span", F.coalesce(F.lead("first").over(W.orderBy(F.desc("span"))), F.lit(top).cast("long")).alias("beyond"))
    own = F.lead("range").over(W.partitionBy("span").orderBy(F.desc("range")))
    follows = spans.withColumn("own", own).join(firsts, "span").select("range", F.coalesce("own", "beyond").alias("after"))
    return scratch.keep(follows.join(heads.select(F.col("range").alias("after"), "head"), "after").select("range", "head"), name)


def _drawn(rows: DataFrame) -> DataFrame:
    """(range, place, side, samples) of the texts (side 0) and the edited texts (side 1) that have a word."""
    sides = rows.select("range", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("e"))
    words = sides.select("range", "place", "e.side", F.explode(F.split(F.lower("e.t"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    terms = words.groupBy("range", "place", "side", F.xxhash64("word").alias("term")).agg(F.ln(F.count("*").cast("double")).alias("weight"))
    drawn = terms.groupBy("range", "place", "side").agg(*[_sample(k) for k in range(SAMPLES)])
    return drawn.select("range", "place", "side", F.array(*[f"s{k}" for k in range(SAMPLES)]).alias("samples"))


def _likeness(a: str, b: str) -> Column:
    """Share of agreeing samples; texts without terms are alike, and unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(SAMPLES)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def _shown(samples: str) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(4294967295))), 8, "0"))), "")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document by
    descending doc_id; the first document follows the last. Null texts are empty; texts without words have an empty
    fingerprint. Equal ids are ordered by a hash of their texts, null ids come last; repeated rows are rows of their own.
    A single document is its own next one. Texts of any length are whole. Extra columns are not read; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    ranged = _ranged(docs)
    order = [F.desc("doc_id"), F.xxhash64("text")]
    first = F.min_by("text", F.struct(F.col("doc_id").isNull(), -F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")))
    heads = _heads(ranged.groupBy("range").agg(first.alias("head")), scratch, "heads")

    inside = W.partitionBy("range").orderBy(*order)
    rows = ranged.select("range", "doc_id", "text", F.row_number().over(inside).alias("place"), F.lead("text").over(inside).alias("following"))
    rows = rows.join(heads, "range").withColumn("n_chars", F.length("text").cast("long"))
    third = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.coalesce("following", "head"), F.lit(1), third))
    rows = rows.select("range", "place", "doc_id", "text", "n_chars", edited.alias("edited"))
    facts = rows.select("range", "place", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    pivot = _drawn(rows).groupBy("range", "place").agg(*[F.max(F.when(F.col("side") == k, F.col("samples"))).alias(c) for k, c in enumerate(("own", "changed"))])
    empty = F.expr("cast(array() as array<bigint>)")
    known = facts.join(pivot, ["range", "place"], "left").withColumns({c: F.coalesce(c, empty) for c in ("own", "changed")})
    known = scratch.keep(known, "known")

    heads = _heads(known.where("place = 1").select("range", F.col("own").alias("head")), scratch, "samples")
    out = known.withColumn("following", F.lead("own").over(W.partitionBy("range").orderBy("place"))).join(heads, "range")
    out = out.withColumn("next_own", F.coalesce("following", "head"))
    return out.select("doc_id", "n_chars", "edited_sha256", _shown("own").alias("fingerprint"), _shown("changed").alias("edited_fingerprint"), _likeness("own", "changed").alias("near_edited"), _likeness("own", "next_own").alias("near_next"))
