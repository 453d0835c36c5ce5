"""Operator 6: homomorphic multiset fingerprints of documents (DataFrame operations only).

A fingerprint is a wide vector, the sum of vectors hashed from a document's paragraphs (its lines).
A paragraph's vector has three parts: the number of its phrases, EQUAL lanes hashed from the whole
paragraph, added modulo 2**62, and SIGNS lanes summed over its phrases (each ``PHRASE`` words of the
paragraph), added modulo 2**15, four lanes to a number. Sums don't depend on order, so documents with
the same paragraphs have the same fingerprint, and a paragraph goes in or out by adding or
subtracting its vector (``insert``, ``delete``) without the rest of the text.

Likeness: a sign lane counts the phrases whose hash has a 1 there, so twice the count less the number
of phrases is a random walk over the multiset. The mean product of two documents' walks estimates
how many phrases they share, the mean squares estimate their sizes; likeness is
2 * shared / (size + size), held to 0 .. 1, exactly 1 for equal fingerprints.

Defined results: a null text counts as empty, which is one empty paragraph. Repeated rows have their
own row. The next document of a row is the next in ascending doc_id, of rows that share a doc_id in
the order of their texts' hashes; null doc_ids come first; the last one's next is the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize

EQUAL, SIGNS, PHRASE = 3, 15, 4
LOW62 = (1 << 62) - 1
LANE_ONES = 1 | 1 << 15 | 1 << 30 | 1 << 45
LANE_TOPS = LANE_ONES << 14
LANE_REST = LANE_TOPS - LANE_ONES
#: Phrases that are summed without looking for a lane that is full.
BLOCK = 1 << 14
#: Width of the doc_id ranges in which next documents are looked up.
RANGE = 1 << 10

_PHRASES = rf"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){{1,{PHRASE}}}"


def _add_lanes(a: Column, b: Column) -> Column:
    """Four sums modulo 2**15 at once, no carry from one lane to the next."""
    return ((a.bitwiseAND(F.lit(LANE_REST))) + (b.bitwiseAND(F.lit(LANE_REST)))).bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(F.lit(LANE_TOPS)))


def _minus_lanes(a: Column) -> Column:
    """The negative of each lane: the complement, and one more."""
    return _add_lanes(a.bitwiseXOR(F.lit(LANE_REST | LANE_TOPS)), F.lit(LANE_ONES))


def _zeros(names: list[str]) -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(n) for n in names])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text: struct<phrases, e0.., s0..> of longs."""
    text = F.coalesce(text, F.lit(""))
    equal_names, sign_names = [f"e{k}" for k in range(EQUAL)], [f"s{j}" for j in range(SIGNS)]
    equal = F.aggregate(
        F.split(text, "\n", -1), _zeros(equal_names),
        lambda acc, p: F.struct(*[(acc[f"e{k}"] + F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(LOW62))).bitwiseAND(F.lit(LOW62)).alias(f"e{k}") for k in range(EQUAL)]),
    )
    hashes = F.transform(F.regexp_extract_all(text, F.lit(_PHRASES), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p)))
    one_block = lambda part: F.aggregate(
        part, _zeros(sign_names),
        lambda acc, h: F.struct(*[(acc[f"s{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANE_ONES))).alias(f"s{j}") for j in range(SIGNS)]),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(hashes) / BLOCK)), lambda b: one_block(F.slice(hashes, b.cast("int") * BLOCK + 1, BLOCK)))
    signs = F.aggregate(blocks, _zeros(sign_names), lambda acc, x: F.struct(*[_add_lanes(acc[f"s{j}"], x[f"s{j}"]).alias(f"s{j}") for j in range(SIGNS)]))
    return F.struct(F.size(hashes).cast("long").alias("phrases"), equal.alias("equal"), signs.alias("signs"))


def _lists(fp: Column) -> tuple[list[Column], list[Column]]:
    return [fp["equal"][f"e{k}"] for k in range(EQUAL)], [fp["signs"][f"s{j}"] for j in range(SIGNS)]


def _pack(phrases: Column, equal: list[Column], signs: list[Column]) -> Column:
    return F.struct(
        phrases.alias("phrases"), F.struct(*[e.alias(f"e{k}") for k, e in enumerate(equal)]).alias("equal"), F.struct(*[s.alias(f"s{j}") for j, s in enumerate(signs)]).alias("signs")
    )


def insert(fp: Column, paragraph_fp: Column) -> Column:
    """The fingerprint with a paragraph (or all paragraphs of another fingerprint) added."""
    (e, s), (pe, ps) = _lists(fp), _lists(paragraph_fp)
    return _pack(fp["phrases"] + paragraph_fp["phrases"], [(a + b).bitwiseAND(F.lit(LOW62)) for a, b in zip(e, pe, strict=True)], [_add_lanes(a, b) for a, b in zip(s, ps, strict=True)])


def delete(fp: Column, paragraph_fp: Column) -> Column:
    """The fingerprint with a paragraph taken out."""
    (e, s), (pe, ps) = _lists(fp), _lists(paragraph_fp)
    return _pack(fp["phrases"] - paragraph_fp["phrases"], [(a - b).bitwiseAND(F.lit(LOW62)) for a, b in zip(e, pe, strict=True)], [_add_lanes(a, _minus_lanes(b)) for a, b in zip(s, ps, strict=True)])


def to_hex(fp: Column) -> Column:
    equal, signs = _lists(fp)
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (fp["phrases"], *equal, *signs)]))


def _walks(fp: Column) -> Column:
    """The random walk of each lane: twice its count less the number of phrases, as a signed 16-bit number."""
    _, signs = _lists(fp)
    lanes = F.transform(F.array(*signs), lambda s: F.transform(F.array(*map(F.lit, (0, 15, 30, 45))), lambda k: F.call_function("shiftright", s, k).bitwiseAND(F.lit(0x7FFF))))
    return F.transform(F.flatten(lanes), lambda c: F.pmod(2 * c - fp["phrases"] + 32768, F.lit(65536)) - 32768)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints alone."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda acc, p: acc + p)
    x, y = _walks(a), _walks(b)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(2 * product(x, y), product(x, x) + product(y, y))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))


def previous_range(firsts: DataFrame) -> DataFrame:
    """(range, first) -> also before, the range that comes before it (the last one's for the first).

    Ranges are ordered in groups of 1024, then the groups, so no task orders more than its share.
    """
    of_group = firsts.withColumn("group", F.floor(F.col("range") / RANGE))
    within = Window.partitionBy("group").orderBy("range")
    lagged = of_group.withColumn("before", F.lag("range").over(within))
    groups = of_group.groupBy("group").agg(F.max("range").alias("last"))
    order = Window.orderBy("group")
    groups = groups.withColumn("last_before", F.coalesce(F.lag("last").over(order), F.last("last").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    return lagged.join(bounded(groups.drop("last")), "group").select("range", "first", F.coalesce("before", "last_before").alias("before"))


def with_next(rows: DataFrame, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """rows (doc_id, ...) with next_<value> of the row that is next in ascending doc_id.

    Rows fall into ranges of RANGE ids; the first row of each range also goes to the end of the
    range before it, so one shuffle brings every row and its next together.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = rows.withColumn("_range", F.floor(id_ / RANGE).cast("long")).withColumn("_id", id_)
    firsts = materialize(rows.groupBy(F.col("_range").alias("range")).agg(F.min("_id").alias("first")), "next-firsts")
    firsts = bounded(materialize(previous_range(firsts), "next-ranges").select(F.col("first").alias("_id"), "before"))
    twice = rows.join(firsts, "_id", "left").withColumn(
        "_place", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("tail")))).otherwise(
            F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("tail")), F.struct(F.col("before").alias("r"), F.lit(True).alias("tail")))))
    )
    window = Window.partitionBy("_place.r").orderBy("_place.tail", "_id", *order)
    out = twice.select("*", *[F.lead(v).over(window).alias(f"next_{v}") for v in values])
    return out.where(~F.col("_place.tail")).drop("_range", "_id", "before", "_place")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, edited (the text whose end is replaced by the next one's beginning), edited_fp and next_fp."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text")).withColumn("fp", fingerprint(F.col("text")))
    both = with_next(rows, ("_hash",), ("text", "fp"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return both.select("doc_id", "text", "fp", "next_fp", edited.alias("edited")).withColumn("edited_fp", fingerprint(F.col("edited")))
