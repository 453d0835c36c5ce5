"""Operator 1: mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Each source's documents are shuffled by a hash and queue up one after the other, pass after pass
(up to ``max_repeats`` passes). A document's virtual finish time is the number of its source's
words up to its own end, divided by the source's target. Taking documents in the order of their
finish times serves every source in proportion to its target; the mix ends where the budget (the
words of all documents) is spent.

Nothing here needs one task to see all documents, or all of one source. The running sums go in two
steps: sums of ranges of the shuffle hash (or of the finish time), which are few, then sums within
one range. The cut is one tuple, and per source it comes down to a number of whole passes and one
last shuffle key, so the documents' texts are never shuffled.

Nulls: a null text has no words; a null source is a source of its own, ordered last; a null doc_id
sorts before all others. Documents without words are free: they are taken once, from any source.
Rows that repeat each other wholly are taken or left together. An empty table gives an empty mix.
Extra columns are kept; names that begin with ``_mix_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, n_words

#: Ranges of the shuffle hash in each source, and of the finish time from 0 to 1.
HASH_RANGES, TIME_RANGES = 1 << 10, 1 << 12
LOWEST = -(1 << 63)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size -> also place (order by code point, null last), weight and target.

    The words of all sources are shared by weight; a share stops at ``max_repeats`` times the
    source's size and the excess goes to the others. In the order of cap / weight, a source is
    capped if the level reached without the ones capped before it is at or above its own cap.
    The table has one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(rest))
        .withColumn("capped", whole("left") * whole("weight") >= whole("cap") * whole("rest"))
    )
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    free_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free_words.cast("double") * F.col("weight") / free_weight)
    return capped.select("source", "source_size", "place", "weight", target.alias("target"))


def shuffle_key(doc_id: Column, text_hash: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), doc_id).alias("_mix_h"), F.coalesce(doc_id, F.lit(LOWEST)).alias("_mix_doc"), text_hash.alias("_mix_text")]


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sized, plan) of documents with doc_id, text, source.

    sized: a narrow row per document (doc_id, source, size and its shuffle key). plan: a row per
    source with source_size, target, the whole passes taken, and the last key of the pass that is
    cut (null: none of it).
    """
    sized = materialize(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *shuffle_key(F.col("doc_id"), F.xxhash64("text"), seed)),
        "mix-sized",
    ).withColumn("_mix_range", F.shiftright("_mix_h", 64 - HASH_RANGES.bit_length() + 1))
    ranges = materialize(sized.groupBy("source", "_mix_range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    sources = materialize(source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_repeats), "mix-sources")
    before = Window.partitionBy("source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    offsets = offsets.select(F.col("source").alias("_o_source"), F.col("_mix_range").alias("_o_range"), "offset").join(
        bounded(sources), F.col("_o_source").eqNullSafe(F.col("source"))
    ).drop("source", "weight")
    key = ["_mix_h", "_mix_doc", "_mix_text"]
    within = Window.partitionBy("source", "_mix_range").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = (
        sized.withColumn("_upto", F.sum("size").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("_o_source")) & (F.col("_mix_range") == F.col("_o_range")))
        .withColumn("_upto", F.col("_upto") + F.col("offset"))
        .where("size > 0")
    )
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("_pass")
    finish = (F.col("_pass") * F.col("source_size") + F.col("_upto")) / F.col("target")
    served = materialize(
        queued.select("size", "place", *key, "source_size", "target", "_upto", passes)
        .select("size", "place", *key, "_pass", finish.alias("finish"))
        .withColumn("slot", F.least(F.floor(F.col("finish") * TIME_RANGES), F.lit(2 * TIME_RANGES)).cast("int")),
        "mix-served",
    )
    slots = served.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("upto", F.sum("slot_size").over(Window.orderBy("slot")))
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    crossing = slots.where(F.col("upto") > budget).orderBy("slot").first()
    order = ["finish", "place", *key, "_pass"]
    cut = None
    if crossing is not None:
        inside = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        taken = (
            served.where(F.col("slot") == crossing["slot"])
            .withColumn("upto", F.sum("size").over(inside) + F.lit(crossing["upto"] - crossing["slot_size"]))
            .where(F.col("upto") <= budget)
        )
        cut = taken.orderBy(*[F.col(c).desc() for c in order]).first()
    if crossing is None:
        kept = served
    elif cut is None:
        kept = served.where(F.col("slot") < crossing["slot"])
    else:
        kept = served.where((F.col("slot") < crossing["slot"]) | ((F.col("slot") == crossing["slot"]) & (F.struct(*order) <= F.struct(*[F.lit(cut[c]).cast(served.schema[c].dataType) for c in order]))))
    last = kept.groupBy("place", "_pass").agg(F.max(F.struct(*key)).alias("_last"), F.sum("size").alias("_words"))
    last = last.join(bounded(sources.select("place", "source_size")), "place")
    ends = last.groupBy("place").agg(
        F.count(F.when(F.col("_words") == F.col("source_size"), 1)).cast("int").alias("_full"),
        F.max(F.when(F.col("_words") < F.col("source_size"), F.col("_last"))).alias("_last"),
    )
    plan = sources.join(ends, "place", "left").select("source", "source_size", "target", F.coalesce("_full", F.lit(0)).alias("_mix_full"), F.col("_last").alias("_mix_last"))
    return sized, materialize(plan, "mix-plan")


def with_copies(keyed: DataFrame, plan: DataFrame, size: Column) -> DataFrame:
    """keyed (source and the three key columns) with source_size, target and copies, the times that the mix takes a row."""
    plan = bounded(plan.withColumnRenamed("source", "_mix_source"))
    past = F.coalesce(F.struct("_mix_h", "_mix_doc", "_mix_text") <= F.col("_mix_last"), F.lit(False))
    copies = F.when(size == 0, F.lit(1)).otherwise(F.col("_mix_full") + past.cast("int"))
    return keyed.join(plan, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("copies", copies)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as the mix takes it."""
    _, plan = mix_plan(docs, weights, max_repeats, seed)
    names = docs.columns
    keyed = docs.select(*names, *shuffle_key(F.col("doc_id"), F.xxhash64("text"), seed))
    no_words = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), 1).otherwise(0)
    copied = with_copies(keyed, plan, no_words).where("copies > 0")
    return copied.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)


def mix_shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) of every document."""
    sized, plan = mix_plan(docs, weights, max_repeats, seed)
    return with_copies(sized, plan, F.col("size")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
