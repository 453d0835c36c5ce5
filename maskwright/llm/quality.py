"""Operator 2: quality rules whose thresholds adapt to each language and source.

Four base counts are taken from every whole text. Rates made of them go into quantile sketches, one
per (lang, source) and rate: a sketch is a table of (bucket, count) rows, where a bucket spans 1/32
of its lower bound at most. Sketches merge by adding counts, in any order and with the same result,
so they are built map-side, re-used for coarser groups, and can be kept and added to. A document
fails where a rate lies beyond its group's fence, quartile plus ``reach`` times the distance of the
quartiles; groups of fewer than ``least_docs`` documents use the sketch of their language, and that
of all documents if the language has too few.

Defined results: a null text has no words and fails the base rule. Null lang or source is a group of
its own. Repeated rows are judged, and counted in the sketches, one by one. Extra columns pass
through ``keep_quality``; names beginning with ``_q_`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bounded, materialize, mix64, rolling, slices, space, trim

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: The rates: numerator, denominator, per how many, and the least width of the band beyond the
#: quartile; "low" also fails rates below the lower fence.
RATES = {
    "symbols": ("n_symbols", "n_words", 1000, 100, ()),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 500, ()),
    "repeats": ("n_repeat_words", "n_words", 1000, 250, ()),
    "word_length": ("word_chars", "n_words", 100, 300, ("low",)),
}


def _table(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


_SYMBOL = _table(SYMBOLS)


def base_counts(texts: pa.Array) -> np.ndarray:
    """(rows, 6): COUNTS of each text of a string column."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for at, to, data, bounds in slices(texts):
        words = Words(data, bounds)
        n = words.counts
        per_doc = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])
        rows = out[at:to]
        rows[:, 0], rows[:, 1] = n, per_doc(~space(data) & ((data & 0xC0) != 0x80))
        rows[:, 2] = per_doc(_SYMBOL[data])
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            rows[i, 3], rows[i, 5] = len(lines) - len(set(lines)), len(lines)
        doc = np.repeat(np.arange(to - at), n)
        windows = rolling(words.hashes(), WINDOW)
        if len(windows):
            own = doc[: len(windows)] == doc[WINDOW - 1 :]  # windows within one document
            where = np.flatnonzero(own)
            keys = windows[where] ^ mix64(doc[where].astype(np.uint64) + np.uint64(1))
            order = np.argsort(keys)
            same = keys[order[1:]] == keys[order[:-1]]
            twice = np.zeros(len(where), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(len(doc) + 1, np.int32)
            cover[where[twice]] += 1
            cover[where[twice] + WINDOW] -= 1
            rows[:, 4] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=to - at)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch], inside: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = base_counts(batch.column(inside).field("text") if inside else batch.column("text"))
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], names=[*keep, *COUNTS]
        )
        del batch, counts
    trim()


def with_counts(docs: DataFrame, inside: str | None = None) -> DataFrame:
    """docs with the base counts in place of text, or beside the struct ``inside`` that holds the text."""
    kept = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in docs.columns if n != "text"]
    return docs.mapInArrow(partial(_count_batches, inside=inside), ", ".join([*kept, *(f"{c} bigint" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rate(name: str) -> Column:
    """A rate as a whole number; 0 where there is nothing to divide by."""
    top, bottom, per, _, _ = RATES[name]
    return F.when(F.col(bottom) > 0, F.expr(f"({per} * {top}) div {bottom}")).otherwise(F.lit(0).cast("long"))


def bucket(x: Column) -> Column:
    """The lower bound of the sketch bucket of x: x's six leading binary digits, then zeros."""
    drop = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): the mergeable sketches of documents that pass the base rule."""
    rates = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), bucket(rate(name)).alias("bucket")) for name in RATES])).alias("r")
    return counted.where(~base_failed()).select("lang", "source", rates).groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, reach: int = 3, least_docs: int = 50) -> DataFrame:
    """lang, source and for each rate r its bounds r_low and r_high, one row per group.

    The quartiles are lower bounds of buckets. The merged sketches of a language and of all are
    sums of the same rows.
    """
    group = ["level", "lang", "source", "rate"]
    levels = (
        sketch.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n")
        .unionByName(sketch.select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rate", "bucket", "n"))
        .unionByName(sketch.select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rate", "bucket", "n"))
        .groupBy(*group, "bucket")
        .agg(F.sum("n").alias("n"))
    )
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = levels.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(Window.partitionBy(*group)))
    quartiles = ranked.groupBy(*group).agg(
        F.max("docs").alias("docs"),
        F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("docs"), F.col("bucket"))).alias("q3"),
    )
    band = F.greatest(reach * (F.col("q3") - F.col("q1")), F.create_map(*[F.lit(x) for k, v in RATES.items() for x in (k, v[3])])[F.col("rate")])
    bounds = quartiles.withColumn("high", F.col("q3") + band).withColumn("low", F.col("q1") - band)
    pick = [F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{name}_{side}") for name in RATES for side in ("low", "high")]
    wide = bounds.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *pick)
    names = [f"{name}_{side}" for name in RATES for side in ("low", "high")]
    wide = materialize(wide.select("level", "lang", "source", F.struct("docs", *names).alias("at")), "quality-levels")
    top = wide.where("level = 2").select("at.*").first()
    top = F.struct(*[F.lit(top[c] if top else None).cast("bigint").alias(c) for c in ("docs", *names)])
    own = wide.where("level = 0").select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), F.col("at").alias("own"))
    by_lang = wide.where("level = 1").select(F.col("lang").alias("_by_lang"), F.col("at").alias("lang_at"))
    joined = own.join(bounded(by_lang), F.col("_q_lang").eqNullSafe(F.col("_by_lang")), "left")
    best = F.when(F.col("own.docs") >= least_docs, F.col("own")).when(F.col("lang_at.docs") >= least_docs, F.col("lang_at")).otherwise(top)
    return joined.select("_q_lang", "_q_source", best.alias("_q")).select("_q_lang", "_q_source", "_q.*")


def within_fences() -> Column:
    """The method's verdict on a row joined with its group's fences."""
    good = F.lit(True)
    for name, (*_, sides) in RATES.items():
        good = good & (rate(name) <= F.col(f"{name}_high"))
        if "low" in sides:
            good = good & (rate(name) >= F.col(f"{name}_low"))
    return F.coalesce(good, F.lit(False))


def judged(docs: DataFrame, reach: int = 3, least_docs: int = 50) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and kept for every row of docs."""
    counted = materialize(with_counts(docs.select("doc_id", "lang", "source", "text")), "quality-counts")
    limits = bounded(materialize(fences(sketches(counted), reach, least_docs), "quality-fences"))
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source")), "left")
    return joined.select(*counted.columns, base_failed().alias("base_failed"), (~base_failed() & within_fences()).alias("kept"))


def keep_quality(docs: DataFrame, reach: int = 3, least_docs: int = 50) -> DataFrame:
    """docs without the rows that fail, whole texts and all columns kept."""
    counted = materialize(with_counts(docs.select("lang", "source", "text")), "quality-counts")
    limits = bounded(materialize(fences(sketches(counted), reach, least_docs), "quality-fences"))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[n] for n in names]).alias("_q_row"))
    rated = with_counts(rows, "_q_row").where(~base_failed())
    joined = rated.join(limits, F.col("_q_row.lang").eqNullSafe(F.col("_q_lang")) & F.col("_q_row.source").eqNullSafe(F.col("_q_source")))
    return joined.where(within_fences()).select("_q_row.*")
