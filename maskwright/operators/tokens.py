"""Token numbers, rendering and assembly, all as windows and aggregates.

One token stands for one group of a document (``group_key``) or, without a group, one text of one
type. Numbers run per prefix in the order in which groups first appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.plans.rules import BARRIERS, PREFIXES

TOKEN = r"\[[A-Z_]+_\d+\]"


def prefix_of(entity_type: Column) -> Column:
    """The token prefix of a type; an undeclared type is an error."""
    table = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, entity_type), F.raise_error(F.concat(F.lit("no token prefix for type "), entity_type)))


def assign_tokens(entities: DataFrame) -> DataFrame:
    """Maskable entities (doc_id, seg_ord, start, ...) with ``token``. Barriers are dropped.

    Groups, not rows, are numbered: the window orders one row per group and document.
    """
    kept = entities.where(~F.col("entity_type").isin(*BARRIERS))
    keyed = kept.withColumn("_key", F.coalesce(F.concat(F.lit("G:"), F.col("group_key")), F.concat(F.lit("T:"), F.col("original_text"))))
    group = ["doc_id", "entity_type", "_key"]
    firsts = keyed.groupBy(*group).agg(F.min(F.struct("seg_ord", "start")).alias("_first")).withColumn("_prefix", prefix_of(F.col("entity_type")))
    number = F.row_number().over(Window.partitionBy("doc_id", "_prefix").orderBy("_first", "entity_type", "_key"))
    named = firsts.select(*group, F.concat(F.lit("["), "_prefix", F.lit("_"), number.cast("string"), F.lit("]")).alias("token"))
    return keyed.join(named, group).drop("_key")


def render(text: Column, spans: Column) -> Column:
    """text with spans replaced; spans: array<struct<start, end, token>> without overlaps, any order."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["token"]).alias("out"))
    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def render_segments(segments: DataFrame, tokened: DataFrame) -> DataFrame:
    """segments with ``rendered``: the text with tokens for values."""
    spans = tokened.groupBy("doc_id", "seg_ord").agg(F.collect_list(F.struct("start", "end", "token")).alias("_spans"))
    joined = segments.join(spans, ["doc_id", "seg_ord"], "left")
    return joined.withColumn("rendered", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(render(F.col("text"), F.col("_spans")))).drop("_spans")


def assemble(segments: DataFrame, column: str = "rendered") -> DataFrame:
    """(doc_id, <column>): segments joined by line ends; runs of cells of one table become rows of cells joined by ' | '.

    A run of cells is an island: consecutive segments with one table_index. Needs doc_id, seg_ord
    and, for cells, table_index, row_index and col_index (null elsewhere).
    """
    names = segments.columns
    for c in ("table_index", "row_index", "col_index"):
        if c not in names:
            segments = segments.withColumn(c, F.lit(None).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("seg_ord")
    cell = F.col("table_index").isNotNull()
    fresh = F.when(cell & (F.lag("table_index").over(order).eqNullSafe(F.col("table_index"))), 0).otherwise(1)
    units = segments.withColumn("_unit", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.when(cell, F.translate(column, "\n", " ")).otherwise(F.col(column))
    rows = units.groupBy("doc_id", "_unit", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "seg_ord", text.alias("t")))), lambda s: s["t"]), " | ").alias("t"))
    blocks = rows.groupBy("doc_id", "_unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "t"))), lambda s: s["t"]), "\n").alias("t"))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_unit", "t"))), lambda s: s["t"]), "\n").alias(column))


def segment_offsets(segments: DataFrame) -> DataFrame:
    """segments (no tables) with ``offset``, where each begins in the assembled text."""
    before = Window.partitionBy("doc_id").orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
