"""The quality report: counts and rates over review records, in one pass of grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.shapes import direction
from maskwright.plans.groups import dealt

KINDS = ("missed", "false_mask", "boundary", "type")


def census(tokened: DataFrame) -> DataFrame:
    """(entity_type, detector, n, docs): masks by type and detector, with both subtotals and the total (nulls).

    Documents are told apart by flags: a row is the first of its document, of a type in it, of a
    detector, or of both. So rows are shuffled once, by document, and only counts go into the cube. A
    null document isn't counted as one.
    """
    first = lambda by, order: ((F.row_number().over(Window.partitionBy("doc_id", *by).orderBy(*order)) == 1) & F.col("doc_id").isNotNull()).cast("long")
    own = dealt(tokened.select("doc_id", "entity_type", "detector"), "doc_id")
    flags = {"_both": (("entity_type", "detector"), ("doc_id",)), "_type": (("entity_type",), ("detector",)), "_all": ((), ("entity_type", "detector")), "_detector": (("detector",), ("entity_type",))}
    for name, (by, order) in flags.items():
        own = own.withColumn(name, first(by, order))
    counted = own.groupBy("entity_type", "detector").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in flags])
    docs = F.when(F.grouping_id() == 0, F.sum("_both")).when(F.grouping_id() == 1, F.sum("_type")).when(F.grouping_id() == 2, F.sum("_detector")).otherwise(F.sum("_all"))
    return counted.cube("entity_type", "detector").agg(F.sum("n").alias("n"), docs.alias("docs"))


def metrics(counted: DataFrame) -> DataFrame:
    """counted (masks, missed, false_mask, boundary, type_error) with precision, recall, boundary and type rates in percent; null over nothing."""
    pct = lambda a, b: F.round(100.0 * a / F.nullif(b, F.lit(0)), 2)
    right = F.col("masks") - F.col("false_mask")
    return (
        counted.withColumn("precision", pct(right, F.col("masks")))
        .withColumn("recall", pct(right, right + F.col("missed")))
        .withColumn("boundary_rate", pct(F.col("boundary"), F.col("masks")))
        .withColumn("type_error_rate", pct(F.col("type_error"), F.col("masks")))
    )


def build_report(records: DataFrame, masks: DataFrame) -> DataFrame:
    """Per (entity_type), per (detector) and in all: masks, records by kind, and rates.

    records: kind, entity_type, detector. masks: entity_type, detector. ``section`` names the
    grouping: type, detector or total.
    """
    both = masks.select("entity_type", "detector", F.lit("mask").alias("kind")).unionByName(records.select("entity_type", "detector", "kind"))
    both.createOrReplaceTempView("_report_rows")
    n = lambda k: f"count_if(kind = '{k}')"
    grouped = both.sparkSession.sql(
        f"""select case grouping_id(entity_type, detector) when 1 then 'type' when 2 then 'detector' else 'total' end as section,
                   coalesce(entity_type, detector) as key, {n("mask")} as masks, {n("missed")} as missed, {n("false_mask")} as false_mask, {n("boundary")} as boundary, {n("type")} as type_error
            from _report_rows group by grouping sets ((entity_type), (detector), ())"""
    )
    return metrics(grouped)


def findings(records: DataFrame) -> DataFrame:
    """(kind, entity_type, direction, n): what was corrected and which way."""
    way = F.when(F.col("kind") == "boundary", direction(F.col("old_length"), F.col("new_length")))
    return records.withColumn("direction", way).groupBy("kind", "entity_type", "direction").agg(F.count(F.lit(1)).alias("n"))


def unexpected_strings(report: DataFrame, allowed: DataFrame) -> DataFrame:
    """Strings of a report that aren't among the allowed values; a report may hold none."""
    texts = [F.col(f.name) for f in report.schema if f.dataType.simpleString() == "string"]
    return report.select(F.explode(F.array(*texts)).alias("value")).where("value is not null").distinct().join(allowed.select("value"), "value", "left_anti")
