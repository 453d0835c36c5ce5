"""The review loop: marks made by hand, spread over the document, and records that hold no value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.shapes import case_shape, token_shapes, whitelisted_context

from .resolve import overlaps
from .tokens import prefix_of


def literal_places(text: Column, value: Column) -> Column:
    """Starts of a literal value in a text, in order and without overlap."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    n = F.size(pieces) - 1
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda acc, p: acc + F.length(p)) + (i - 1) * F.length(value))
    return F.when(F.contains(text, value) & (value != "") & (n > 0), at).otherwise(F.array().cast("array<int>"))


def spread(marks: DataFrame, segments: DataFrame, occupied: DataFrame) -> DataFrame:
    """Further places of marked values in their documents: doc_id, mark_id, seg_ord, start, end, sorted by place.

    marks: doc_id, mark_id, seg_ord, start, value. A place counts where the value's word edges are
    word edges in the text, and nothing occupied (doc_id, seg_ord, start, end) overlaps it.
    """
    met = segments.select("doc_id", F.col("seg_ord").alias("at_seg"), "text").join(marks.select("doc_id", "mark_id", "value", F.col("seg_ord").alias("m_seg"), F.col("start").alias("m_start")), "doc_id").where(F.contains("text", F.col("value")))
    places = met.select("doc_id", "mark_id", "at_seg", "text", "value", "m_seg", "m_start", F.explode(literal_places(F.col("text"), F.col("value"))).alias("start"))
    places = places.withColumn("end", F.col("start") + F.length("value")).where(~((F.col("at_seg") == F.col("m_seg")) & (F.col("start") == F.col("m_start"))))
    word = r"(?U)\w"
    before, after = F.when(F.col("start") > 0, F.substring(F.col("text"), F.col("start"), F.lit(1))).otherwise(""), F.substring(F.col("text"), F.col("end") + 1, F.lit(1))
    edge = lambda inner, outer: ~(inner.rlike(word) & outer.rlike(word))
    good = places.where(edge(F.substring("value", 1, 1), before) & edge(F.expr("right(value, 1)"), after))
    o = occupied.select(F.col("doc_id").alias("od"), F.col("seg_ord").alias("oseg"), F.col("start").alias("os"), F.col("end").alias("oe"))
    free = good.join(o, (good.doc_id == o.od) & (good.at_seg == o.oseg) & overlaps(good.start, good.end, F.col("os"), F.col("oe")), "left_anti")
    return free.select("doc_id", "mark_id", F.col("at_seg").alias("seg_ord"), "start", "end")


def number_missed(missed: DataFrame, session: DataFrame) -> DataFrame:
    """missed (doc_id, seg_ord, start, entity_type, value) with tokens: a known value's own, else numbers from the prefix's highest on."""
    known = session.select("doc_id", F.col("original_text").alias("value"), "entity_type", F.col("token").alias("known"))
    prefix = F.regexp_extract("token", r"^\[([A-Z_]+)_\d+\]$", 1)
    top = session.select("doc_id", prefix.alias("prefix"), F.regexp_extract("token", r"_(\d+)\]$", 1).cast("int").alias("n")).groupBy("doc_id", "prefix").agg(F.max("n").alias("top"))
    values = missed.groupBy("doc_id", "entity_type", "value").agg(F.min(F.struct("seg_ord", "start")).alias("first")).withColumn("prefix", prefix_of(F.col("entity_type")))
    values = values.join(known, ["doc_id", "value", "entity_type"], "left").join(top, ["doc_id", "prefix"], "left")
    fresh = F.sum(F.col("known").isNull().cast("int")).over(Window.partitionBy("doc_id", "prefix").orderBy("first", "entity_type", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    token = F.coalesce("known", F.concat(F.lit("["), "prefix", F.lit("_"), (F.coalesce("top", F.lit(0)) + fresh).cast("string"), F.lit("]")))
    named = values.select("doc_id", "entity_type", "value", token.alias("token"))
    return missed.join(named, ["doc_id", "entity_type", "value"])


def apply_marks(tokened: DataFrame, marks: DataFrame, segments: DataFrame) -> DataFrame:
    """Tokened entities after false_mask, type and boundary marks, of which the last per place counts.

    A moved mask takes its value from the segment's text, so restoring gives back what it covers now.
    marks: doc_id, seg_ord, start, end, kind, created_at, new_type, new_start, new_end.
    """
    key = ["doc_id", "seg_ord", "start", "end"]
    last = marks.groupBy(*key).agg(F.max_by(F.struct("kind", "new_type", "new_start", "new_end"), "created_at").alias("m"))
    texts = segments.select("doc_id", "seg_ord", F.col("text").alias("_text"))
    joined = tokened.join(last, key, "left").join(texts, ["doc_id", "seg_ord"], "left").where(~F.coalesce(F.col("m.kind") == "false_mask", F.lit(False)))
    moved = F.col("m.kind") == "boundary"
    value = F.when(moved, F.substring(F.col("_text"), F.col("m.new_start") + 1, F.col("m.new_end") - F.col("m.new_start")))
    return joined.select(
        *[
            {"original_text": F.coalesce(value, F.col("original_text")).alias("original_text"), "entity_type": F.coalesce(F.when(F.col("m.kind") == "type", F.col("m.new_type")), F.col("entity_type")).alias("entity_type"), "start": F.coalesce(F.when(moved, F.col("m.new_start")), F.col("start")).alias("start"), "end": F.coalesce(F.when(moved, F.col("m.new_end")), F.col("end")).alias("end")}.get(c, F.col(c))
            for c in tokened.columns
        ]
    )


def touched(tokened: DataFrame, selections: DataFrame) -> DataFrame:
    """Masks that overlap a selection (doc_id, seg_ord, sel_start, sel_end)."""
    met = tokened.join(selections, ["doc_id", "seg_ord"])
    return met.where(overlaps(F.col("start"), F.col("end"), F.col("sel_start"), F.col("sel_end")))


def build_records(marks: DataFrame, segments: DataFrame) -> DataFrame:
    """marks (doc_id, seg_ord, start, end, kind, ...) with record: the shapes and the hidden context of the value, never the value."""
    joined = marks.join(segments.select("doc_id", "seg_ord", "text"), ["doc_id", "seg_ord"], "left")
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    record = F.struct(F.length(value).alias("length"), case_shape(value).alias("shape"), token_shapes(value).alias("tokens"), whitelisted_context(F.col("text"), F.col("start"), F.col("end")).alias("context"))
    return joined.withColumn("record", record).drop("text")
