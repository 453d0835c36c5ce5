"""Windows across the seam of neighbouring segments, and the values that only show there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.plans.rules import RULES, Rule

from .multispan import value_hits
from .normalize import source_end, source_start, with_view
from .patterns import detect_patterns, pattern_hits

#: Fixed value: characters of a window on each side of the seam.
REACH = 60


def windows(segments: DataFrame) -> DataFrame:
    """Each segment with the next: tail, head, and the text between them, nothing inside one table row, else a line end.

    Neighbours are neighbours by position, so an empty segment breaks adjacency. One window function
    per document; needs doc_id, seg_ord, text and, for cells, table_index and row_index.
    """
    for c in ("table_index", "row_index"):
        if c not in segments.columns:
            segments = segments.withColumn(c, F.lit(None).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("seg_ord")
    nxt = {c: F.lead(c).over(order) for c in ("seg_ord", "text", "table_index", "row_index")}
    same_row = (nxt["table_index"] == F.col("table_index")) & (nxt["row_index"] == F.col("row_index"))
    paired = segments.select(
        "doc_id", "seg_ord", F.length("text").alias("tail_length"), F.expr(f"right(text, {REACH})").alias("tail"), nxt["seg_ord"].alias("next_ord"),
        F.substring(nxt["text"], 1, REACH).alias("head"), F.when(same_row, "").otherwise("\n").alias("sep"), F.coalesce(same_row, F.lit(False)).alias("same_row"),
    )
    whole = paired.where(F.col("next_ord").isNotNull() & (F.col("tail") != "") & (F.col("head") != ""))
    return whole.withColumn("text", F.concat("tail", "sep", "head"))


def boundary_entities(segments: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Values that cross a seam, as two entities, one in each segment: doc_id, seg_ord, ent_seq, start, end, original_text, entity_type, detector, confidence."""
    wins = windows(segments)
    views = with_view(wins)
    seams = views.where(F.length("sep") == 1).where(F.col("text").rlike(r"\d\D{0,3}\n\D{0,3}\d"))
    broken = seams.select(*wins.columns, "omap", F.explode(value_hits(F.col("norm"), seam=True)).alias("h"))
    broken = broken.select(*wins.columns, source_start(F.col("h.start")).alias("start"), source_end(F.col("h.end")).alias("end"), F.col("h.type").alias("type"))
    plain = views.select(*wins.columns, "omap", F.explode(pattern_hits(F.col("norm"), rules)).alias("h"))
    plain = plain.select(*wins.columns, source_start(F.col("h.start")).alias("start"), source_end(F.col("h.end")).alias("end"), F.col("h.type").alias("type"))
    n_tail = F.length("tail")
    crossing = plain.unionByName(broken).where((F.col("start") < n_tail) & (F.col("end") > n_tail + F.length("sep"))).distinct()
    shift = n_tail + F.length("sep")
    halves = F.explode(
        F.array(
            F.struct(F.col("seg_ord").alias("o"), (F.col("tail_length") - n_tail + F.col("start")).alias("s"), F.col("tail_length").alias("e"), F.substring(F.col("text"), F.col("start") + 1, n_tail - F.col("start")).alias("t"), F.lit(0).alias("k")),
            F.struct(F.col("next_ord").alias("o"), F.lit(0).alias("s"), (F.col("end") - shift).alias("e"), F.substring(F.col("text"), shift + 1, F.col("end") - shift).alias("t"), F.lit(1).alias("k")),
        )
    ).alias("h")
    split = crossing.select("doc_id", "type", "start", halves).where(F.trim("h.t") != "")
    return split.select(
        "doc_id", F.col("h.o").alias("seg_ord"), (F.lit(900_000_000) + F.col("start") * 2 + F.col("h.k")).cast("long").alias("ent_seq"), F.col("h.s").alias("start"), F.col("h.e").alias("end"), F.col("h.t").alias("original_text"),
        F.col("type").alias("entity_type"), F.lit("regex").alias("detector"), F.lit(1.0).alias("confidence"),
    )


def anchors_from_the_left_cell(segments: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Values in a cell whose anchor stands in the cell to its left: what is found with that cell's end as context and not without."""
    wins = windows(segments).where("same_row")
    nxt = segments.select("doc_id", F.col("seg_ord").alias("next_ord"), F.col("text").alias("next_text"))
    cells = wins.select("doc_id", "next_ord", "tail").join(nxt, ["doc_id", "next_ord"]).select("doc_id", F.col("next_ord").alias("seg_ord"), F.col("next_text").alias("text"), "tail")
    views = with_view(cells)
    anchored = tuple(r for r in rules if r.anchor)
    keys = ["doc_id", "seg_ord", "start", "end", "entity_type"]
    return detect_patterns(views, anchored, prefix=F.col("tail")).join(detect_patterns(views, anchored).select(*keys), keys, "left_anti")
