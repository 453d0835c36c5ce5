"""Values back for tokens, in texts that came back from elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import TOKEN


def token_places(texts: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, place, token, before): tokens in order with the text before each; a last row has no token."""
    gaps, tokens = F.split(column, TOKEN, -1), F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))
    pieces = F.posexplode(F.arrays_zip(gaps.alias("before"), tokens.alias("token"))).alias("place", "p")
    return texts.where(F.col(column).isNotNull()).select("doc_id", pieces).select("doc_id", "place", F.col("p.token").alias("token"), F.col("p.before").alias("before"))


def restore(texts: DataFrame, session: DataFrame, mode: str = "canonical", column: str = "text") -> DataFrame:
    """(doc_id, restored, unresolved): values for tokens.

    session: doc_id, token, original_text, canonical, occurrences (array<string> of surfaces in
    document order). "canonical" puts the canonical form, or the first text; "original" the first
    text; "exact" the n-th surface for a token's n-th appearance, the last one for any beyond.
    Unknown tokens stay and are listed once each, in order of appearance.
    """
    if mode not in ("canonical", "original", "exact"):
        raise ValueError(f"unknown mode {mode}")
    nth = F.row_number().over(Window.partitionBy("doc_id", "token").orderBy("place"))
    places = token_places(texts, column).withColumn("nth", nth)
    found = places.join(session.select("doc_id", "token", "original_text", "canonical", "occurrences"), ["doc_id", "token"], "left")
    surfaces = F.col("occurrences")
    exact = F.when(F.size(surfaces) > 0, F.element_at(surfaces, F.least(F.col("nth"), F.size(surfaces)))).otherwise(F.col("original_text"))
    value = {"canonical": F.coalesce("canonical", "original_text"), "original": F.col("original_text"), "exact": F.coalesce(exact, F.col("original_text"))}[mode]
    piece = F.struct("place", F.concat("before", F.coalesce(value, F.col("token"), F.lit(""))).alias("t"))
    missing = F.when(F.col("token").isNotNull() & F.col("original_text").isNull(), F.struct("place", "token"))
    out = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).alias("ps"), F.array_sort(F.collect_list(missing)).alias("ms"))
    return out.select("doc_id", F.array_join(F.transform("ps", lambda p: p["t"]), "").alias("restored"), F.array_distinct(F.transform("ms", lambda m: m["token"])).alias("unresolved"))


def session_of(tokened: DataFrame) -> DataFrame:
    """(doc_id, token, entity_type, original_text, canonical, occurrences, n) from tokened entities, one row per token."""
    order = F.struct("seg_ord", "start")
    return tokened.groupBy("doc_id", "token").agg(
        F.min_by("entity_type", order).alias("entity_type"), F.min_by("original_text", order).alias("original_text"), F.min_by("canonical", order).alias("canonical"),
        F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "start", "original_text"))), lambda o: o["original_text"]).alias("occurrences"), F.count(F.lit(1)).alias("n"),
    )
