"""Conflicts between overlapping values: who wins, what is left of the loser, who comes back.

Segments without an overlap pass natively; a running maximum of ends finds the others, and only
their rows go segment by segment to the round-based resolver. Its state is one segment's values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from maskwright.plans.groups import dealt, in_batches, whole_groups
from maskwright.plans.rules import BARRIERS, NAME_RANK, PATTERN_RANK

TRIMMED = " \t\r\n"
#: What is left counts only if it has more than these.
SEPARATORS = TRIMMED + ",;.:|«»\"'()"
ENTITY = (
    "doc_id bigint, seg_ord int, ent_seq bigint, start int, end int, original_text string, entity_type string, detector string, confidence double, "
    "group_key string, canonical string"
)
SPANS = "array<struct<s:int,e:int>>"
SHADOW = "array<struct<start:int,end:int,original_text:string,entity_type:string,detector:string,confidence:double,group_key:string,canonical:string>>"
RESOLVED = f"{ENTITY}, spans {SPANS}, shadowed {SHADOW}"
_TYPES = [*(tuple(f.split(" ", 1)) for f in ENTITY.split(", ")), ("spans", SPANS)]
NAMES = [n for n, _ in _TYPES]


def as_entities(df: DataFrame) -> DataFrame:
    """df with the columns of an entity table; those it lacks are null. spans: the pieces of a value in several parts, else null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in _TYPES])


def entity_spans(entities: DataFrame) -> DataFrame:
    """entities with ``pieces``: spans where a value has several parts, else its one interval."""
    own = F.array(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e")))
    return entities.withColumn("pieces", F.coalesce("spans", own))


def _with_shadow(df: DataFrame) -> DataFrame:
    """An entity table with ``shadowed``, what a value has displaced so far."""
    columns = [(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in [*_TYPES, ("shadowed", SHADOW)]]
    return df.select(*columns)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters between two intervals, 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a_start, b_start) - F.least(a_end, b_end))


def in_conflict(entities: DataFrame) -> DataFrame:
    """entities with conflict, true in segments where any two overlap."""
    segment = Window.partitionBy("doc_id", "seg_ord")
    before = segment.orderBy("start", "end", "ent_seq").rowsBetween(Window.unboundedPreceding, -1)
    hit = (F.col("start") < F.max("end").over(before)) & (F.col("start") < F.col("end"))
    return entities.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("conflict", F.max("_hit").over(segment)).drop("_hit")


def _rank(order: tuple[str, ...], name: str) -> tuple:
    return (0, order.index(name)) if name in order else (1, name)


def _beats(a: dict, b: dict) -> bool:
    """Whether a, met first, holds against b. The order isn't transitive: an address beats a single-word person of any length."""
    if a["detector"] != b["detector"]:
        return a["detector"] == "regex"
    length = lambda e: e["end"] - e["start"]
    if a["detector"] == "regex":
        steps = [(-length(a), -length(b)), (_rank(PATTERN_RANK, a["entity_type"]), _rank(PATTERN_RANK, b["entity_type"]))]
    else:
        single = lambda e: e["entity_type"] == "PERSON" and not set(" .") & set(e["original_text"])
        for x, y, holds in ((a, b, True), (b, a, False)):
            if x["entity_type"] == "ADDRESS" and single(y):
                return holds
        steps = [(-length(a), -length(b)), (-a["confidence"], -b["confidence"])]
        if (a["start"], a["end"]) != (b["start"], b["end"]):
            steps += [(_rank(NAME_RANK, a["entity_type"]), _rank(NAME_RANK, b["entity_type"])), (a["start"], b["start"])]
    steps.append(((a["entity_type"], a["original_text"]), (b["entity_type"], b["original_text"])))
    return next((x < y for x, y in steps if x != y), True)


def _meet(a: dict, b: dict) -> bool:
    return max(a["start"], b["start"]) < min(a["end"], b["end"])


def _left_over(loser: dict, winner: dict) -> list[dict]:
    """Up to two pieces of the loser outside the winner, trimmed; they carry no group."""
    out = []
    for s, e in ((loser["start"], min(loser["end"], winner["start"])), (max(loser["start"], winner["end"]), loser["end"])):
        piece = loser["original_text"][s - loser["start"] : e - loser["start"]] if e > s else ""
        s += len(piece) - len(piece.lstrip(TRIMMED))
        piece = piece.strip(TRIMMED)
        if piece.strip(SEPARATORS):
            out.append(loser | {"start": s, "end": s + len(piece), "original_text": piece, "group_key": None, "canonical": None, "spans": None})
    return out


def settle(rows: list[dict]) -> list[dict]:
    """The values of one segment without overlaps, in no particular order. Rows come in the order of ent_seq."""
    pending, kept = [r | {"shadowed": r.get("shadowed") or []} for r in rows], []

    def clash() -> bool:
        high = None
        for r in sorted(pending, key=lambda r: r["start"]):
            if high is not None and r["start"] < min(high, r["end"]):
                return True
            high = r["end"] if high is None else max(high, r["end"])
        return False

    while clash():
        best = pending[0]
        for r in pending[1:]:
            best = best if _beats(best, r) else r
        losers = [r for r in pending if r is not best and _meet(r, best)]
        best["shadowed"] = [*best["shadowed"], *losers]
        kept.append(best)
        following = []
        for r in pending:
            if r is not best:
                following += [p | {"shadowed": list(r["shadowed"])} for p in _left_over(r, best)] if _meet(r, best) else [r]
        pending = following
    return kept + pending


_SHADOW_KEYS = ("start", "end", "original_text", "entity_type", "detector", "confidence", "group_key", "canonical")


def _settled(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The values of each segment of a sorted partition, without overlaps."""

    def rows(group: list[dict]) -> list[dict]:
        return [r | {"shadowed": [{k: s[k] for k in _SHADOW_KEYS} for s in r["shadowed"]] or None} for r in settle(group)]

    return in_batches(map(rows, whole_groups(batches, ("doc_id", "seg_ord"))), schema)


def resolve_overlaps(entities: DataFrame) -> DataFrame:
    """Entities without overlaps; winners carry what they displaced in ``shadowed``.

    A segment's values are handled together; they number as many as fit a paragraph. A task takes
    its segments one after the other from a sorted partition.
    """
    segment = ["doc_id", "seg_ord"]
    marked = in_conflict(_with_shadow(entities))
    calm = marked.where(~F.col("conflict")).drop("conflict")
    torn = dealt(marked.where("conflict").drop("conflict"), *segment).sortWithinPartitions(*segment, "ent_seq", "start", "end", "entity_type")
    return calm.unionByName(torn.mapInArrow(partial(_settled, schema=to_arrow_schema(torn.schema)), RESOLVED))


def suppressions(resolved: DataFrame) -> DataFrame:
    """Where a barrier won over a maskable type: doc_id, seg_ord, suppressed_type, suppressor_type, start, end of what they share."""
    lost = resolved.where(F.col("entity_type").isin(*BARRIERS)).select("doc_id", "seg_ord", F.col("entity_type").alias("suppressor_type"), F.col("start").alias("ws"), F.col("end").alias("we"), F.explode("shadowed").alias("l"))
    return lost.where(~F.col("l.entity_type").isin(*BARRIERS)).select(
        "doc_id", "seg_ord", F.col("l.entity_type").alias("suppressed_type"), "suppressor_type", F.greatest("ws", "l.start").alias("start"), F.least("we", "l.end").alias("end")
    )


def recover_shadowed(resolved: DataFrame, enabled: frozenset[str] | None) -> DataFrame:
    """The values to mask under a profile: enabled winners, and enabled values that a disabled winner had displaced.

    Barriers never open what they displaced. A value that comes back replaces its own left-overs and
    stays away where another mask stands; among those that come back the resolver decides.
    """
    maskable = resolved.where(~F.col("entity_type").isin(*BARRIERS))
    if enabled is None:
        return maskable
    on = F.col("entity_type").isin(*sorted(enabled))
    kept, off = maskable.where(on), maskable.where(~on)
    back = off.select("doc_id", "seg_ord", F.col("ent_seq").alias("winner_seq"), F.explode("shadowed").alias("s")).select("doc_id", "seg_ord", "winner_seq", "s.*")
    back = back.where(F.col("entity_type").isin(*sorted(enabled)) & ~F.col("entity_type").isin(*BARRIERS))
    back = back.groupBy("doc_id", "seg_ord", "start", "end", "entity_type").agg(
        F.min("winner_seq").alias("ent_seq"), *[F.min_by(c, "winner_seq").alias(c) for c in ("original_text", "detector", "confidence", "group_key", "canonical")]
    )
    key = ["doc_id", "seg_ord"]
    opened = off.select(*key, F.col("start").alias("os"), F.col("end").alias("oe"))
    back = back.join(opened, key).where(overlaps(F.col("start"), F.col("end"), F.col("os"), F.col("oe"))).drop("os", "oe").distinct()
    masks = kept.select(*key, F.col("start").alias("ms"), F.col("end").alias("me"))
    foreign = back.join(masks, key).where(overlaps(F.col("start"), F.col("end"), F.col("ms"), F.col("me")) & ~((F.col("ms") >= F.col("start")) & (F.col("me") <= F.col("end"))))
    back = back.join(foreign.select(*key, "start", "end", "entity_type").distinct(), [*key, "start", "end", "entity_type"], "left_anti")
    settled = resolve_overlaps(back)
    ours = back.select(*key, F.col("start").alias("bs"), F.col("end").alias("be"))
    replaced = kept.join(ours, key).where((F.col("start") >= F.col("bs")) & (F.col("end") <= F.col("be"))).select(*key, "start", "end", "entity_type").distinct()
    return kept.join(replaced, [*key, "start", "end", "entity_type"], "left_anti").unionByName(settled)
