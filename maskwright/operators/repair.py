"""Values torn by layout: line ends, tabs and typographic spaces inside a word or a number.

A second pass over healed texts that only adds: a value counts if it covers a healed place, overlaps
nothing that was found before, and, where it was put together from numbers, has its control digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.plans.rules import RULES, Rule

from .normalize import source_end, source_start, with_view
from .patterns import detect_patterns
from .resolve import overlaps

# ----- fixed values ------------------------------------------------------------------------------
BREAKS = "\n\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SPREAD_LETTERS = 4
# ----- end of the fixed values -------------------------------------------------------------------

_RUN = re.compile(f"[{BREAKS} ]*[{BREAKS}][{BREAKS} ]*")
_SPREAD = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){" + str(SPREAD_LETTERS - 1) + r",}(?!\S)")


def same_token(left: str, right: str) -> bool:
    """Number goes on with number, and a word with a word unless a capital begins a new one."""
    if left.isdigit() or right.isdigit():
        return left.isdigit() and right.isdigit()
    return left.isalpha() and right.isalpha() and not (left.islower() and right.isupper())


def heal(text: str) -> tuple[str, list[int], list[int]]:
    """(healed, map to the source, healed places): breaks between parts of one token go; two line ends in a row stay."""
    drop: set[int] = set()
    for m in _RUN.finditer(text):
        a, b = m.span()
        if 0 < a and b < len(text) and m[0].count("\n") < 2 and same_token(text[a - 1], text[b]):
            drop.update(range(a, b))
    for m in _SPREAD.finditer(text):
        drop.update(i for i in range(*m.span()) if text[i] == " ")
    at = [i for i in range(len(text)) if i not in drop]
    return "".join(text[i] for i in at), at, [k for k in range(1, len(at)) if at[k] - at[k - 1] > 1]


def torn_word(left: str, right: str) -> bool:
    """Whether the seam between two segments tears one word."""
    return bool(left and right) and left[-1].isalpha() and right[0].isalpha() and same_token(left[-1], right[0])


def _heal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        healed = [heal(t or "") for t in batch.column("text").to_pylist()]
        extra = [pa.array([h[0] for h in healed], pa.string()), pa.array([h[1] for h in healed], pa.list_(pa.int32())), pa.array([h[2] for h in healed], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "healed", "hmap", "seams"])


def repair(segments: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Further entities of segments (doc_id, seg_ord, text), none of which overlaps one of ``found``."""
    torn = segments.select("doc_id", "seg_ord", "text").where(F.col("text").rlike(f"[{BREAKS}]") | F.col("text").rlike(r"(?U)(?<!\S)\p{L}(?: \p{L}){3,}(?!\S)"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in torn.schema)
    healed = torn.mapInArrow(_heal_batches, f"{schema}, healed string, hmap array<int>, seams array<int>").where(F.size("seams") > 0)
    views = with_view(healed.withColumnRenamed("text", "source").withColumnRenamed("healed", "text"))
    hits = detect_patterns(views, rules)
    maps = healed.select("doc_id", "seg_ord", F.col("text").alias("source"), "hmap", "seams")
    joined = hits.join(maps, ["doc_id", "seg_ord"]).where(F.exists("seams", lambda s: (s > F.col("start")) & (s < F.col("end"))))
    start, end = source_start(F.col("start"), F.col("hmap")), source_end(F.col("end"), F.col("hmap"))
    out = joined.select(
        "doc_id", "seg_ord", (F.col("ent_seq") + 500_000_000).alias("ent_seq"), start.alias("start"), end.alias("end"), F.substring(F.col("source"), start + 1, end - start).alias("original_text"), "entity_type", "detector", "confidence"
    )
    before = found.select("doc_id", "seg_ord", F.col("start").alias("fs"), F.col("end").alias("fe"))
    return out.join(before, (out.doc_id == before.doc_id) & (out.seg_ord == before.seg_ord) & overlaps(out.start, out.end, F.col("fs"), F.col("fe")), "left_anti")
