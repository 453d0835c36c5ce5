"""Values that are written in several groups or broken by line ends, as column expressions.

Groups of digits with short gaps are islands, which one pattern finds whole. An island of 10 or 11
digits that begins with 7 or 8 is a phone; one that a line end breaks and that is exactly as long as
an account or registry number, with its control digit and its anchor, is that number, unless one side
of the break is a whole number by itself. Birth dates may be broken by line ends too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.binding import once
from maskwright.functions.checks import CHECKS
from maskwright.operators.normalize import DIGIT_LIKE, source_end, source_start
from maskwright.operators.patterns import has_anchor, occurrences
from maskwright.plans.rules import RULES

# ----- fixed values ------------------------------------------------------------------------------
PHONE_GAPS, LINE_GAPS, LONGEST_GAP = " \t()-–—+", " \t\n\r-–—", 3
PHONE_DIGITS = (10, 11)
BROKEN = {"BANK_ACCOUNT": (20,), "OGRN": (13, 15), "INN": (10,), "INN_PERSON": (12,), "SNILS": (11,)}
ANCHORS = {"SNILS": r"(?i)(?:снилс|страхов\w*\s+свидетельств\w*)"}
_BORN_DATE = r"(\d{1,2}[ \n]{0,2}[.\/][ \n]{0,2}\d{1,2}[ \n]{0,2}[.\/][ \n]{0,2}\d(?:[ \n]?\d){3})"
BORN = (
    r"(?i)(?:дат[аыу]\s*рожд[а-я]*|года?\s*рождения|рожд(?:ени[а-я]*|\.))[^\d]{0,12}" + _BORN_DATE + r"(?!\d)",
    r"(?i)" + _BORN_DATE + r"\s*(?:г\.\s?р\.|г\.\s?рожд)",
)
# ----- end of the fixed values -------------------------------------------------------------------

_LIKE = "".join(DIGIT_LIKE)
_DIGIT = f"[0-9{_LIKE}]"
#: A whole run of digits and letters that stand for digits, one real digit in it at least.
_GROUP = rf"(?<!{_DIGIT})(?=[{_LIKE}]*+[0-9]){_DIGIT}++"
_HITS = "array<struct<type:string,start:int,end:int,pieces:array<struct<s:int,e:int>>>>"
SPANS = "array<struct<s:int,e:int>>"


def _island(gaps: str) -> str:
    """A pattern of two groups or more; its groups are before, value and after, as ``occurrences`` needs."""
    gap = "[" + "".join(map(re.escape, gaps)) + f"]{{1,{LONGEST_GAP}}}"
    return f"()({_GROUP}(?:{gap}{_GROUP})+)()"


_PHONE, _LINES = _island(PHONE_GAPS), _island(LINE_GAPS)
_BORN = (BORN[0].replace(_BORN_DATE, f")({_BORN_DATE[1:-1]})(").replace("(?i)", "(?i)(", 1) + ")", BORN[1].replace("(?i)", "(?i)()", 1).replace(r"\s*(?:г", r"(\s*(?:г", 1) + ")")


def _digits(value: Column) -> Column:
    return F.translate(F.regexp_replace(value, f"[^0-9{_LIKE}]", ""), _LIKE, "".join(DIGIT_LIKE.values()))


def _pieces(value: Column, pattern: str, between: str, shift: Column) -> Column:
    """Places of the matches of ``pattern`` in a value that begins at ``shift``; ``between`` matches all that is between them."""

    def places(parts: Column) -> Column:
        start = lambda i: shift + F.length(F.array_join(F.slice(parts, 1, i), ""))
        place = lambda i: once(start(i), lambda s: F.struct(s.alias("s"), (s + F.length(F.get(parts, i))).alias("e")))
        return F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), place)

    return once(F.regexp_extract_all(value, F.lit(f"{pattern}|{between}"), F.lit(0)), places)


def _groups(m: Column) -> Column:
    return _pieces(m["value"], f"{_DIGIT}+", f"[^0-9{_LIKE}]+", m["m_start"])


def _hit(kind: Column, start: Column, end: Column, pieces: Column) -> Column:
    return F.struct(kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), pieces.cast(SPANS).alias("pieces"))


def _broken_kind(text: Column, start: Column, digits: Column, sides: Column) -> Column:
    """The type whose one whole value an island is; null for none."""

    def kind(type_: str, totals: tuple[int, ...]) -> Column:
        check = next((r.check for r in RULES if r.type == type_ and r.check), None)
        anchor = next((r.anchor for r in RULES if r.type == type_ and r.anchor), None) or ANCHORS[type_]
        whole = lambda d: F.length(d).isin(*totals) & (CHECKS[check](d) if check else F.lit(True))
        return F.when(whole(digits) & has_anchor(text, start, anchor) & ~F.exists(sides, whole), type_)

    return F.coalesce(*[kind(t, n) for t, n in BROKEN.items()])


def phones(text: Column) -> Column:
    fits = lambda m: once(_digits(m["value"]), lambda d: F.length(d).isin(*PHONE_DIGITS) & F.substring(d, 1, 1).isin("7", "8"))

    def hit(m: Column) -> Column:
        plus = F.when((m["m_start"] > 0) & (F.substring(text, m["m_start"], F.lit(1)) == "+"), 1).otherwise(0)
        first = lambda pieces: F.struct((F.get(pieces, 0)["s"] - plus).alias("s"), F.get(pieces, 0)["e"].alias("e"))
        shifted = once(_groups(m), lambda pieces: F.concat(F.array(first(pieces)), F.slice(pieces, F.lit(2), F.size(pieces))))
        return _hit(F.lit("PHONE"), m["m_start"] - plus, m["m_start"] + F.length(m["value"]), shifted)

    return F.transform(F.filter(occurrences(text, _PHONE), fits), hit)


def broken_numbers(text: Column) -> Column:
    at_line_end = F.filter(occurrences(text, _LINES), lambda m: F.contains(m["value"], F.lit("\n")))
    read = F.transform(at_line_end, lambda m: F.struct(m["m_start"].alias("m_start"), m["value"].alias("value"), _digits(m["value"]).alias("digits"), F.transform(F.split(m["value"], "\n"), _digits).alias("sides")))
    named = F.transform(read, lambda m: F.struct(m["m_start"].alias("m_start"), m["value"].alias("value"), _broken_kind(text, m["m_start"], m["digits"], m["sides"]).alias("type")))
    return F.transform(F.filter(named, lambda m: m["type"].isNotNull()), lambda m: _hit(m["type"], m["m_start"], m["m_start"] + F.length(m["value"]), _groups(m)))


def birth_dates(text: Column, broken_only: bool = True) -> Column:
    def of(pattern: str) -> Column:
        start = lambda m: m["m_start"] + F.length(m["before"])
        found = occurrences(text, pattern)
        found = F.filter(found, lambda m: F.contains(m["value"], F.lit("\n"))) if broken_only else found
        return F.transform(found, lambda m: _hit(F.lit("BIRTHDATE"), start(m), start(m) + F.length(m["value"]), _pieces(m["value"], r"[^\n\r \t](?:[^\n\r]*[^\n\r \t])?", r"[\n\r \t]+", start(m))))

    return F.concat(*map(of, _BORN))


def value_hits(text: Column, seam: bool = False) -> Column:
    """array<struct<type, start, end, pieces>> of a normalised text. seam: numbers and dates only, dates on one line too."""
    parts = [broken_numbers(text), birth_dates(text, broken_only=not seam)]
    return F.concat(*[p.cast(_HITS) for p in (parts if seam else [phones(text), *parts])])


def detect_multispan(views: DataFrame) -> DataFrame:
    """Entities with ``spans``, the places of their pieces, from views (doc_id, seg_ord, text, norm, omap).

    Only segments with digits on both sides of a gap are looked at further.
    """
    may = views.where(F.col("norm").rlike(r"\d[^\w]{1,5}\d"))
    slim = may.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("seg_ord").cast("int").alias("seg_ord"), "text", "omap", F.posexplode(value_hits(F.col("norm"))).alias("pos", "h"))
    start, end = source_start(F.col("h.start")), source_end(F.col("h.end"))
    spans = F.transform("h.pieces", lambda p: F.struct(source_start(p["s"]).cast("int").alias("s"), source_end(p["e"]).cast("int").alias("e")))
    return slim.select(
        "doc_id", "seg_ord", (F.lit(100_000_000) + F.col("pos")).cast("long").alias("ent_seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(F.col("text"), start + 1, end - start).alias("original_text"),
        F.col("h.type").alias("entity_type"), F.lit("regex").alias("detector"), F.lit(1.0).alias("confidence"), F.when(F.size("h.pieces") > 1, spans).alias("spans"),
    )


def find(text: str, spark: SparkSession | None = None) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """(start, end, type, pieces) of the values in one normalised text; for tables there is ``detect_multispan``."""
    spark = spark or SparkSession.active()
    rows = spark.createDataFrame([(text,)], "text string").select(F.inline(value_hits(F.col("text")))).collect()
    return [(r.start, r.end, r.type, [(p.s, p.e) for p in r.pieces]) for r in rows]
