"""Case repair: a copy of a text, of the same length, in which names written in odd case look like names.

Detectors read the copy, values are cut from the text itself, so the two must agree in length; where
case mapping would change a length there is no copy. Column expressions only: one pattern takes a
short text apart into what is to be repaired and the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ----- fixed values ------------------------------------------------------------------------------
#: Longest text that is repaired, words in a row that make a run, letters of a word in capitals that
#: isn't a legal form, letters of a legal form, characters between the words of a run.
LONGEST, RUN, CAPITALS, FORM, GAP = 200, 2, 4, (2, 3), 3
HIDDEN = "­​‌‍⁠﻿"
LIST_ITEM = r"^\s*(?:\(\d+\)|\d+\.)"
# ----- end of the fixed values -------------------------------------------------------------------

_WORD = rf"\p{{L}}(?:[\p{{L}}{HIDDEN}]*\p{{L}})?"
#: No word of a token with a digit is touched: such tokens are numbers that letters have slipped into.
_CLEAN = r"(?<![^\s])[^\s0-9]+(?![^\s])"
_CAPS = rf"(?<!\p{{L}})\p{{Lu}}(?:[\p{{Lu}}{HIDDEN}]*\p{{Lu}})?(?!\p{{L}})"
_CAPS_RUN = rf"{_CAPS}(?:[^\p{{L}}0-9]{{1,{GAP}}}{_CAPS}){{{RUN - 1},}}"
_FLIP = rf"(?<!\p{{L}})\p{{L}}*\p{{Ll}}[\p{{L}}{HIDDEN}]*\p{{Lu}}[\p{{L}}{HIDDEN}]*(?!\p{{L}})"
_MIXED = rf"(?:[A-Za-z][{HIDDEN}]*[Ѐ-ӿ]|[Ѐ-ӿ][{HIDDEN}]*[A-Za-z])"


def _letters(word: Column) -> Column:
    return F.length(F.translate(word, HIDDEN, ""))


def repaired_word(word: Column) -> Column:
    """Two or three letters in capitals, longer words with a capital first."""
    return F.when(_letters(word).between(*FORM), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word)))))


def _each(text: Column, pattern: str, change) -> Column:  # noqa: ANN001
    """text with every match of a pattern changed; all else is copied character by character."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s){pattern}|."), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^(?:{pattern})$"), change(p)).otherwise(p)), "")


def repaired_case(text: Column) -> Column:
    """All words of a text repaired."""
    return _each(text, _WORD, repaired_word)


def _by_tokens(text: Column) -> Column:
    """repaired_case of the tokens without a digit."""
    tokens = F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), t).otherwise(repaired_case(t))), "")


def repaired_odd_words(text: Column) -> Column:
    """Words with a capital behind a small letter, and words in capitals that stand in a run of such, repaired."""
    long_ = lambda w: F.when(_letters(w) >= CAPITALS, repaired_word(w)).otherwise(w)
    run = lambda r: _each(r, _WORD, long_)
    whole = _each(text, f"{_CAPS_RUN}|{_FLIP}", lambda p: F.when(p.rlike(f"^{_FLIP}$"), repaired_word(p)).otherwise(run(p)))
    was, now = (F.regexp_extract_all(t, F.lit(r"\s+|\S+"), F.lit(0)) for t in (text, whole))
    # The case mapping of a token with a digit is undone; both texts fall into the same tokens.
    undone = F.array_join(F.zip_with(was, now, lambda a, b: F.when(a.rlike("[0-9]"), a).otherwise(b)), "")
    return F.when(F.size(was) == F.size(now), undone).otherwise(text)


def longest_run(text: Column) -> Column:
    """Whether RUN words stand in a row, GAP characters and no digit between them at most."""
    return text.rlike(rf"{_WORD}[^\p{{L}}0-9]{{1,{GAP}}}{_WORD}")


def detection_text(text: Column, mixed_document: Column) -> Column:
    """The repaired copy of a short text, or null: where nothing changes, or its length would.

    mixed_document: a word of two alphabets stands somewhere in the document. Then only list items
    in one case are repaired, so that what other repairs do isn't disturbed.
    """
    cased = F.upper(text) != F.lower(text)
    lower, upper = cased & (text == F.lower(text)), cased & (text == F.upper(text))
    item = F.when((lower | upper) & text.rlike(LIST_ITEM), repaired_case(text))
    plain = F.when(lower, F.when(longest_run(text), _by_tokens(text))).otherwise(repaired_odd_words(text))
    copy = F.when(F.length(text) <= LONGEST, F.when(mixed_document, item).otherwise(plain))
    return F.when((F.length(copy) == F.length(text)) & (copy != text), copy)


def with_detection_text(segments: DataFrame) -> DataFrame:
    """segments (doc_id, seg_ord, text) with detection_text, null where the text itself is to be read.

    Only segments in odd case are looked at; a document's alphabets are a semi-join on those of two.
    """
    odd = rf"{_CAPS_RUN}|{_FLIP}"
    lower = (F.upper("text") != F.lower("text")) & (F.col("text") == F.lower("text"))
    may = (F.length("text") <= LONGEST) & (lower | F.col("text").rlike(odd) | F.col("text").rlike(LIST_ITEM))
    mixed = segments.where(F.col("text").rlike(_MIXED)).select("doc_id").distinct().withColumn("_mixed", F.lit(True))
    joined = segments.withColumn("_may", F.coalesce(may, F.lit(False))).join(mixed, "doc_id", "left")
    copy = F.when(F.col("_may"), detection_text(F.col("text"), F.coalesce("_mixed", F.lit(False))))
    return joined.withColumn("detection_text", copy).drop("_may", "_mixed")
