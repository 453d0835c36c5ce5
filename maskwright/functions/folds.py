"""Folded forms of values and texts, for comparing what was masked with what is still to be seen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----- fixed values ------------------------------------------------------------------------------
INVISIBLE = "[\\u00A0\\u202F\\u200B\\u200D\\u200C\\u00AD\\u2060\\p{Cf}]"
CYRILLIC_LIKE_LATIN = "АОСЕРХКМТВНУаосерхкмтвну"
LATIN = "AOCEPXKMTBHYaocepxkmtbhy"
LETTERS_LIKE_DIGITS, DIGITS = "ОоЗзЧчІібБ", "0033441166"
#: Types whose value is its digits.
NUMERIC = ("INN", "INN_PERSON", "OGRN", "KPP", "BANK_ACCOUNT", "BIK", "PASSPORT", "SNILS", "PHONE", "SUM", "CONTRACT_NO", "REG_ID", "REG_NUMBER")
# ----- end of the fixed values -------------------------------------------------------------------


def visible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def plain_letters(text: Column) -> Column:
    """One alphabet, lower case, single spaces."""
    folded = F.lower(F.translate(visible(text), CYRILLIC_LIKE_LATIN, LATIN))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def _digits_read(text: Column) -> Column:
    return F.translate(visible(text), LETTERS_LIKE_DIGITS, DIGITS)


def digit_core(text: Column) -> Column:
    """All digits of a value, letters that stand for digits read as such."""
    return F.regexp_replace(_digits_read(text), r"[^0-9]", "")


def digit_runs(text: Column) -> Column:
    """Numbers of a text, each with its inner spaces and hyphens taken out, joined by a space."""
    glued = F.regexp_replace(_digits_read(text), r"(?<=[0-9])[ -]+(?=[0-9])", "")
    return F.array_join(F.regexp_extract_all(glued, F.lit("[0-9]+"), F.lit(0)), " ")


def words(text: Column, least: int = 3) -> Column:
    """Words of letters of a folded text, ``least`` letters or more."""
    return F.filter(F.regexp_extract_all(plain_letters(text), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= least)


def value_key(entity_type: Column, text: Column) -> Column:
    """What makes two values the same: digits for numbers, else the folded text."""
    core = digit_core(text)
    return F.when(entity_type.isin(*NUMERIC) & (core != ""), core).otherwise(plain_letters(text))
