"""Distortions of values for robustness tests: seeded by the row, so the same everywhere and every time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----- fixed values ------------------------------------------------------------------------------
LOOK_ALIKES = ("аеорсухАВЕКМНОРСТХ", "aeopcyxABEKMHOPCTX")
OCR = ("0138бО", "ОlЗВ60")
INVISIBLE = "​"
# ----- end of the fixed values -------------------------------------------------------------------


def draw(seed: Column, n: Column, salt: int = 0) -> Column:
    """A number of 0 to n - 1 (0 where n is 0)."""
    return F.when(n > 0, F.pmod(F.xxhash64(F.lit(salt), seed), n)).otherwise(0).cast("int")


def _at(text: Column, place: Column, insert: Column | str, drop: int = 0) -> Column:
    put = F.lit(insert) if isinstance(insert, str) else insert
    return F.concat(F.substring(text, F.lit(1), place), put, F.substring(text, place + 1 + drop, F.length(text)))


def homoglyph(text: Column, seed: Column) -> Column:
    """Look-alikes for Cyrillic letters in the half of the text that the seed picks."""
    half = F.ceil(F.length(text) / 2).cast("int")
    swap = lambda t: F.translate(t, *LOOK_ALIKES)
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    return F.when(draw(seed, F.lit(2)) == 0, F.concat(swap(first), second)).otherwise(F.concat(first, swap(second)))


def invisible(text: Column, seed: Column) -> Column:
    return _at(text, draw(seed, F.length(text)), INVISIBLE)


def case(text: Column, seed: Column) -> Column:
    """All lower, all upper, or alternating."""
    swing = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(i % 2 == 0, F.upper(c)).otherwise(F.lower(c))), "")
    pick = draw(seed, F.lit(3))
    return F.when(pick == 0, F.lower(text)).when(pick == 1, F.upper(text)).otherwise(swing)


def digit_spaces(text: Column, seed: Column) -> Column:
    """A space behind every third or fourth digit of a run."""
    spaced = lambda n: F.regexp_replace(text, rf"(?<=\d)(\d{{{n}}})(?=\d)", " $1")
    return F.when(draw(seed, F.lit(2)) == 0, spaced(3)).otherwise(spaced(4))


def linebreak(text: Column, seed: Column) -> Column:
    return F.when(F.length(text) > 1, _at(text, draw(seed, F.length(text) - 1) + 1, "\n")).otherwise(text)


def char_map(text: Column, seed: Column) -> Column:
    """Characters as a scanner misreads them."""
    return F.translate(text, *OCR)


def squeeze(text: Column, seed: Column) -> Column:
    return F.translate(text, " ", "")


def drop_char(text: Column, seed: Column) -> Column:
    return F.when(F.length(text) > 1, _at(text, draw(seed, F.length(text)), "", 1)).otherwise(text)


def insert_space(text: Column, seed: Column) -> Column:
    return F.when(F.length(text) > 1, _at(text, draw(seed, F.length(text) - 1) + 1, " ")).otherwise(text)


def split_hyphen(text: Column, seed: Column) -> Column:
    return F.when(F.length(text) > 1, _at(text, draw(seed, F.length(text) - 1) + 1, "-\n")).otherwise(text)


def separator_swap(text: Column, seed: Column) -> Column:
    """Dots, slashes and commas between digits exchanged."""
    return F.regexp_replace(F.translate(text, "./,", "/.;"), r"(?<=\d);(?=\d)", ".")


def cell_split(text: Column, seed: Column) -> Column:
    """array of the two parts that a cell's edge tears a value into."""
    at = draw(seed, F.length(text) - 1) + 1
    return F.when(F.length(text) > 1, F.array(F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text)))).otherwise(F.array(text))


NOISE = {
    "homoglyph": homoglyph, "invisible": invisible, "case": case, "digit_spaces": digit_spaces, "linebreak": linebreak, "digit_as_letter": char_map, "space_loss": squeeze, "char_loss": drop_char,
    "digit_gap": insert_space, "value_split": split_hyphen, "separator_ruin": separator_swap,
}
