"""Control digits of registry numbers as column expressions; digits are taken from strings without gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the control digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def bare(value: Column) -> Column:
    """The value without the gaps that numbers may be written with."""
    return F.translate(value, " \u00a0", "")


def _digit(text: Column, place: int) -> Column:
    return F.substring(text, place, 1).cast("int")


def _weighted(text: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.lit(w) * _digit(text, i + 1)
    return total % 11 % 10


def _number(text: Column, n: int) -> Column:
    return text.rlike(rf"^[0-9]{{{n}}}$")


def inn10(value: Column) -> Column:
    v = bare(value)
    return F.when(_number(v, 10), _weighted(v, INN10) == _digit(v, 10)).otherwise(False)


def inn12(value: Column) -> Column:
    v = bare(value)
    return F.when(_number(v, 12), (_weighted(v, INN12_FIRST) == _digit(v, 11)) & (_weighted(v, INN12_SECOND) == _digit(v, 12))).otherwise(False)


def ogrn(value: Column) -> Column:
    v = bare(value)
    control = lambda n, by: F.substring(v, 1, n - 1).cast("bigint") % by % 10 == _digit(v, n)
    return F.when(_number(v, 13), control(13, 11)).when(_number(v, 15), control(15, 13)).otherwise(False)


CHECKS = {"inn10": inn10, "inn12": inn12, "ogrn": ogrn}


def make_inn10(nine: Column) -> Column:
    """A valid number from nine digits."""
    return F.concat(nine, _weighted(nine, INN10).cast("string"))


def make_inn12(ten: Column) -> Column:
    first = F.concat(ten, _weighted(ten, INN12_FIRST).cast("string"))
    return F.concat(first, _weighted(first, INN12_SECOND).cast("string"))


def make_ogrn13(twelve: Column) -> Column:
    return F.concat(twelve, (twelve.cast("bigint") % 11 % 10).cast("string"))


def make_ogrn15(fourteen: Column) -> Column:
    return F.concat(fourteen, (fourteen.cast("bigint") % 13 % 10).cast("string"))


def make_snils(nine: Column) -> Column:
    """Nine digits and their two control digits: the sum of digit times place from the right, modulo 101, 100 as 00."""
    total = F.lit(0)
    for i in range(9):
        total = total + (9 - i) * _digit(nine, i + 1)
    return F.concat(nine, F.lpad((total % 101 % 100).cast("string"), 2, "0"))


def spoil(number: Column) -> Column:
    """The number with its last digit one higher (9 becomes 0)."""
    last = (F.substring(number, -1, 1).cast("int") + 1) % 10
    return F.concat(F.substring(number, F.lit(1), F.length(number) - 1), last.cast("string"))
