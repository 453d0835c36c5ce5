"""Values of column expressions that are made once and used often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often it is used.

    A column expression that is used twice is computed twice, and inside a lambda once for each
    element; a one-element array hands its value to a lambda instead.
    """
    return F.get(F.transform(F.array(value), use), 0)
