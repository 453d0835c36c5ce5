"""The context of a value is that of the whole text, though only what is near is read first."""

import random
import re

from pyspark.sql import functions as F

from maskwright.functions import shapes


def plain(text, start, end):
    hide = lambda ws: [w.lower() if w.lower() in shapes.FUNCTION_WORDS else shapes.HIDDEN for w in ws]
    words = lambda t: re.findall(r"[\w-]+", t)
    return hide(words(text[:start])[::-1][:4]), hide(words(text[end:])[:4])


def test_context_is_that_of_the_whole_text(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(["и ", "по ", "договор ", "слово", "  ", "." * 60, " " * 130, "х" * 90]) for _ in range(rng.randrange(1, 30)))
        a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        rows.append((text, a, b))
    got = spark.createDataFrame(rows, "t string, a int, b int").select("t", "a", "b", shapes.whitelisted_context(F.col("t"), F.col("a"), F.col("b")).alias("c")).collect()
    assert all((r.c.left_nearest_first, r.c.right) == plain(r.t, r.a, r.b) for r in got)
