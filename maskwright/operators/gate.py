"""The regression gate: a run against its baseline. Each line gives rows; any row is red."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "line string, key string, metric string, baseline double, current double"


def compare(baseline: DataFrame, current: DataFrame, key: str, metrics: dict[str, tuple[str, float]], line: str) -> DataFrame:
    """Rows where a metric got worse by more than it may; metrics: name -> ("up" or "down", whichever is better, tolerance).

    A full outer join: a key that only one side has counts with 0 there.
    """
    b = baseline.select(F.col(key).alias("key"), *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    c = current.select(F.col(key).alias("key"), *[F.col(m).cast("double").alias(f"c_{m}") for m in metrics])
    joined = b.join(c, "key", "full").fillna(0.0)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("baseline"), F.col(f"c_{m}").alias("current"), F.lit(1.0 if better == "up" else -1.0).alias("sign"), F.lit(float(may)).alias("may")) for m, (better, may) in metrics.items()]
    long = joined.select("key", F.explode(F.array(*rows)).alias("r"))
    worse = (F.col("r.baseline") - F.col("r.current")) * F.col("r.sign") > F.col("r.may") + 1e-9
    return long.where(worse).select(F.lit(line).alias("line"), "key", "r.metric", "r.baseline", "r.current")


def debt(baseline_leaks: DataFrame, current_leaks: DataFrame, known: DataFrame) -> DataFrame:
    """(change, id): leaks that are new and not known, and known ones that are gone."""
    fresh = current_leaks.select("id").subtract(baseline_leaks.select("id")).subtract(known.select("id")).select(F.lit("new").alias("change"), "id")
    closed = known.select("id").subtract(current_leaks.select("id")).select(F.lit("closed").alias("change"), "id")
    return fresh.unionByName(closed)


def must_be_empty(rows: DataFrame, line: str, key: str) -> DataFrame:
    """Every row is a regression."""
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("current")).select(F.lit(line).alias("line"), "key", F.lit("rows").alias("metric"), F.lit(0.0).alias("baseline"), "current")


def same_ledger(baseline: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows in one of two tables of one shape, not in the other."""
    return baseline.exceptAll(ledger).withColumn("side", F.lit("baseline")).unionByName(ledger.exceptAll(baseline).withColumn("side", F.lit("ledger")))


def evaluate(*lines: DataFrame) -> DataFrame:
    """All regression rows of all lines; the gate is green if there are none."""
    return reduce(DataFrame.unionByName, lines)


def coverage(chosen: DataFrame, strata: DataFrame) -> DataFrame:
    """(n_strata, covered, share): strata (id, stratum) that the chosen ids cover."""
    hit = strata.join(chosen.select("id").distinct(), "id", "left_semi").select("stratum").distinct().withColumn("hit", F.lit(1))
    every = strata.select("stratum").distinct().join(hit, "stratum", "left")
    return every.agg(F.count(F.lit(1)).alias("n_strata"), F.count("hit").alias("covered")).withColumn("share", F.col("covered") / F.nullif(F.col("n_strata"), F.lit(0)))
