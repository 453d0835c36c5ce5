"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, rejoin, release


def _stars(pairs: DataFrame, most: int, label: str, written: list[DataFrame]) -> DataFrame:
    """u, v -> u, v, m: each ordered pair with the least node that its u reaches, u itself included.

    The least nodes of at most ``most`` pairs are broadcast where that is few; else those of hubs are.
    Tables written on the way are added to ``written``.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    if most <= BROADCAST_ROWS:
        return pairs.join(F.broadcast(least.drop("n")), "u")
    pairs, least = materialize(pairs, f"{label}-pairs"), materialize(least, f"{label}-least")
    written += [pairs, least]
    return rejoin(pairs, least, "u")


def connected_components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component is the least node reached.

    Each round hangs every neighbour on the least one it can see; a round is a few joins on the
    edges that are left, at most as many as there were. Hubs take part as sums of one row a
    neighbour, and what they need to know is broadcast, so no task gets all of a hub's edges. Rounds stop when a round changes
    nothing. Edges with a null end and loops are ignored; repeated edges count once.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct(), label
    )
    mark, rows = None, state.count()
    if not rows:
        return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        written = [state]
        large = _stars(both(state), 2 * rows, label, written).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = _stars(large, 2 * rows, label, written).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        state = materialize(small, label)
        release(*written)
        seen = tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == mark:
            break
        mark, rows = seen, seen[0]
    else:
        raise RuntimeError("the components did not settle")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
