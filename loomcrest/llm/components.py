"""Connected components of an edge table by alternating large-star and small-star rounds.

Both stars need only each node's least neighbour (an aggregate with map-side combine) and a join back, so no
neighbourhood is ever gathered. Each round is written to the shared folder, and the one before it is deleted. Rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

ROWS_A_FILE = 1_000_000


def _settled(df: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int, tuple]:
    """df written and read back, in few parts where it is small; as it was written; its rows; a checksum. `before` is deleted."""
    df = C.materialize(df)
    if before is not None:
        C.forget(before)
    n, check = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return df.coalesce(max(1, n // ROWS_A_FILE)) if n < 50 * ROWS_A_FILE else df, df, n, (n, check)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v): the least node that it reaches. Loops and repeats are allowed; null ends are dropped."""
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    e, written, n, last = _settled(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if not n:
            break
        # large star: every greater neighbour v of u goes to the least of u's neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours go to the least of them
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e, written, n, now = _settled(small.where("u > v").distinct(), written)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge leads to its component's least node
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
