"""Exact quantiles of any number of different values, in bounded tasks.

Equal values of a group collapse to one with a count; the different ones are range-partitioned by (group, value) and
written once with their partition's number; counts by partition say which partition holds a rank, and only the rows that
have the ranks asked for are read back. No task holds a map of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def quantiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float], partitions: int | None = None) -> DataFrame:
    """(groups, a column a name of `probabilities`): quantiles with linear interpolation between ranks, as doubles.

    Null values don't count; groups without a value give no row; null groups are a group. Without groups there is one row
    (none if there is no value).
    """
    keys = [f"_g{k}" for k in range(len(groups))] or ["_g0"]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)] if groups else [F.lit(0).alias("_g0")]
    rows = df.select(*named, F.col(value).cast("double").alias("_v")).where("_v is not null")
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranged = counted.repartitionByRange(*([partitions] if partitions else []), *keys, "_v").withColumn("_p", F.spark_partition_id())
    sorted_values = written(ranged)  # once, as ranges are cut by a sample
    same = lambda a, b: _all([F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    sizes = sorted_values.groupBy(*keys, "_p").agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0)))
    totals = sizes.groupBy(*keys).agg(F.sum("_size").alias("_total"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probabilities.items())))
    places = totals.withColumn("_q", asked).withColumn("_at", F.col("_q.p") * (F.col("_total") - 1))
    ranks = places.select(*keys, "_at", F.col("_q.name").alias("_name"), F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    where = ranks.alias("r").join(sizes.alias("s"), same("r", "s") & F.expr("r._rank >= s._before and r._rank < s._before + s._size"))
    where = where.select(*(F.col(f"r.{k}").alias(k) for k in keys), "_p", "_name", "_at", "_rank", (F.col("_rank") - F.col("_before")).alias("_inner"))
    upto = F.sum("_n").over(Window.partitionBy("_p", *keys).orderBy("_v"))
    inside = sorted_values.withColumn("_upto", upto).select(*keys, "_p", "_v", "_n", "_upto")
    hit = where.alias("r").join(inside.alias("s"), same("r", "s") & F.expr("r._p = s._p and r._inner < s._upto and r._inner >= s._upto - s._n"))
    hit = hit.select(*(F.col(f"r.{k}").alias(k) for k in keys), "_name", "_at", "_v")
    low, high, share = F.min("_v"), F.max("_v"), F.any_value("_at") - F.floor(F.any_value("_at"))
    each = hit.groupBy(*keys, "_name").agg((low + share * (high - low)).alias("_q"))
    wide = each.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probabilities))
    return wide.select(*(F.col(k).alias(g) for g, k in zip(groups, keys, strict=False)), *probabilities)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
