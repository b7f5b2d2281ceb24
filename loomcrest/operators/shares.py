"""Keys that hold a large share of the rows, and how their rows are dealt to more than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: list[str], shares: int = 256) -> DataFrame:
    """(keys, n) of the keys with at least one in `shares` of all rows: `shares` rows at most, whatever df holds, so it may be broadcast. Null keys are left out."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    hot = n.dropna(subset=keys).crossJoin(F.broadcast(total)).where(F.col("n") * shares >= F.col("_total"))
    return hot.select(*keys, "n")


def dealt(df: DataFrame, hot: DataFrame, keys: list[str], parts: int, by: Column) -> DataFrame:
    """df with `_part`: rows of a hot key are spread over `parts` by the value of `by`; others are in part 0."""
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    return df.join(mark, keys, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(0).cast("int")).drop("_hot")


def copied(df: DataFrame, hot: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """df with `_part`: rows of a hot key stand in all `parts`, others in part 0."""
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return df.join(mark, keys, "left").withColumn("_part", F.explode(every)).drop("_hot")
