"""Aggregates and recurrences over run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantiles


def mean_std(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric; a missing metric is 0, the deviation of one run 0."""
    value = lambda m: F.coalesce(F.col(m), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(x for m in metrics for x in (F.avg(value(m)).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(value(m)), F.lit(0.0)).alias(f"{m}_std"))))


def advantage(score: Column, group: str) -> Column:
    return score - F.avg(score).over(Window.partitionBy(group))


def clamped_sum(delta: Column, start: float, by: list[str], order: list[str]) -> Column:
    """x <- max(0, x + delta) as windows: the running sum less the least it has been below zero."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(delta).over(w) + start
    return run, w


def multiplier(df: DataFrame, cost: str, by: list[str], order: list[str], start: float = 0.0, rate: float = 0.05, limit: float = 0.5) -> DataFrame:
    """lambda after each step: max(0, lambda + rate * (cost - limit))."""
    run, w = clamped_sum(rate * (F.col(cost) - limit), start, by, order)
    return df.withColumn("_run", run).withColumn("lambda", F.col("_run") - F.least(F.lit(0.0), F.min("_run").over(w))).drop("_run")


def ema(df: DataFrame, value: str, by: str, order: str, keep: float = 0.9, start: float = 0.0) -> DataFrame:
    """(by, order, baseline): b <- keep * b + (1 - keep) * value in order, one series an entity; a null value makes the rest of its series null.

    A recurrence of products is no window function; series stream through sorted partitions in bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, b = object(), start
        for batch in batches:
            out = []
            for e, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if e != entity:
                    entity, b = e, start
                b = None if b is None or x is None else keep * b + (1 - keep) * x
                out.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], [by, order, "baseline"])

    rows = df.select(by, order, F.col(value).cast("double").alias("_v")).repartition(by).sortWithinPartitions(by, order)
    schema = T.StructType([rows.schema[by], rows.schema[order], T.StructField("baseline", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def length_summary(df: DataFrame, n: str, over: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """A row a group (one without groups): n, min, mean, max, p50, p90, p95, p99 of the lengths, and with `over` how many are longer (n_over) and how many are kept (n_saved). 0 quantiles where there is no length."""
    groups = groups or []
    many = [] if over is None else [F.count_if(F.col(n) > over).alias("n_over"), F.count_if(F.col(n) <= over).alias("n_saved")]
    sums = df.groupBy(*groups).agg(F.count(n).alias("n"), F.min(n).alias("min"), F.avg(n).alias("mean"), F.max(n).alias("max"), *many)
    names = ("p50", "p90", "p95", "p99")
    ranks = quantiles(df, groups, n, {p: int(p[1:]) / 100 for p in names})
    if groups:
        ranks = ranks.withColumnsRenamed({g: f"_{g}" for g in groups})
        same = [sums[g].eqNullSafe(F.col(f"_{g}")) for g in groups]
        both = sums.join(ranks, same, "left")
    else:
        both = sums.join(F.broadcast(ranks), F.lit(True), "left")  # a row each
    return both.select(*groups, "n", "min", "mean", "max", *(F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in names), *(["n_over", "n_saved"] if many else []))
