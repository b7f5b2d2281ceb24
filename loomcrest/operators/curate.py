"""Filters, deduplication, samplers and splits. Sampling orders rows by md5(seed || id): the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, non_blank_lines


def quality_check(text: Column, words: tuple[str, ...] = (), least: int = 100, most: int = 100_000) -> Column:
    ok = F.length(text).between(least, most)
    for w in words:
        ok = ok & F.contains(F.lower(text), F.lit(w))
    return ok


def line_window(text: Column, least: int = 5, most: int = 100) -> Column:
    return non_blank_lines(text).between(least, most)


def dataset_filter(df: DataFrame, types: list | None = None, names: list | None = None, least_severity: float = 0, limit: int | None = None) -> DataFrame:
    """An empty list or a severity of 0 filters nothing."""
    if types:
        df = df.where(F.col("dataset_type").isin(types))
    if names:
        df = df.where(F.col("dataset_name").isin(names))
    if least_severity > 0:
        df = df.where(F.col("severity") >= least_severity)
    return df.limit(limit) if limit else df


def priority(curated: Column, vulnerable: Column, n_types: Column, flagged: Column, n_flags: Column) -> Column:
    """+1000 curated; +100 and 10 a type where vulnerable; +50 and 5 a flag where a tool flags it."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.when(curated, 1000).otherwise(0) + F.when(vulnerable, 100 + 10 * n(n_types)).otherwise(0) + F.when(flagged, 50 + 5 * n(n_flags)).otherwise(0)


def dedup_priority(df: DataFrame, text: str, rank: Column, seq: str) -> DataFrame:
    """One row per stripped text: highest rank, then first seen.

    min_by is an aggregate, so copies of one text are combined before the shuffle however many there are.
    """
    row = F.struct(*(F.col(c) for c in df.columns))
    order = F.struct((-rank).alias("r"), F.col(seq).alias("s"))
    return df.groupBy(content_key(F.col(text)).alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def seeded(seed: int, id_: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(id_).cast("string")))


def _rank(df: DataFrame, by: list[str], seed: int, id_: str, buckets: int = 256) -> DataFrame:
    """df with _rn, the row's rank by md5 inside its stratum, and _n, the stratum's size.

    Ranks come from counts of (stratum, first md5 byte) and a window inside each, so a stratum is never in one task.
    """
    h = df.withColumn("_h", seeded(seed, id_)).withColumn("_b", F.conv(F.left("_h", F.lit(2)), 16, 10).cast("int"))
    counts = h.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w))
    keys = [*by, "_b"]
    left, right = h.alias("l"), counts.alias("r")
    joined = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]).select("l.*", "r._before", "r._n")
    return joined.withColumn("_rn", F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy("_h", id_))).drop("_h", "_b", "_before")


def balanced_sample(df: DataFrame, label: str, id_: str, total: int, ratio: float, seed: int = 42) -> DataFrame:
    """int(total * ratio) positives and the rest negatives, each as far as there are any; no refill."""
    want = int(total * ratio)
    ranked = _rank(df.withColumn("_y", F.coalesce(F.col(label).cast("boolean"), F.lit(False))), ["_y"], seed, id_)
    return ranked.where(F.col("_rn") <= F.when(F.col("_y"), want).otherwise(total - want)).drop("_y", "_rn", "_n")


def split(df: DataFrame, id_: str, ratios: dict[str, float], by: list[str] | None = None, seed: int = 42, name: str = "split") -> DataFrame:
    """Each stratum in md5 order: int(n * ratio) rows a part, the last part takes what remains."""
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    ranked, out, before = _rank(df, by or [], seed, id_), None, F.lit(0)
    *parts, last = ratios
    for p in parts:
        before = before + F.floor(F.col("_n") * F.lit(ratios[p]))
        out = F.when(F.col("_rn") <= before, p) if out is None else out.when(F.col("_rn") <= before, p)
    return ranked.withColumn(name, out.otherwise(last) if out is not None else F.lit(last)).drop("_rn", "_n")


def era_split(wild: DataFrame, curated: DataFrame, id_: str, version: str, most_modern: int = 500, seed: int = 42) -> DataFrame:
    """(id, split, era): wild rows of the early and late eras train, those of the transition validate; all curated rows and `most_modern` wild modern ones (in md5 order) test. Wild rows of no known era stay out."""
    w = wild.select(id_, era(F.col(version)).alias("era"))
    modern = _rank(w.where("era = 'modern'"), [], seed, id_).where(F.col("_rn") <= most_modern).select(id_, F.lit("test").alias("split"), "era")
    older = w.where("era in ('early', 'late', 'transition')").select(id_, F.when(F.col("era") == "transition", "val").otherwise("train").alias("split"), "era")
    return older.unionByName(modern).unionByName(curated.select(id_, F.lit("test").alias("split"), era(F.col(version)).alias("era")))


def era(version: Column) -> Column:
    """Version era; versions without three parts are unknown."""
    part = F.split(version, r"\.")
    major, minor = (F.get(part, F.lit(i)).try_cast("int") for i in (0, 1))
    ok = (F.size(part) == 3) & major.isNotNull() & minor.isNotNull()
    return F.when(~ok, "unknown").when((major == 0) & (minor <= 4), "early").when((major == 0) & (minor <= 6), "late").when((major == 0) & (minor <= 7), "transition").otherwise("modern")
