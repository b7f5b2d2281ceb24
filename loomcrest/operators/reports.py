"""Statistics and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import pass_at_k


def histogram(df: DataFrame, values: Column, id_: str, seq: str, examples: int = 30) -> DataFrame:
    """(value, samples, labels, first, examples) of an array column: rows that hold it, its occurrences, first-seen example ids; most frequent first, ties as first seen."""
    e = df.select(F.col(id_).alias("_id"), F.col(seq).alias("_seq"), F.explode(values).alias("value"))
    per = e.groupBy("value", "_id").agg(F.count("*").alias("n"), F.min("_seq").alias("s"))
    out = per.groupBy("value").agg(F.count("*").alias("samples"), F.sum("n").alias("labels"), F.min("s").alias("first"))
    few = per.withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy("s", "_id"))).where(F.col("r") <= examples)
    shown = few.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "_id"))), lambda x: x["_id"]).alias("examples"))
    return out.join(shown, "value").orderBy(F.desc("samples"), "first")


def type_report(df: DataFrame, raw: str, normalized: str) -> DataFrame:
    """Totals of rows: all, without types, with a type that maps to nothing, with several."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.size(raw) == 0).alias("missing"),
        F.count_if((F.size(raw) > 0) & (F.size(normalized) == 0)).alias("unmappable"),
        F.count_if(F.size(normalized) > 1).alias("multi_label"),
    )


def crosstab(df: DataFrame, pairs: str) -> DataFrame:
    """(raw, norm, n) of array<struct<raw, norm>>; what maps to nothing is __UNMAPPABLE__."""
    e = df.select(F.inline(pairs))
    return e.groupBy("raw", F.coalesce("norm", F.lit("__UNMAPPABLE__")).alias("norm")).agg(F.count("*").alias("n"))


def top_versions(df: DataFrame, version: str, most: int = 10) -> DataFrame:
    """(version, n, percent): the most frequent; ties by version."""
    total = df.agg(F.count("*").alias("total"))
    top = df.groupBy(version).agg(F.count("*").alias("n")).orderBy(F.desc("n"), version).limit(most)
    return top.crossJoin(F.broadcast(total)).select(version, "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("percent"))


def suite(df: DataFrame, ks: tuple[int, ...] = (1, 5, 10), n: str = "total_generated", c: str = "correct_generated", scores: tuple[str, ...] = ("bleu", "edit_sim")) -> DataFrame:
    """solved_rate; pass@k over rows with n >= k; each score over all, solved and unsolved rows (null where there are none)."""
    done = F.col(c) > 0
    cols = [F.coalesce(F.avg(done.cast("double")), F.lit(0.0)).alias("solved_rate")]
    cols += [F.coalesce(F.avg(F.when(F.col(n) >= k, pass_at_k(F.col(n), F.col(c), k))), F.lit(0.0)).alias(f"pass_at_{k}") for k in ks]
    for s in scores:
        cols += [F.avg(s).alias(f"{s}_all"), F.avg(F.when(done, F.col(s))).alias(f"{s}_solved"), F.avg(F.when(~done, F.col(s))).alias(f"{s}_unsolved")]
    return df.agg(*cols)


def extremes(df: DataFrame, score: str, id_: str, n: int) -> DataFrame:
    """The n lowest and the n highest rows, marked; ties by id."""
    low = df.orderBy(score, id_).limit(n).withColumn("end", F.lit("lowest"))
    return low.unionByName(df.orderBy(F.desc(score), id_).limit(n).withColumn("end", F.lit("highest")))


def compare_scores(stored: DataFrame, computed: DataFrame, key: str, score: str) -> DataFrame:
    """(key, stored, computed, difference) of recomputed scores."""
    s, c = stored.select(key, F.col(score).alias("stored")), computed.select(key, F.col(score).alias("computed"))
    return s.join(c, key).withColumn("difference", F.abs(F.col("stored") - F.col("computed")))


def shared_result(samples: DataFrame, results: DataFrame, group: str, seconds: str) -> DataFrame:
    """A group's one result for each of its samples, its seconds shared out evenly."""
    sizes = samples.groupBy(group).agg(F.count("*").alias("_n"))
    return samples.join(results.join(sizes, group).withColumn(seconds, F.col(seconds) / F.col("_n")).drop("_n"), group)


def run_totals(df: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("samples"), *(F.sum(c).alias(f"{c}_sum") for c in sums), *(F.avg(c).alias(f"{c}_mean") for c in means))


def contract_rollup(df: DataFrame, file: str, category: str, name: str) -> DataFrame:
    return df.groupBy(file).agg(F.array_sort(F.collect_set(category)).alias("categories"), F.array_sort(F.collect_set(name)).alias("names"))


def model_summary(calls: DataFrame) -> DataFrame:
    """calls (model, function, label, severity, confidence, tokens, ok): means over successful calls, votes, share of functions where all agree."""
    ok = calls.where("ok")
    agree = ok.groupBy("function").agg((F.count_distinct("label") == 1).alias("consensus"))
    return ok.join(agree, "function").groupBy("model").agg(
        F.avg(F.col("consensus").cast("double")).alias("agreement"), F.avg("severity").alias("severity"), F.avg("confidence").alias("confidence"),
        F.count_if(F.col("label") == "vulnerable").alias("vulnerable"), F.count_if(F.col("label") == "safe").alias("safe"), F.sum("tokens").alias("tokens"),
    )


def bucket_metrics(rows: DataFrame, bucket: str, names: list[str], ks: tuple[int, ...] = (1, 5, 10), total: str = "total_generated", correct: str = "correct_generated") -> DataFrame:
    """A row a bucket of `names` (other or null buckets count as OTHER): n, solved_rate and mean pass@k; zeros where a bucket has no row."""
    solved = F.coalesce(F.col(correct), F.lit(0)) > 0
    at = F.when(F.col(bucket).isin(*names), F.col(bucket)).otherwise("OTHER")
    by = rows.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), F.avg(solved.cast("double")).alias("solved_rate"), *(F.avg(pass_at_k(F.col(total), F.col(correct), k)).alias(f"pass_at_{k}") for k in ks))
    every = rows.sparkSession.createDataFrame([(x,) for x in [*names, "OTHER"]], "bucket string")
    rates = ["solved_rate", *(f"pass_at_{k}" for k in ks)]
    return every.join(by, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in rates))


def store_statistics(functions: DataFrame, fixes: DataFrame, by: str = "dataset_name") -> DataFrame:
    """A row a data set, and one of null for all: functions, vulnerable, their share, fixes, those that compile, that pass the first tool and that do both, and the share of these; shares of nothing are 0."""
    count = lambda c, n: F.count_if(c).alias(n)
    f = functions.rollup(by).agg(F.count("*").alias("functions"), count(F.coalesce("is_vulnerable", F.lit(False)), "vulnerable"), F.grouping(by).alias("_all"))
    own = fixes.join(functions.select(F.col("id").alias("function_id"), by), "function_id")
    built, passed = (F.coalesce(c, F.lit(False)) for c in ("compiles", "slither_passed"))
    x = own.rollup(by).agg(F.count("*").alias("fixes"), count(built, "compiling"), count(passed, "passing"), count(built & passed, "successful"), F.grouping(by).alias("_all"))
    f, x = f.alias("f"), x.alias("x")
    both = f.join(x, F.col(f"f.{by}").eqNullSafe(F.col(f"x.{by}")) & (F.col("f._all") == F.col("x._all")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda a, b, name: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).alias(name)
    return both.select(F.col(f"f.{by}").alias(by), (F.col("f._all") == 1).alias("is_total"), "functions", "vulnerable", share("vulnerable", "functions", "vulnerable_rate"), *(n(c) for c in ("fixes", "compiling", "passing", "successful")), share("successful", "fixes", "success_rate"))


def bucket_sizes(rows: DataFrame, buckets: str, other: str = "OTHER") -> DataFrame:
    """(bucket, n): rows that hold each bucket of an array column, each once; rows without any count as `other`."""
    one = F.when(F.coalesce(F.size(buckets), F.lit(0)) > 0, F.array_distinct(buckets)).otherwise(F.array(F.lit(other)))
    return rows.select(F.explode(one).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
