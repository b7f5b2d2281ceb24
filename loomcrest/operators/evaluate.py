"""Evaluation rows, their joins and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, taxonomy
from .candidates import function_id, json_null
from .quantiles import quantiles


def eval_samples(samples: DataFrame, functions: DataFrame, own_prompt: bool = False, sample: str = "id", key: str = "id", audit: str = "llm_audit") -> DataFrame:
    """samples with the columns of their function (prefix f_). Samples without a function id in their name, without a function, or (unless they bring a prompt) without an audit drop out."""
    f = functions if own_prompt else functions.where(F.col(audit).isNotNull() & ~json_null(F.col(audit)))
    f = f.select(*(F.col(c).alias(f"f_{c}") for c in functions.columns))
    return samples.withColumn("_fid", function_id(F.col(sample))).join(f, F.col("_fid") == F.col(f"f_{key}")).drop("_fid")


def with_details(rows: DataFrame, functions: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """rows with texts of their function, empty where there is none."""
    f = functions.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in texts))
    out = rows.join(f, F.col(key) == F.col("_k"), "left")
    return out.withColumns({c: F.coalesce(f"_{c}", F.lit("")) for c in texts}).drop("_k", *(f"_{c}" for c in texts))


def evaluation_rows(candidates: DataFrame, sample: str = "sample_id", order: str = "cand", most: int = 3, max_orig_sim: float | None = None, max_change: float | None = None) -> DataFrame:
    """(sample, total_generated, correct_generated, best_*, passed_*): a row a sample of candidates (compiles, passed, orig_sim, ir_sim, ir_change, code).

    A candidate is correct that compiles and passes the tools, is less like the original than max_orig_sim, and changes
    no more than max_change; an unknown similarity or change is too much where there is a limit. The best one is the
    first correct one, and the first `most` are kept.
    """
    ok = F.coalesce(F.col("compiles"), F.lit(False)) & F.coalesce(F.col("passed"), F.lit(False))
    if max_orig_sim is not None:
        ok = ok & F.coalesce(F.col("orig_sim") < max_orig_sim, F.lit(False))
    if max_change is not None:
        ok = ok & F.coalesce(F.col("ir_change") <= max_change, F.lit(False))
    x = candidates.withColumn("_ok", ok)
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(sample, "_ok").orderBy(order)))
    kept = F.when(F.col("_ok") & (F.col("_n") <= most), F.struct("_n", "code", "ir_sim", "ir_change", "orig_sim"))
    rows = x.groupBy(sample).agg(F.count("*").alias("total_generated"), F.count_if("_ok").alias("correct_generated"), F.array_sort(F.collect_list(kept)).alias("_p"))
    field = lambda n: F.transform("_p", lambda p: p[n])
    best = F.get("_p", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = F.size("_p") > 0
    return rows.select(
        sample,
        "total_generated",
        "correct_generated",
        best["code"].alias("best_candidate_code"),
        field("code").alias("passed_candidate_codes"),
        F.when(found, zero(best["ir_sim"])).alias("best_candidate_ir_sim"),
        F.when(found, zero(best["ir_change"])).alias("best_candidate_ir_change_rate"),
        F.transform("_p", lambda p: zero(p["ir_sim"])).alias("passed_candidate_ir_sims"),
        best["orig_sim"].alias("best_candidate_orig_sim"),
        F.array_compact(field("orig_sim")).alias("passed_candidate_orig_sims"),
    )


def deltas(log: DataFrame, counters: list[str], by: str, at: str) -> DataFrame:
    """log with the growth of each running counter of a service (`by`) since its row before, its value at the first, and never negative."""
    w = Window.partitionBy(by).orderBy(at)
    return log.withColumns({f"{c}_used": F.greatest(F.lit(0), F.col(c) - F.lag(c, 1, 0).over(w)) for c in counters})


def result_types(prompt_types: Column, audit_types: Column) -> Column:
    """struct<vulnerability_types, vuln_bucket>: the prompt's types, else the audit's, with their first bucket."""
    empty = F.array().cast("array<string>")
    types = F.when(F.coalesce(F.size(prompt_types), F.lit(0)) > 0, prompt_types).otherwise(F.coalesce(audit_types, empty))
    return F.struct(types.alias("vulnerability_types"), taxonomy.primary_bucket(taxonomy.buckets(types, keep_original=False)).alias("vuln_bucket"))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """One row: count, mean, median, p10, p25, p75, p90 (linear between ranks), min, max; 0 where there is no score."""
    some = df.where(F.col(score).isNotNull())
    sums = some.agg(F.count("*").cast("double").alias("count"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"))
    ranks = quantiles(some, [], score, {"median": 0.5} | {f"p{p}": p / 100 for p in (10, 25, 75, 90)})
    both = sums.join(F.broadcast(ranks), F.lit(True), "left")  # a row each
    return both.select(*(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("count", "mean", "median", "p10", "p25", "p75", "p90", "min", "max")))


def step_means(log: DataFrame, step: str = "step") -> DataFrame:
    """(step, reward, cost, success): means over all ranks' candidates of a step."""
    return log.groupBy(step).agg(*(F.avg(c).alias(c) for c in ("reward", "cost", "success")))


def service_counters(calls: DataFrame) -> DataFrame:
    """One row over calls (tokens, attempts, ok): requests, tokens, retries, failures, mean attempts."""
    return calls.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"), F.count_if(~F.col("ok")).alias("failures"), F.avg("attempts").alias("mean_attempts"))


def attempts_distribution(calls: DataFrame) -> DataFrame:
    return calls.groupBy("attempts").agg(F.count("*").alias("n")).orderBy("attempts")


def function_comparison(calls: DataFrame, key: str = "function") -> DataFrame:
    """A row a function of calls (model, label, severity, confidence, tokens, seconds, ok): successes and failures, votes, consensus, means over successes."""
    ok = F.col("ok")
    over = lambda c: F.avg(F.when(ok, F.coalesce(F.col(c), F.lit(0)))).alias(f"avg_{c}")
    votes = lambda v: F.count_if(ok & (F.col("label") == v))
    out = calls.groupBy(key).agg(
        F.count("*").alias("total_models"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        votes("vulnerable").alias("agree_on_vulnerable"),
        votes("safe").alias("agree_on_safe"),
        (F.count_distinct(F.when(ok, F.coalesce("label", F.lit("")))) == 1).alias("consensus"),
        *(over(c) for c in ("severity", "confidence", "tokens", "seconds")),
    )
    return out.where("successful > 0")


def most_controversial(comparison: DataFrame, seq: str) -> DataFrame:
    """The first function of the greatest |vulnerable - safe| / models, if any is above 0. (By that formula the models agree most there.)"""
    gap = F.abs(F.col("agree_on_vulnerable") - F.col("agree_on_safe")) / F.col("total_models")
    return comparison.withColumn("disagreement", gap).where("disagreement > 0").orderBy(F.desc("disagreement"), seq).limit(1)


def consensus_rate(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.count("*").alias("functions"), F.count_if("consensus").alias("agreed"), F.coalesce(F.avg(F.col("consensus").cast("double")) * 100, F.lit(0.0)).alias("percent"))


def review_order(df: DataFrame, flags: str, correct: str) -> DataFrame:
    """Flagged rows first, then by correct candidates, most first."""
    return df.orderBy(F.when(F.size(flags) > 0, 0).otherwise(1), F.desc(correct))


def sweep_grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values, numbered in order of the axes. The grid is as small as its lists, which are the caller's."""
    from itertools import product

    rows = [(i, *values) for i, values in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["run", *axes])


def baseline_rows(samples: DataFrame, sample: str = "sample_id", code: str = "code") -> DataFrame:
    """evaluation_rows of the original code as the only candidate (compiles, passed, other_passed: null passes, ir_sim, ir_change): what tools say of it without any repair. Null or blank code was not verified."""
    verified = F.trim(F.coalesce(F.col(code), F.lit(""))) != ""
    yes = lambda c, default: F.coalesce(F.when(verified, F.col(c)), F.lit(default))
    ok = yes("compiles", False) & yes("passed", False) & yes("other_passed", True)
    number = lambda c: F.coalesce(F.when(verified, F.col(c)).cast("double"), F.lit(0.0))
    one = lambda c: F.when(ok, F.array(c)).otherwise(F.array().cast("array<double>"))
    return samples.select(
        sample,
        F.lit(1).alias("total_generated"),
        ok.cast("int").alias("correct_generated"),
        F.when(ok, F.col(code)).alias("best_candidate_code"),
        F.when(ok, F.array(code)).otherwise(F.array().cast("array<string>")).alias("passed_candidate_codes"),
        number("ir_sim").alias("best_candidate_ir_sim"),
        number("ir_change").alias("best_candidate_ir_change_rate"),
        one(number("ir_sim")).alias("passed_candidate_ir_sims"),
        F.when(ok, 1.0).alias("best_candidate_orig_sim"),
        one(F.lit(1.0)).alias("passed_candidate_orig_sims"),
    )


def _short(x: Column) -> Column:
    """A number as short as it goes: 1 for 1.0, with six digits at most."""
    digits = F.call_function("format_number", x, F.lit("0.######"))
    return F.coalesce(digits, F.lit("none"))


def config_key(c: Column) -> Column:
    """What a run's repeats share: model, samples, temperature, top_p and retrieval mode of a struct with these fields."""
    mode = F.lower(F.trim(F.coalesce(F.nullif(c["rag_mode"], F.lit("")), F.lit("off"))))
    return F.concat(F.lit("model="), F.coalesce(c["model"], F.lit("")), F.lit("|n="), F.coalesce(c["n_samples"], F.lit(0)).cast("string"), F.lit("|temp="), _short(F.coalesce(c["temperature"], F.lit(0.0))), F.lit("|top_p="), _short(c["top_p"]), F.lit("|rag="), mode)


def run_name(c: Column, stamp: Column) -> Column:
    """A file name for a run of a configuration (config_key's fields and seed)."""
    mode = F.coalesce(F.nullif(c["rag_mode"], F.lit("")), F.lit("off"))
    return F.concat(F.lit("eval_"), c["model"], F.lit("_n"), c["n_samples"].cast("string"), F.lit("_t"), _short(c["temperature"]), F.lit("_p"), _short(c["top_p"]), F.lit("_rag"), mode, F.lit("_seed"), c["seed"].cast("string"), F.lit("_"), stamp)


#: The best score over a sample's passed candidates, averaged over samples: metrics that older files lack.
HIGHEST = {"highest_bleu": similarity.bleu_score, "highest_edit_sim": similarity.edit_similarity}


def run_records(files: DataFrame) -> DataFrame:
    """(path, modified, config, metrics map<string,double>) of evaluation files (path, modified, meta, metrics, details: variants).

    Files whose meta or metrics are no objects, or whose numbers are none, drop out; metrics of HIGHEST that are missing are computed from the
    details: 0 where no sample has a reference and a passed candidate. Details that are no objects, and texts that are
    none, are passed over.
    """
    get = lambda n, t: F.try_variant_get("meta", f"$.{n}", t)
    number = lambda n, t: F.coalesce(get(n, "string").try_cast(t), F.when(get(n, "variant").isNull(), F.lit(0).cast(t)))
    p = F.lower(F.trim(get("top_p", "string")))
    config = F.struct(F.coalesce(get("model", "string"), F.lit("")).alias("model"), number("n_samples", "int").alias("n_samples"), number("temperature", "double").alias("temperature"), F.when(~p.isin("none", "null", ""), p.try_cast("double")).alias("top_p"), number("seed", "long").alias("seed"), F.coalesce(F.nullif(get("rag_mode", "string"), F.lit("")), F.lit("off")).alias("rag_mode"), get("jsonl_path", "string").alias("jsonl_path"), get("limit", "string").try_cast("int").alias("limit"))
    metrics = F.transform_values(F.try_variant_get("metrics", "$", "map<string,variant>"), lambda _, v: F.try_variant_get(v, "$", "double"))
    # a list of one record or none: a filter behind the record would be moved before it and parse all again
    good = lambda r: F.coalesce(F.startswith(r["kind"], F.lit("OBJECT")), F.lit(False)) & r["metrics"].isNotNull() & r["config"]["n_samples"].isNotNull() & r["config"]["temperature"].isNotNull() & r["config"]["seed"].isNotNull()
    record = F.struct(F.schema_of_variant("meta").alias("kind"), config.alias("config"), metrics.alias("metrics"))
    rows = files.select("path", "modified", F.explode(F.filter(F.array(record), good)).alias("r")).select("path", "modified", "r.config", "r.metrics")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    # details of files that drop out drop out by the join; what has no fields has no reference
    d = files.select("path", F.posexplode(F.try_variant_get("details", "$", "array<variant>")).alias("at", "d"))
    d = d.select("path", "at", F.try_variant_get("d", "$.reference_code", "variant").alias("ref"), F.explode(F.try_variant_get("d", "$.passed_candidate_codes", "array<variant>")).alias("c"))
    d = d.select("path", "at", text(F.col("ref")).alias("ref"), text(F.col("c")).alias("c")).where("ref <> '' and c <> ''")
    best = d.groupBy("path", "at").agg(*(F.max(f(F.col("ref"), F.col("c"))).alias(n) for n, f in HIGHEST.items()))
    mean = best.groupBy("path").agg(*(F.avg(n).alias(n) for n in HIGHEST))
    made = F.create_map(*(x for n in HIGHEST for x in (F.lit(n), F.coalesce(n, F.lit(0.0)))))
    missing = F.map_filter(made, lambda k, _: ~F.map_contains_key("metrics", k))
    return rows.join(mean, "path", "left").select("path", "modified", "config", F.map_concat("metrics", missing).alias("metrics"))


def last_runs(records: DataFrame) -> DataFrame:
    """Of several files of one configuration the one written last; of equal times that of the greatest path."""
    row = F.struct(*(F.col(c) for c in records.columns))
    return records.groupBy(F.to_json("config").alias("_c")).agg(F.max_by(row, F.struct("modified", "path")).alias("_r")).select("_r.*")


def sweep_summary(records: DataFrame) -> DataFrame:
    """(config_key, num_runs, metric, mean, std): each metric that any run has, over the runs of a configuration; a run without it counts 0, the deviation of one run is 0."""
    runs = records.select(config_key(F.col("config")).alias("config_key"), "metrics")
    names = runs.select(F.explode(F.map_keys("metrics")).alias("metric")).distinct()
    size = runs.groupBy("config_key").agg(F.count("*").alias("num_runs"))
    there = runs.select("config_key", F.explode("metrics").alias("metric", "v")).withColumn("v", F.coalesce("v", F.lit(0.0)))
    sums = there.groupBy("config_key", "metric").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("s"))
    every = size.join(names, F.lit(True)).join(sums, ["config_key", "metric"], "left")  # configurations x names of metrics
    n, k, m = F.col("num_runs"), F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0.0))
    mean = k * m / n
    squares = k * (F.coalesce("s", F.lit(0.0)) + (m - mean) * (m - mean)) + (n - k) * mean * mean
    return every.select("config_key", "num_runs", "metric", mean.alias("mean"), F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0).alias("std"))


def metric_columns(names: list[str], preferred: list[str], buckets: list[str], by_bucket: list[str]) -> list[str]:
    """Columns of a sweep's table: the preferred metrics, then those of each bucket, then the others by name, each as mean and deviation."""
    first = [*preferred, *(f"{m}_{b}" for b in buckets for m in by_bucket)]
    order = [m for m in dict.fromkeys(first) if m in names] + sorted(set(names) - set(first))
    return ["config_key", "num_runs", *(f"{m}_{x}" for m in order for x in ("mean", "std"))]
