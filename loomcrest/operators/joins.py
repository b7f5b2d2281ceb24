"""Joins of findings, ranges and fixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join


def range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """Points inside ranges of the same key, ends included. width: of the smallest buckets; without it, from the data."""
    p = points.withColumn("_at", F.col(at))
    return interval_join(p, ranges, key, (at, "_at"), (start, end), width).drop("_at", "clip_start", "clip_end")


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_range: tuple[str, str], b_range: tuple[str, str], width: int | None = None) -> DataFrame:
    """Pairs of overlapping ranges of one key, with clip_start and clip_end. width: of the smallest buckets; without it, from the data."""
    return interval_join(a, b, key, a_range, b_range, width)


def skip_done(candidates: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return candidates.join(done.select(on).distinct(), on, "left_anti")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.max_by(row, F.col(seq)).alias("_r")).select("_r.*")


def vote_threshold(findings: DataFrame, keys: list[str], tool: str, least) -> DataFrame:
    """Locations that enough different tools report, with their sorted tools."""
    return findings.groupBy(*keys).agg(F.array_sort(F.collect_set(tool)).alias("tools")).where(F.size("tools") >= least)


def _notes_at(functions: DataFrame, notes: DataFrame, key: str, width: int | None) -> DataFrame:
    """(key, start, end, category, lines, _n): the notes at each different range of functions, with their lines inside it; equal notes are one with a count."""
    same = notes.groupBy(key, "category", "lines").agg(F.count("*").alias("_n"))
    points = same.withColumn("_line", F.explode(F.array_distinct("lines")))
    hit = range_join(points, functions.select(key, "start", "end").distinct(), key, "_line", "start", "end", width)
    inside = hit.withColumn("lines", F.filter("lines", lambda x: x.between(F.col("start"), F.col("end"))))
    return inside.where(F.col("_line") == F.col("lines")[0]).select(key, "start", "end", "category", "lines", "_n")  # once, at its first line


def _lists_at(functions: DataFrame, notes: DataFrame, key: str, width: int | None) -> DataFrame:
    """(key, start, end, vulnerabilities) of the different ranges of functions that have notes. Equal notes travel as one with their count and are as many in the list."""
    note = F.struct("category", "lines", "_n")
    by = _notes_at(functions, notes, key, width).groupBy(key, "start", "end").agg(F.array_sort(F.collect_list(note)).alias("_notes"))
    same = lambda x: F.array_repeat(F.struct(x["category"].alias("category"), x["lines"].alias("lines")), x["_n"].cast("int"))
    return by.select(key, "start", "end", F.flatten(F.transform("_notes", same)).alias("vulnerabilities"))


def annotated_functions(functions: DataFrame, notes: DataFrame, key: str = "path", width: int | None = None, read: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """functions (path, name, start, end) with `vulnerabilities`, array<struct<category, lines>>, and `is_vulnerable`.

    notes (path, category, lines): a note stands at a function if some of its lines lie in it, with those lines alone.
    Functions without a note keep an empty list. Lines meet functions in buckets of `width` lines, by default from the data.
    Functions of one range share its list, which is made once. read: names and what they read of a list; they stand in its
    place, read once a range, so that lists are not copied to all functions of it.
    """
    read = read or {"vulnerabilities": lambda v: v}
    lists = _lists_at(functions, notes, key, width)
    by = lists.select(key, "start", "end", F.lit(True).alias("is_vulnerable"), *(f(F.col("vulnerabilities")).alias(f"_{name}") for name, f in read.items()))
    empty = F.array().cast("array<struct<category:string,lines:array<int>>>")
    out = functions.join(by, [key, "start", "end"], "left").withColumn("is_vulnerable", F.coalesce("is_vulnerable", F.lit(False)))
    return out.withColumns({name: F.when(F.col("is_vulnerable"), F.col(f"_{name}")).otherwise(f(empty)) for name, f in read.items()}).drop(*(f"_{name}" for name in read))


def annotation_counts(functions: DataFrame, notes: DataFrame, key: str = "path", width: int | None = None) -> DataFrame:
    """annotated_functions with numbers that are read of its lists: n notes, `marked` lines in them, and the first category."""
    marked = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + F.size(x["lines"]))
    first = lambda v: F.array_min(F.transform(v, lambda x: x["category"]))
    return annotated_functions(functions, notes, key, width, {"n": lambda v: F.size(v).cast("long"), "marked": marked, "first_category": first})


def usable_fixes(fixes: DataFrame, ids: list | None = None, least_quality: float = 0, limit: int | None = None) -> DataFrame:
    """Fixes that compile and pass the analyzer, of the wanted functions and of enough quality. The limit comes last."""
    out = fixes.where("compiles and slither_passed")
    if ids is not None:
        out = out.where(F.col("function_id").isin(ids))
    if least_quality > 0:
        out = out.where(F.col("fix_quality_score") >= least_quality)
    return out.limit(limit) if limit else out


def fix_pairs(functions: DataFrame, fixes: DataFrame, only_successful: bool = True, datasets: list[str] | None = None) -> DataFrame:
    """Functions with their fixes, sixteen columns of both: with only_successful those that compile and pass the first tool, with datasets those of these data sets."""
    f = functions.select(F.col("id").alias("function_id"), "sample_id", "dataset_name", "dataset_type", "contract_name", "function_name")
    x = fixes.select(F.col("id").alias("fix_id"), "function_id", F.col("original_code").alias("vulnerable_code"), "fixed_code", "fix_analysis", F.col("vulnerabilities_fixed").alias("vulnerability_types"), F.col("original_severity").alias("severity"), "compiles", "slither_passed", "fix_version", "model_name")
    if only_successful:
        x = x.where("compiles and slither_passed")
    if datasets:
        f = f.where(F.col("dataset_name").isin(datasets))
    cols = ["fix_id", *f.columns, *(c for c in x.columns if c not in ("fix_id", "function_id"))]
    return f.join(x, "function_id").select(*cols)


def training_pairs(fixes: DataFrame, functions: DataFrame, least_quality: float = 0) -> DataFrame:
    """usable_fixes with their functions' name, code and audit (prefix f_); `code` is the fix's original code, or the function's where that is null or empty."""
    f = functions.select(*(F.col(c).alias(f"f_{c}") for c in functions.columns))
    out = usable_fixes(fixes, None, least_quality).join(f, F.col("function_id") == F.col("f_id"))
    return out.withColumn("code", F.coalesce(F.nullif("original_code", F.lit("")), F.col("f_function_code")))


def supported(samples: DataFrame, reports: DataFrame, group: str = "contract", function: str = "function") -> DataFrame:
    """samples with `supported`: whether the group's report (reports: group, names) lists 'group::function'."""
    named = F.concat(F.col(group), F.lit("::"), F.col(function))
    return samples.join(reports.select(group, "names"), group, "left").withColumn("supported", F.coalesce(F.array_contains("names", named), F.lit(False))).drop("names")


def analyzer_call_graph(functions: DataFrame, calls: DataFrame, callers: int = 3, callees: int = 10) -> DataFrame:
    """functions (contract, name, signature, code) with the first `callers` that call them inside their contract and the first `callees` that they call, with code.

    calls (contract, caller, callee_contract, callee, seq) is the analyzer's table; a function's calls of itself and
    repeated ones count once at most. A callee without code gets a stub.
    """
    own = calls.where(~((F.col("caller") == F.col("callee")) & (F.col("contract") == F.col("callee_contract"))))
    once = own.groupBy("contract", "caller", "callee_contract", "callee").agg(F.min("seq").alias("seq"))
    code = functions.select(F.col("contract").alias("callee_contract"), F.col("name").alias("callee"), F.col("code").alias("callee_code")).dropDuplicates(["callee_contract", "callee"])
    stub = F.concat(F.lit("function "), F.col("callee"), F.lit("(...) { ... }"))
    known = once.join(code, ["callee_contract", "callee"], "left")
    called = F.struct("seq", F.col("callee").alias("name"), F.col("callee_contract").alias("contract"), F.coalesce(F.nullif("callee_code", F.lit("")), stub).alias("code"))
    listed = lambda c, fields: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(*(x[k].alias(k) for k in fields)))
    few = lambda df, by, order, n: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)  # noqa: E731  before anything is gathered
    known = few(known, ["contract", "caller"], ["seq", "callee", "callee_contract"], callees)
    down = known.groupBy("contract", F.col("caller").alias("name")).agg(listed(called, ["name", "contract", "code"]).alias("called_functions"))
    signature = functions.select("contract", F.col("name").alias("caller"), F.col("signature").alias("caller_signature")).dropDuplicates(["contract", "caller"])
    inner = once.where("contract = callee_contract").join(signature, ["contract", "caller"], "left")
    calling = F.struct("seq", F.col("caller").alias("name"), F.coalesce("caller_signature", "caller").alias("signature"))
    inner = few(inner, ["contract", "callee"], ["seq", "caller"], callers)
    up = inner.groupBy("contract", F.col("callee").alias("name")).agg(listed(calling, ["name", "signature"]).alias("caller_functions"))
    return functions.join(down, ["contract", "name"], "left").join(up, ["contract", "name"], "left")
