"""Selection of records to annotate, repair and evaluate; routing and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy
from .joins import skip_done


def json_null(c: Column) -> Column:
    """The JSON text null, which is not SQL NULL."""
    return F.coalesce(F.trim(c) == "null", F.lit(False))


def to_annotate(df: DataFrame, audit: str = "llm_audit", tool: str = "slither_result", label: str = "is_vulnerable") -> DataFrame:
    """Rows with a tool result whose audit is JSON null, and that label or tool call vulnerable."""
    flagged = F.coalesce(F.get_json_object(tool, "$.is_vulnerable") == "true", F.lit(False))
    return df.where(F.col(tool).isNotNull() & json_null(F.col(audit)) & (F.coalesce(F.col(label), F.lit(False)) | flagged))


def to_fix(df: DataFrame, done: DataFrame | None, key: str = "id", audit: str = "llm_audit", types: list[str] | None = None, least_severity: float = 0, limit: int | None = None) -> DataFrame:
    """Rows whose audit says vulnerable, severe enough and of a wanted type, not yet fixed. The limit comes last."""
    a = F.col(audit)
    df = df.where(a.isNotNull() & ~json_null(a) & (F.get_json_object(a, "$.label") == "vulnerable"))
    if least_severity > 0:
        df = df.where(F.coalesce(F.get_json_object(a, "$.severity").try_cast("double"), F.lit(0.0)) >= least_severity)
    if types:
        have = F.transform(F.from_json(F.get_json_object(a, "$.vulnerability_types"), "array<string>"), normal_type)
        df = df.where(F.arrays_overlap(have, F.array(*(F.lit(t) for t in resolve_types(types)))))
    if done is not None:
        df = skip_done(df, done, key)
    return df.limit(limit) if limit else df


def normal_type(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]", "_")


def resolve_types(wanted: list[str], specs=taxonomy.VOTE_SPECS) -> list[str]:
    """Keys and finding tokens become categories; anything else stands for itself; all normalized."""
    by = {k: c for k, c, *_ in specs} | {t: c for _, c, _, ts, _ in specs for t in ts}
    fold = {k.upper(): v for k, v in by.items()}
    return [(by.get(w) or fold.get(w.upper()) or w).strip().lower().replace("-", "_").replace(" ", "_") for w in wanted]


def type_set(audit: Column, column: Column, label: Column, details: Column) -> Column:
    """Types of the audit, the column and the label, then of the details (category before type), each once."""
    empty = F.array().cast("array<string>")
    named = F.transform(F.coalesce(details, F.array().cast("array<struct<category:string,type:string>>")), lambda d: F.coalesce(d["category"], d["type"]))
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(c, empty) for c in (audit, column, label)), named)))


def kept_contract(functions: Column, version: Column, least: int = 2, most: int = 50) -> Column:
    """A version, between `least` and `most` functions, one of them public or external."""
    reachable = F.exists(functions, lambda f: f["visibility"].isin("public", "external"))
    return F.coalesce((F.size(functions).between(least, most)) & (F.coalesce(version, F.lit("")) != "") & reachable, F.lit(False))


def vulnerable(label: Column, tool: Column) -> Column:
    return F.coalesce(label, tool, F.lit(False))


def sample_id(dataset: Column, contract: Column, function: Column, start: Column) -> Column:
    or_ = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return F.concat_ws("_", or_(dataset, "wild"), or_(contract, "unknown"), or_(function, "unknown"), F.coalesce(start, F.lit(0)).cast("string"))


def function_id(sample: Column) -> Column:
    """The number in 'fix_<n>', or of the text itself; else null."""
    return F.coalesce(F.regexp_extract(sample, r"fix_(\d+)", 1).try_cast("long"), sample.try_cast("long"))


def route(audit: Column, label: Column, fallback: Column) -> Column:
    """no_annotation, safe (anything but the label vulnerable) or processed; a row without an audit may use the annotation made of its label, which is vulnerable."""
    none = audit.isNull() | F.coalesce(F.trim(audit).isin("", "null", "{}"), F.lit(False))
    said = F.when(none, "vulnerable").otherwise(label)
    return F.when(none & fallback.isNull(), "no_annotation").when(said.eqNullSafe(F.lit("vulnerable")), "processed").otherwise("safe")


def solved(df: DataFrame, which: str = "all", correct: str = "correct_generated") -> DataFrame:
    return df if which == "all" else df.where(F.col(correct) > 0 if which == "solved" else F.col(correct) == 0)


def configs_left(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Configurations without a finished run; nulls are equal."""
    g, d = grid.alias("g"), done.select(*keys).distinct().alias("d")
    return g.join(d, [F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys], "left_anti")


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.max_by(row, F.col(at)).alias("_r")).select("_r.*")


def label_of(df: DataFrame, truth: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """df with its ground truth: of several entries of one key the first."""
    cols = [c for c in truth.columns if c not in (*keys, seq)]
    one = truth.groupBy(*keys).agg(*(F.min_by(c, seq).alias(c) for c in cols))
    return df.join(one, keys, "left")


def used_events(events: Column, code: Column) -> Column:
    """Events that the code emits or calls."""
    return F.filter(events, lambda e: F.contains(code, F.concat(F.lit("emit "), e["name"])) | F.contains(code, F.concat(e["name"], F.lit("("))))
