"""Building the corpus: new rows, splits, selections and the projections that stages hand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key
from .candidates import normal_type, resolve_types, sample_id
from .curate import balanced_sample, dataset_filter, dedup_priority, line_window, seeded, split
from .joins import skip_done


def new_rows(batch: DataFrame, stored: DataFrame, text: str, rank: Column, seq: str) -> DataFrame:
    """The best row of every text of a batch that the store lacks, with its `_hash`.

    stored has the column _hash. A later row of higher rank does not replace a stored one.
    """
    best = dedup_priority(batch, text, rank, seq).withColumn("_hash", content_key(F.col(text)))
    return best.join(stored.select("_hash").distinct(), "_hash", "left_anti")


def corpus_split(df: DataFrame, id_: str, kind: str = "dataset_type", vulnerable: str = "is_vulnerable", ratios: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> DataFrame:
    """df with `split`: curated rows are test; wild and solidifi rows go train, val and test by type and label; rows of any other type go nowhere and drop out."""
    flag = F.coalesce(F.col(vulnerable).cast("boolean"), F.lit(False))
    dealt = df.where(F.col(kind).isin("wild", "solidifi")).withColumn("_v", flag)
    train, val = ratios
    out = split(dealt, id_, {"train": train, "val": val, "test": 1 - train - val}, [kind, "_v"], seed).drop("_v")
    return out.unionByName(df.where(F.col(kind) == "curated").withColumn("split", F.lit("test")))


def split_counts(df: DataFrame, vulnerable: str = "is_vulnerable") -> DataFrame:
    """(split, n, vulnerable, safe) of a split corpus."""
    flag = F.coalesce(F.col(vulnerable).cast("boolean"), F.lit(False))
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(flag).alias("vulnerable"), F.count_if(~flag).alias("safe"))


def sample_then_split(df: DataFrame, id_: str, most: int, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """`most` rows in seeded order (all where there are fewer), split in another seeded order."""
    few = df.withColumn("_h", seeded(seed, id_)).orderBy("_h", id_).limit(most).drop("_h")
    return split(few, id_, ratios, seed=seed + 1)


def head_shuffled(df: DataFrame, order: str, id_: str, most: int, seed: int = 42) -> DataFrame:
    """The first `most` rows by order, with `place`, their rank in a seeded order. The limit comes before the shuffle."""
    return df.orderBy(order, id_).limit(most).withColumn("_h", seeded(seed, id_)).orderBy("_h", id_).drop("_h")


def balanced_window(df: DataFrame, text: str, label: str, id_: str, total: int, ratio: float, least: int = 5, most: int = 100, seed: int = 42) -> DataFrame:
    """balanced_sample of the rows whose text has between `least` and `most` lines."""
    return balanced_sample(df.where(line_window(F.col(text), least, most)), label, id_, total, ratio, seed)


def to_fix_by_label(df: DataFrame, done: DataFrame | None, key: str = "id", kinds: list | None = None, names: list | None = None, only_vulnerable: bool = True, least_severity: float = 0, types: list[str] | None = None, column: str = "types") -> DataFrame:
    """Rows that labels call vulnerable, severe enough, of a wanted data set and type, and not yet fixed. `column` holds a row's types."""
    df = dataset_filter(df, kinds, names, least_severity)
    if only_vulnerable:
        df = df.where(F.coalesce(F.col("is_vulnerable").cast("boolean"), F.lit(False)))
    if types:
        wanted = F.array(*(F.lit(t) for t in resolve_types(types)))
        df = df.where(F.arrays_overlap(F.transform(F.col(column), normal_type), wanted))
    return skip_done(df, done, key) if done is not None else df


def processing_counters(df: DataFrame, source: str, status: str) -> DataFrame:
    """(source, total, valid, errors, percent): status is 'ok' or an error."""
    ok = F.col(status).eqNullSafe(F.lit("ok"))
    return df.groupBy(source).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("errors"), (F.count_if(ok) * 100 / F.count("*")).alias("percent"))


def reduction(extracted: int, kept: int) -> float:
    """The percentage that filters and deduplication took away; 0 of nothing."""
    return (1 - kept / extracted) * 100 if extracted else 0.0


def primary_type(audit_types: Column, audit_type: Column, fix_types: Column) -> Column:
    """The audit's first type, else its single one, else the first that the fix names, else 'unknown'."""
    return F.coalesce(F.get(audit_types, F.lit(0)), F.nullif(F.trim(audit_type), F.lit("")), F.get(fix_types, F.lit(0)), F.lit("unknown"))


def store_record(df: DataFrame) -> DataFrame:
    """The store's columns of processed functions (dataset, contract_name, function_name, start_line, label, ..), with their defaults.

    label: struct<is_vulnerable, severity, reasoning, vulnerability_type, vulnerability_details array<struct<type>>>. Types come
    from details; where there are none, a vulnerable row has the label's single type.
    """
    lab = F.col("label")
    vulnerable = F.coalesce(lab["is_vulnerable"], F.lit(False))
    empty = F.array().cast("array<string>")
    named = F.transform(lab["vulnerability_details"], lambda d: d["type"])
    single = F.when(vulnerable & (F.coalesce(lab["vulnerability_type"], F.lit("")) != ""), F.array(lab["vulnerability_type"])).otherwise(empty)
    types = F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(single)
    made = {
        "sample_id": sample_id(F.col("dataset"), F.col("contract_name"), F.col("function_name"), F.col("start_line")),
        "is_vulnerable": vulnerable,
        "vulnerability_types": types,
        "severity": F.coalesce(lab["severity"].cast("double"), F.lit(0.0)),
        "reasoning": F.coalesce(lab["reasoning"], F.lit("")),
    }
    return df.withColumns(made)


def task_record(df: DataFrame) -> DataFrame:
    """What annotating and repairing read of a stored function: empty objects and lists, and version 0.8.0, where a column is null."""
    defaults = {"contract_context": "{}", "called_functions": "[]", "caller_functions": "[]", "slither_result": "{}", "llm_audit": "{}", "solidity_version": "0.8.0"}
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in defaults.items() if c in df.columns})


def lookup(df: DataFrame, sample: str, raw: str = "raw_data", fields: tuple[str, ...] = ("function_name", "function_code", "contract_name", "slither_result", "label")) -> DataFrame:
    """(record): the first row of a sample as JSON, its raw record if it has one, else made of five fields; no row without the sample."""
    made = F.to_json(F.struct(*(F.col(c) for c in fields if c in df.columns)))
    return df.where(F.col("sample_id") == sample).limit(1).select(F.coalesce(F.nullif(F.col(raw), F.lit("")), made).alias("record"))


def annotated(df: DataFrame, audits: DataFrame, key: str = "id") -> DataFrame:
    """df with its audits (key, llm_audit JSON) stored: the audit, its reasoning (a list's items, a line each), and the audit inside raw_data. Rows without an audit stay as they are."""
    a = audits.select(F.col(key), F.col("llm_audit").alias("_audit")).where("_audit is not null")
    new = F.col("_audit").isNotNull()
    field = F.get_json_object("_audit", "$.reasoning")
    listed = F.array_join(F.from_json(field, "array<string>"), "\n")
    said = F.when(F.startswith(field, F.lit("[")), listed).otherwise(field)
    old = F.coalesce(F.from_json("raw_data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    raw = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != "llm_audit"), F.create_map(F.lit("llm_audit"), F.col("_audit"))))
    out = df.join(a, key, "left")
    return out.withColumns({
        "llm_audit": F.when(new, F.col("_audit")).otherwise(F.col("llm_audit")),
        "reasoning": F.when(new & (F.coalesce(said, F.lit("")) != ""), said).otherwise(F.col("reasoning")),
        "raw_data": F.when(new, raw).otherwise(F.col("raw_data")),
    }).drop("_audit")


def backfill(df: DataFrame, types: str, into: str, derived: Column) -> DataFrame:
    """df with `derived` put into the column `into`, and a `status`: skipped_no_types, skipped_unchanged or updated. Null counts as the empty list."""
    has = F.coalesce(F.size(F.col(types)), F.lit(0)) > 0
    same = F.coalesce(F.col(into), F.array().cast("array<string>")) == derived
    status = F.when(~has, "skipped_no_types").when(same, "skipped_unchanged").otherwise("updated")
    return df.withColumn("status", status).withColumn(into, F.when(F.col("status") == "updated", derived).otherwise(F.col(into)))


def backfill_statistics(done: DataFrame) -> DataFrame:
    return done.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("updated", "skipped_no_types", "skipped_unchanged")))
