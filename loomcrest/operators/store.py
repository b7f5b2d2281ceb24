"""Merges and versions over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import swc_ids
from .joins import keep_last


def upsert(existing: DataFrame, new: DataFrame, key: str, seq: str, keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """new's last row of a key replaces the existing one, whose `keep` columns stay."""
    last = keep_last(new, [key], seq).drop(seq)
    e, n = existing.alias("e"), last.alias("n")
    cols = []
    for c in existing.columns:
        old, fresh = F.col(f"e.{c}"), F.col(f"n.{c}") if c in last.columns else F.lit(None)
        cols.append((F.coalesce(old, fresh) if c in keep or c == key else F.when(F.col(f"n.{key}").isNotNull(), fresh).otherwise(old)).alias(c))
    return e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def append_versions(existing: DataFrame, new: DataFrame, key: str, version: str, seq: str) -> DataFrame:
    """new with version numbers that go on from the highest of each key."""
    top = existing.groupBy(key).agg(F.max(version).alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return new.join(top, key, "left").withColumn(version, F.coalesce("_top", F.lit(0)) + n).drop("_top")


def append_fixes(existing: DataFrame, new: DataFrame, seq: str, key: str = "function_id", types: str = "vulnerabilities_fixed") -> DataFrame:
    """append_versions of fixes, with the identifiers that their types map to."""
    return append_versions(existing, new, key, "fix_version", seq).withColumn("swc_ids", swc_ids(F.coalesce(F.col(types), F.array().cast("array<string>"))))


def add_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Adds what is missing, as nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})
