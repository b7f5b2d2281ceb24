"""Writers: JSON lines by split, record files, logs, CSV, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.responses import strip_nulls
from ..functions.text import file_name, tokens
from ..operators.retrieve import signature


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines, a folder a split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"))


def record_name(prefix: str, kind: Column, id_: Column) -> Column:
    return file_name(F.concat(F.lit(f"{prefix}_"), F.regexp_replace(F.lower(kind), r"[-\s]+", "_"), F.lit("_"), id_.cast("string")))


def numbered(name: Column, seq: Column) -> Column:
    """name for its first row by seq, then name_1, name_2, .."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(seq)) - 1
    return F.when(n == 0, name).otherwise(F.concat(name, F.lit("_"), n.cast("string")))


def write_records(df: DataFrame, path: str, status: str, mode: str = "all", name: str | None = None, slim: list[str] | None = None) -> None:
    """JSON records by status: all, success, or those that failed. `name`: a folder a record, named by that column; `slim`: these columns only."""
    if mode == "success":
        df = df.where(F.col(status) == "success")
    elif mode == "failed":
        df = df.where(F.startswith(status, F.lit("failed")))
    by = [status, *([name] if name else [])]
    df = df.select(*by, *(c for c in slim if c not in by)) if slim else df
    df.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", True).json(path)


def write_contracts(df: DataFrame, path: str, functions: str = "functions") -> None:
    """JSON of contracts, with the number of their functions."""
    df.withColumn("num_functions", F.coalesce(F.size(functions), F.lit(0))).write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str, name: str = "name", page: str = "page") -> None:
    """Text pages, a folder each, named by a column."""
    pages.select(name, page).write.mode("overwrite").partitionBy(name).text(path)


def write_sidecar(df: DataFrame, path: str, id_: str, raw: str, mapped: Column) -> None:
    """JSON lines of id, raw types and what they map to, a line an input row."""
    df.select(F.col(id_).alias("id"), F.col(raw).alias("raw_types"), mapped.alias("mapped")).write.mode("overwrite").json(path)


def rewrite_tree(spark: SparkSession, source: str, path: str, pattern: str = "*.json") -> None:
    """A tree of JSON files as JSON lines of (path, value), the values without the nulls below `fix`."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(source, wholetext=True)
    df.select(F.input_file_name().alias("path"), strip_nulls(F.col("value")).alias("value")).write.mode("overwrite").json(path)


def write_index(docs: DataFrame, path: str, text: str = "code") -> None:
    """A retrieval index: the documents, and their distinct tokens and structural signature, as Parquet."""
    found = docs.withColumns({"tokens": F.array_distinct(tokens(F.col(text))), "signature": signature(F.col(text))})
    found.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, first: list[str] | None = None) -> None:
    """One header; preferred columns first, then the rest by name."""
    first = [c for c in first or [] if c in df.columns]
    df.select(*first, *sorted(set(df.columns) - set(first))).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, title: Column, sections: dict[str, Column]) -> DataFrame:
    """(page): a Markdown page a row; empty sections are left out."""
    parts = [F.concat(F.lit("# "), title)] + [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n## {n}\n\n"), c)) for n, c in sections.items()]
    return df.select(F.concat_ws("\n", *parts).alias("page"))


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """The first rows, for a look; never part of a build."""
    return df.limit(n)
