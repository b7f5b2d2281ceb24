"""Readers of source trees, findings, bug logs and JSON lines. All return DataFrames; bad rows go as each format says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions.source import function_in
from ..functions.text import function_of_prompt, strip, unwrap_fence, vulnerability_info
from ..operators.joins import range_join


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def source_files(spark: SparkSession, path: str, pattern: str = "*.sol", sample: int | None = None, seed: int = 42) -> DataFrame:
    """(path, name, text): every file below path, whole; or `sample` of them by hash."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    df = df.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("name", base_name(F.col("path")))
    return df if sample is None else df.orderBy(F.md5(F.concat(F.lit(str(seed)), "path"))).limit(sample)


def labelled_files(spark: SparkSession, path: str, pattern: str = "*.sol", skip: tuple[str, ...] = ("dataset", "scripts", "tools")) -> DataFrame:
    """source_files with the label that the folder's name gives; hidden and skipped folders are left out."""
    df = source_files(spark, path, pattern).withColumn("label", F.element_at(F.split("path", "/"), -2))
    return df.where(~F.startswith("label", F.lit(".")) & ~F.col("label").isin(*skip))


def require(spark: SparkSession, *paths: str) -> None:
    """Raises unless every path (or pattern) exists."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path):
            raise FileNotFoundError(p)


def corpus_files(spark: SparkSession, sources: str, ranges: str, found: str, pattern: str = "*_ext.sol", limit: int | None = None) -> DataFrame:
    """source_files of a corpus whose range and finding files exist; with a limit the first by path."""
    require(spark, sources, ranges, found)
    df = source_files(spark, sources, pattern)
    return df.orderBy("path").limit(limit) if limit else df


def annotated_files(files: DataFrame, notes: DataFrame) -> DataFrame:
    """files with `vulnerabilities` (array<struct<category, lines>>) of the notes whose relative path theirs ends in; an empty list without any."""
    by = notes.groupBy(F.col("path").alias("_rel")).agg(F.array_sort(F.collect_list(F.struct("category", "lines"))).alias("vulnerabilities"))
    tail = lambda n: F.array_join(F.slice(F.split("path", "/"), -n, n), "/")
    empty = F.array().cast("array<struct<category:string,lines:array<int>>>")
    # dataset/<label>/<file>, or without the folder
    tried = files.join(by, F.col("_rel").isin(tail(3), tail(2)), "left")
    return tried.withColumn("vulnerabilities", F.coalesce("vulnerabilities", empty)).drop("_rel")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, lines) of a JSON list of files with vulnerabilities; separators become '/'."""
    df = spark.read.schema("path string, vulnerabilities array<struct<category:string,lines:array<int>>>").option("multiLine", True).json(path)
    return df.select(F.translate("path", "\\", "/").alias("path"), F.inline("vulnerabilities"))


def bug_logs(spark: SparkSession, path: str, pattern: str = "BugLog_*.csv") -> DataFrame:
    """(name, start, end, kind): 'location,length,kind' rows; headers and rows without integers drop out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    p = F.split("value", ",")
    at, n = (strip(F.get(p, F.lit(i))).try_cast("int") for i in (0, 1))
    df = df.select(F.regexp_extract(F.input_file_name(), r"BugLog_([^/]*)\.csv$", 1).alias("name"), at.alias("start"), n.alias("n"), strip(F.get(p, F.lit(2))).alias("kind"))
    return df.where("start is not null and n is not null").select("name", "start", (F.col("start") + F.col("n") - 1).alias("end"), "kind")


def paired_files(sources: DataFrame, logs: DataFrame) -> DataFrame:
    """Sources 'buggy_X.sol' joined with the log rows of X; those without a log drop out."""
    return sources.withColumn("name", F.regexp_extract("name", r"^buggy_(.*)\.sol$", 1)).join(logs, "name")


def function_name(signature: Column) -> Column:
    """Between the last '.' and the first '(', else 'unknown'."""
    n = F.substring_index(F.substring_index(signature, "(", 1), ".", -1)
    return F.when(n == "", "unknown").otherwise(n)


def function_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, signature, function, start, end) from 'file;signature;start;end' lines; other lines drop out."""
    p = F.split("value", ";")
    df = spark.read.text(path).where(F.size(p) == 4)
    df = df.select(base_name(strip(p[0])).alias("file"), strip(p[1]).alias("signature"), strip(p[2]).try_cast("int").alias("start"), strip(p[3]).try_cast("int").alias("end"))
    return df.where("start is not null and end is not null").withColumn("function", function_name(F.col("signature")))


def findings(spark: SparkSession, path: str, specs=taxonomy.VOTE_SPECS) -> DataFrame:
    """(file, key, category, least, kind, location, tool) from 'file token location... tool' lines; unknown tokens drop out."""
    table = spark.createDataFrame([(t, k, c, n, w) for k, c, n, ts, w in specs for t in ts], "token string, key string, category string, least int, kind string")
    p = F.split(strip(F.col("value")), r"\s+")
    df = spark.read.text(path).where(F.size(p) >= 4).select(base_name(p[0]).alias("file"), p[1].alias("token"), F.element_at(p, -1).alias("tool"), p.alias("p"))
    df = df.join(F.broadcast(table), "token")
    where = F.when(F.col("kind") == "function", F.array_join(F.slice("p", F.lit(3), F.size("p") - 3), " ")).otherwise(F.get("p", F.lit(2)).try_cast("int").cast("string"))
    return df.select("file", "key", "category", "least", "kind", where.alias("location"), "tool").where("location is not null")


def voted_functions(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """(file, signature, category, lines, tools): findings with enough votes inside functions; a file's last range of a signature holds."""
    votes = found.groupBy("file", "key", "category", "least", "kind", "location").agg(F.array_sort(F.collect_set("tool")).alias("tools")).where("size(tools) >= least")
    by_line = range_join(votes.where("kind = 'line'").withColumn("line", F.col("location").cast("int")), ranges, "file", "line", "start", "end")
    last = ranges.groupBy("file", "signature").agg(F.max_by("start", F.struct("start", "end")).alias("line"))
    by_name = votes.where("kind = 'function'").withColumnRenamed("location", "signature").join(last, ["file", "signature"])
    cols = ["file", "signature", "category", "line", "tools"]
    both = by_line.select(*cols).unionByName(by_name.select(*cols))
    return both.groupBy("file", "signature", "category").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools"))


def malformed_lines(spark: SparkSession, path: str, schema: str, most: int = 5) -> list[tuple[str, int]]:
    """(file, line number) of the first malformed JSON lines, at most so many. Blank lines are none."""
    m = F.col("_metadata")
    kind = f"{schema}, _corrupt_record string"
    lines = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"))
    bad = F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull() & (strip(F.col("value")) != "")
    found = lines.where(bad).orderBy("file", "block", "n").limit(most).collect()
    before = lambda r: lines.where((F.col("file") == r.file) & ((F.col("block") < r.block) | ((F.col("block") == r.block) & (F.col("n") < r.n)))).count()
    return [(r.file, before(r) + 1) for r in found]


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, limit: int | None = None) -> DataFrame:
    """JSON lines; malformed ones drop out, or fail the read with the file and the line of the first ones. With a limit the first of them."""
    if strict and (bad := malformed_lines(spark, path, schema)):
        raise ValueError("malformed JSON: " + ", ".join(f"{file}:{line}" for file, line in bad))
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.limit(limit) if limit else df


def raw_scan(df: DataFrame, dataset: str | None = None, limit: int = 50) -> DataFrame:
    """Rows for an audit that will show `limit` of them: of one data set, fifty times as many, 2000 at least."""
    return (df.where(F.col("dataset_name") == dataset) if dataset else df).limit(max(50 * limit, 2000))


def json_lines_counted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines stay, as `_corrupt_record`, so that totals count them."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def retrieval_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(code, fixed_code, vulnerability_type, id, instruction) from chat samples; empty outputs drop out."""
    df = json_lines(spark, path, "id string, instruction string, input string, output string").where(strip(F.coalesce("output", F.lit(""))) != "")
    code = strip(F.regexp_extract("input", r"(?s)\*\*Source Code:\*\*\s*(.*)$", 1))
    kind = F.get(taxonomy_types(F.col("input")), F.lit(0))
    df = df.select(F.when(code != "", code).otherwise(F.col("input")).alias("code"), F.col("output").alias("fixed_code"), F.coalesce(kind, F.lit("unknown")).alias("vulnerability_type"), "id", "instruction")
    return df.limit(limit) if limit else df


def repair_corpus(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """(code, fixed_code, vulnerability_type, id, instruction) of chat samples (id, instruction, input, output).

    The code is the prompt's function, cut out of the contract that it shows, else the whole input; the fixed code is that function
    in the answer, else the answer's first function, else its first fence's content or all of it. Samples with an empty
    output drop out; the type is the first that the prompt names, or Unknown. A limit counts what is left, by id.
    """
    s = samples.where(strip(F.coalesce("output", F.lit(""))) != "").withColumn("input", F.coalesce("input", F.lit("")))
    mark, tail = "**Source Code:**", "Please provide the complete fixed version"
    behind = F.when(F.contains("input", F.lit(mark)), F.substr("input", F.instr("input", mark) + len(mark)))
    contract = strip(F.when(F.contains(behind, F.lit(tail)), F.left(behind, F.instr(behind, tail) - 1)).otherwise(behind))
    s = s.select("id", "instruction", "input", contract.alias("contract"), function_of_prompt(F.col("input")).alias("name"), unwrap_fence(F.col("output")).alias("answer"))
    first = F.nullif(F.regexp_extract("answer", r"(?U)\bfunction\s+([A-Za-z_]\w*)", 1), F.lit(""))
    own, other = function_in(F.col("answer"), F.col("name")), function_in(F.col("answer"), first)
    code = F.coalesce(function_in(F.col("contract"), F.col("name")), strip(F.col("input")))
    out = s.select(code.alias("code"), F.coalesce(own, other, "answer").alias("fixed_code"), vulnerability_info(F.col("input"))["types"][0].alias("vulnerability_type"), "id", "instruction")
    return out.orderBy("id").limit(limit) if limit else out


def taxonomy_types(c: Column) -> Column:
    from ..functions.text import type_line

    return type_line(c)


def evaluation_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified, meta, metrics, details: variants), one row a file; summaries and invalid files drop out."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.try_parse_json("value").alias("v"))
    return df.where("v is not null").where(base_name(F.col("path")) != "summary.json").select("path", "modified", *(F.try_variant_get("v", f"$.{c}", "variant").alias(c) for c in ("meta", "metrics", "details")))


def union_sources(sources: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """name -> (type, rows): all rows, stamped with dataset_name and dataset_type."""
    out = None
    for name, (kind, df) in sources.items():
        df = df.withColumns({"dataset_name": F.lit(name), "dataset_type": F.lit(kind)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def normalize_config(config: dict) -> dict:
    """A configuration with a list `datasets`, made of the older keys where it is absent; the input stays as it is."""
    if "datasets" in config:
        return config
    kinds = [("wild", True), ("curated", False)]
    made = [{"name": f"smartbugs_{k}", "path": config[f"smartbugs_{k}_dir"], "type": k, "sample_limit": config.get(f"{k}_sample_limit"), "quality_filter": q} for k, q in kinds if f"smartbugs_{k}_dir" in config]
    return config | {"datasets": made}
