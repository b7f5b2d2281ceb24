"""Secret scans with multipart credential linking, native DataFrame operations only.

Base spans are those of three patterns (assign, access, hex). Weak candidates (a mixed-case 40-character key, a short
assigned password, an account name, an endpoint) are of little meaning alone; an interval join within a scope of
`scope` code points reports one only where complementary parts lie near:

  secret part    needs an identifier or an endpoint in its scope
  identifier     needs a secret part in its scope
  endpoint       needs both an identifier and a secret part in its scope

Base spans always stay, and count as parts: access as identifier, assign as secret; hex counts as neither, since long
digit runs are often no credential. A weak candidate that overlaps a base span is dropped, and is no part for others.

Positions come from cutting the text at the matches and summing piece lengths in code points. Spans may be of any
length and stand in every position bucket that they touch. The join is on (text, bucket) against at most one row a part
and bucket (its first start and last end), so dense texts make no pairs. Texts are keyed by (id, hash), so equal rows share one analysis.

Defined results: a null or empty text has no spans; very long texts are scanned whole; repeated rows each get their row;
null ids are kept, and ids of any type; other columns are not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: kind -> (pattern, group to measure, least length of that group)
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: kind -> (pattern, group to measure, least length, part)
WEAK = {
    "key": (r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+]{0,39}[a-z])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])", 0, 40, "secret"),
    "phrase": (r"""(?<![A-Za-z])(?i:pwd|pass|passphrase|password|passwd|secret|token|api_?key)["']?\x20{0,4}[:=]\x20{0,4}["']?([^\s"',;]{6,}+)""", 1, 6, "secret"),
    "account": (r"""(?<![A-Za-z])(?i:user|username|login|account|client_id|access_key_id)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9_.@-]{2,}+)""", 1, 2, "identifier"),
    "endpoint": (r"(?<![A-Za-z0-9])(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}+", 0, 3, "endpoint"),
}
PART = {"assign": "secret", "access": "identifier", "hex": None} | {k: v[3] for k, v in WEAK.items()}
ORDER = {k: i for i, k in enumerate([*BASE, *WEAK])}
#: A text without any of these has no candidate; the engine's search for them is cheaper than the patterns.
_HINT = r"(?i:passw|pwd|pass['\"]?\x20{0,4}[:=]|passphrase|secret|token|api_?key|user|login|account|client_id|access_key)|AKIA|[0-9a-f]{16}|://|[A-Za-z0-9/+]{40}"


def _matches(kind: str, text: Column) -> Column:
    """array<struct<kind, before, length, measure>>: per match the code points between it and the match before, and its own."""
    pattern, group, least = (BASE.get(kind) or WEAK[kind])[:3]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("b"), F.transform(found, F.length).alias("l"), F.transform(part, F.length).alias("m")), lambda x: F.struct(F.lit(kind).alias("kind"), x["b"].alias("before"), x["l"].alias("length"), (x["m"] >= least).alias("ok")))


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = 200) -> DataFrame:
    """doc_id, key (hash of the text), kind, start, end, base: one row for each span of each different (id, text)."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(t.rlike(_HINT)).withColumn("key", F.xxhash64("text"))
    some = rows.select("doc_id", "key", F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), _matches(k, t).alias("found")) for k in ORDER)), lambda x: F.size(x["found"]) > 0).alias("by"))
    each = some.select("doc_id", "key", F.explode("by").alias("b")).select("doc_id", "key", F.col("b.kind").alias("kind"), F.posexplode("b.found").alias("n", "m"))
    each = each.groupBy("doc_id", "key", "kind", "n").agg(F.first("m").alias("m"))  # of equal rows, one
    so_far = Window.partitionBy("doc_id", "key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.before") + F.col("m.length")).over(so_far).cast("long"))
    placed = placed.where("m.ok").select("doc_id", "key", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("kind").isin(*BASE).alias("base"))
    placed = C.materialize(placed)
    base = placed.where("base")
    part = F.create_map(*(F.lit(x) for k, p in PART.items() for x in (k, p or "")))[F.col("kind")]
    weak = placed.where("not base").withColumn("part", part)
    touched = lambda df: df.withColumn("bucket", F.explode(F.expr(f"sequence(start div {scope}, (end - 1) div {scope})")))
    on = [F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")), F.col("w.key") == F.col("o.key")]
    near_by = [*on, F.col("w.bucket") == F.col("o.bucket")]
    covered = touched(base).select("doc_id", "key", F.col("start").alias("s"), F.col("end").alias("e"), "bucket")
    hit = touched(weak).alias("w").join(covered.alias("o"), [*near_by, F.expr("o.s < w.end and o.e > w.start")], "left_semi").select("doc_id", "key", "kind", "start").distinct()
    fresh = weak.alias("w").join(hit.alias("o"), [*on, F.expr("o.kind = w.kind and o.start = w.start")], "left_anti")
    # nearest to what lies after a bucket is its last end, to what lies before it its first start
    parts = base.withColumn("part", part).where("part <> ''").unionByName(fresh.select(*base.columns, "part"))  # what a base span covers is no part
    sums = touched(parts).groupBy("doc_id", "key", "bucket", F.col("part").alias("other")).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    around = fresh.withColumn("bucket", F.explode(F.expr(f"sequence(start div {scope} - 2, (end - 1) div {scope} + 2)")))
    pairs = around.alias("w").join(sums.alias("o"), [*near_by, F.expr(f"o.other <> w.part and case when o.bucket < w.start div {scope} then w.start - o.last <= {scope} when o.bucket > (w.end - 1) div {scope} then o.first - w.end <= {scope} else true end")])
    linked = pairs.groupBy("w.doc_id", "w.key", "w.kind", "w.part", "w.start", "w.end").agg(F.max((F.col("other") == "identifier").cast("int")).alias("i"), F.max((F.col("other") == "secret").cast("int")).alias("s"), F.max((F.col("other") == "endpoint").cast("int")).alias("e"))
    linked = linked.where("case part when 'secret' then i + e > 0 when 'identifier' then s > 0 else i + s = 2 end")
    return base.unionByName(linked.select("doc_id", "key", "kind", "start", "end", F.lit(False).alias("base")))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = 200) -> DataFrame:
    """doc_id, key, spans: for each different (id, text) with a span, its spans by start, then kind."""
    found = find_spans(docs, text, doc_id, scope)
    rank = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))[F.col("kind")]
    return found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "base"))).alias("spans"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).withColumnsRenamed({"doc_id": "i", "key": "k"})
    out = docs.select("doc_id", F.xxhash64("text").alias("key"))
    out = out.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>>)"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(said(F.filter(spans, lambda x: x["base"])), 256).alias("base_sha256"), said(spans).alias("spans"))
