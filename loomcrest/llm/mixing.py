"""Mixing sources to target weights by a low-discrepancy schedule.

The multiples of the golden ratio (an integer Weyl sequence) fall through the cumulative targets and give each slot of
`block_words` words its source; slots are ranked within their source; rank r takes block r mod n of the source's
stream, whose documents lie in shuffled order. Nothing depends on partitioning, so reruns agree.

Scale: slots and documents get ranks and offsets from two-level prefix sums (chunks of slots; about sqrt(n) hash
buckets of documents), so no source is ever sorted in one task. Only one row per source reaches the driver
(`max_sources` is checked).

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, sorted
last; repeated rows lie beside each other in the stream and count separately; a very long text is cut into blocks like
any other; ids of any type and extra columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MODULUS = 1 << 31
#: The odd integer nearest MODULUS / golden ratio.
STEP = 1_327_217_885
SLOT_CHUNK = 1 << 16


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Each source's words: `share` of all by weight, at most `most` times its own, the excess reshared by weight."""
    out, live, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while live:
        total = sum(weights[i] for i in live)
        full = [i for i in sorted(live) if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in live:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        live -= set(full)
    return out


def _slots(spark, n_slots: int, bounds: np.ndarray, parts: int) -> DataFrame:
    """(source, chunk, at): the source of every slot, ranked within its chunk of SLOT_CHUNK slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                k = np.arange(chunk * SLOT_CHUNK, min((chunk + 1) * SLOT_CHUNK, n_slots), dtype=np.int64)
                x = ((k % MODULUS) * STEP % MODULUS) / MODULUS
                source = np.minimum(np.searchsorted(bounds, x, "right"), len(bounds) - 1).astype(np.int32)
                order = np.argsort(source, kind="stable")
                counts = np.bincount(source, minlength=len(bounds))
                at = np.empty(len(k), np.int64)
                at[order] = np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(np.full(len(k), chunk)), pa.array(at)], ["s", "chunk", "at"])

    chunks = -(-n_slots // SLOT_CHUNK)
    return spark.range(0, chunks, 1, max(1, min(chunks, parts))).mapInArrow(run, "s int, chunk long, at long")


def _row_hash(docs: DataFrame, seed: int):
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns), F.lit(seed))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3, block_words: int = 128, seed: int = 11, max_sources: int = 100_000) -> DataFrame:
    """doc_id, source, h (hash of the whole row), size, source_size, target, taken, takes_first: what the mix takes of each row.

    taken: words, repeats counted. takes_first: how often it takes the block where the row begins.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _row_hash(docs, seed).alias("h"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = C.materialize(rows)
    totals = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold a row for each")
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share, most)
    all_words = sum(goal)
    n_slots = round(all_words / block_words) if all_words >= block_words else int(all_words > 0)
    blocks = [-(-n // block_words) for n in sizes]
    plan = spark.createDataFrame([(i, r.source, r.n, float(t), b) for i, (r, t, b) in enumerate(zip(totals, goal, blocks, strict=True))], "s int, source string, source_size long, target double, blocks long")

    plan = F.broadcast(plan)  # a row per source, at most max_sources
    bounds = np.cumsum(goal) / all_words if all_words else np.array([1.0])
    slots = _slots(spark, n_slots, bounds, 4 * spark.sparkContext.defaultParallelism)
    before = slots.groupBy("s", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    # merge hints: the planner takes the slots' size for that of their chunk numbers, and would broadcast them
    ranked = slots.hint("merge").join(before.select("s", "chunk", F.coalesce("before", F.lit(0)).alias("before")), ["s", "chunk"]).select("s", (F.col("before") + F.col("at")).alias("rank"))
    takes = ranked.join(plan.select("s", "blocks"), "s").where(f"blocks > 0 and rank < {most} * blocks").groupBy("s", F.expr("rank % blocks").alias("block")).agg(F.count("*").alias("takes"))

    buckets = max(1, int(sum(r.docs for r in totals) ** 0.5))
    placed = rows.join(plan, rows.source.eqNullSafe(plan.source)).select("doc_id", rows.source, "size", "h", "s", "source_size", "target", F.expr(f"cast(((h / 18446744073709551616D) + 0.5D) * {buckets} as int)").alias("bucket"))
    starts = placed.groupBy("s", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size")
    offset = placed.withColumn("o", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("twin", F.row_number().over(within))
    offset = offset.join(starts.select("s", "bucket", F.coalesce("base", F.lit(0)).alias("base")), ["s", "bucket"]).withColumn("o", F.col("o") + F.col("base"))
    first, last = f"o div {block_words}", f"(o + size - 1) div {block_words}"
    cut = offset.withColumn("block", F.explode_outer(F.expr(f"case when size > 0 then sequence({first}, {last}) end")))
    cut = cut.withColumn("part", F.expr(f"least(o + size, (block + 1) * {block_words}) - greatest(o, block * {block_words})"))
    joined = cut.join(takes.hint("merge"), ["s", "block"], "left")
    keys = ["s", "bucket", "twin", "o", "doc_id", "source", "h", "size", "source_size", "target"]
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum(F.expr("part * coalesce(takes, 0)")), F.lit(0)).alias("taken"),
        F.coalesce(F.max(F.expr(f"case when block = {first} then takes end")), F.lit(0)).alias("takes_first"),
    ).select("doc_id", "source", "h", "size", "source_size", "target", "taken", "takes_first")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The mix at document grain: each row of docs as often as the schedule takes the block where it begins.

    Rows without words stay once. Columns are those of docs.
    """
    seed = how.get("seed", 11)
    got = mix(docs, text, source, doc_id, **how)
    h, total, same, twin = (C.fresh(docs, f"_mix_{c}") for c in ("h", "total", "same", "twin"))
    n = F.when(F.col("size") == 0, 1).otherwise(F.col("takes_first"))
    times = got.groupBy(F.col("h").alias(h)).agg(F.sum(n).alias(total), F.count("*").alias(same))
    # rows of one h are equal in every column: they share their total, the remainder going one each to the first
    left = docs.withColumn(h, _row_hash(docs, seed)).join(times, h)
    left = left.withColumn(twin, F.row_number().over(Window.partitionBy(h).orderBy(h)))
    n = F.expr(f"{total} div {same} + if({twin} <= {total} % {same}, 1, 0)")
    return left.withColumn(total, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
