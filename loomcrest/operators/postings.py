"""A postings index at rest, appended to without a rebuild, and BM25 that leaves out what cannot be among the k best.

An index is a folder of segments; each segment is one call of `append`:
  documents  doc_id, slot (its place inside its group of GROUP documents), group, dl: its tokens
  terms      token, df
  postings   token, grp, most_tf, least_dl, postings: array<struct<slot, tf, dl>> of the group's documents with the
             token; a file has the groups that one task read, some at a time in order of tokens, so nothing is exchanged
  size       documents and tokens of the segment; a segment counts from when this is written

A search knows each token's idf over all segments, then bounds a group by the sum, over the query's tokens, of idf times
what the largest tf in the shortest document would give. The `first` groups of the best bounds are scored in full; their
k-th best score is a floor, and only groups whose bound reaches it are scored as well. Blocks of tokens that no query has
are never looked at, those of groups below the floor are joined away by their few bytes of (token, group) before their
postings are opened. The others are packed, a few rows a group, and go to the task that scores the group and keeps the k
best of each query, so no row a pair of query and document is exchanged; a task holds one block of queries, and groups
pass by. Scores are those of `retrieve.bm25` over the documents of all segments.

A null text has no tokens and counts as a document of length 0; repeated ids are documents each, whose scores are
reported each; a query without known tokens finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import written
from .retrieve import top_k

GROUP_BITS = 6
GROUP = 1 << GROUP_BITS
#: Tokens of a step of an append, as far as groups are whole.
_COUNT_TOKENS = 1 << 20
#: Tokens of queries, and groups to be scored, that are broadcast; tokens of a block of queries.
_ASKED, _SENT_GROUPS, _BLOCK_TOKENS = 1 << 20, 1 << 18, 1 << 20


def append(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", segment: str | None = None) -> str:
    """Writes docs as a new segment below path and returns its name. A segment that a failed call left behind has no size and is never read."""
    spark = docs.sparkSession
    segment = segment or uuid.uuid4().hex
    at = lambda table: f"{path}/{table}/segment={segment}"
    number = F.monotonically_increasing_id()  # fixed by being written
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t")).withColumn("n", number)
    rows.select("doc_id", F.shiftright("n", GROUP_BITS).alias("grp"), F.col("n").bitwiseAND(GROUP - 1).cast("int").alias("slot"), F.coalesce(F.size("t"), F.lit(0)).alias("dl"), F.coalesce("t", F.array().cast("array<string>")).alias("t")).write.mode("overwrite").option("compression", "zstd").parquet(at("documents"))
    stored = spark.read.parquet(at("documents"))
    _blocks(stored).write.mode("overwrite").option("compression", "zstd").parquet(at("postings"))
    kept = spark.read.parquet(at("postings"))
    kept.groupBy("token").agg(F.sum(F.size("postings")).alias("df")).write.mode("overwrite").option("compression", "zstd").parquet(at("terms"))
    stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).coalesce(1).write.mode("overwrite").parquet(at("size"))
    return segment


def _blocks(stored: DataFrame) -> DataFrame:
    """(token, grp, most_tf, least_dl, postings) of documents (grp, slot, dl, t).

    Documents of a group stand behind one another in a file, so a task counts them where it reads them. Where a read ends
    inside a group, two blocks share a token: sums over blocks count each posting once, and a bound is only higher by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            group = whole.column(0).to_numpy(zero_copy_only=False)
            cuts = np.append(0, np.flatnonzero(np.diff(group)) + 1)
            upto = np.cumsum(pc.list_value_length(whole.column(3)).to_numpy(zero_copy_only=False))
            start = 0
            while start < whole.num_rows:  # whole groups, of so many tokens in all
                most = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _COUNT_TOKENS, "right"))
                stop = int(np.append(cuts[cuts <= most], start)[-1]) if most < whole.num_rows else whole.num_rows
                if stop <= start:
                    stop = int(np.append(cuts[cuts > start], whole.num_rows)[0])
                yield counted(whole.slice(start, stop - start))
                start = stop

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        group, slot, dl = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
        coded = batch.column(3).flatten().dictionary_encode()
        known = len(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(dl)), pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
        # rows are in order of their groups, and of their slots inside them; blocks are in order of tokens, then of groups
        place = np.cumsum(np.append(0, np.diff(group) != 0))[: len(dl)]
        places = int(place[-1]) + 1 if len(dl) else 1
        order = np.lexsort((slot, place))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        by_token = pc.sort_indices(coded.dictionary).to_numpy()
        token_rank = np.empty(known, np.int64)
        token_rank[by_token] = np.arange(known)
        each, tf = np.unique((token_rank[code] * places + place[row]) * len(dl) + rank[row], return_counts=True)
        block, at = np.divmod(each, len(dl)) if len(dl) else (each, each)
        at, tf = order[at], tf.astype(np.int32)
        begins = np.flatnonzero(np.concatenate((np.ones(min(len(block), 1), bool), block[1:] != block[:-1])))
        none = np.zeros(0, np.int32)
        entries = pa.StructArray.from_arrays([pa.array(slot[at].astype(np.int32)), pa.array(tf), pa.array(dl[at].astype(np.int32))], ["slot", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(block)).astype(np.int32)), entries)
        most = np.maximum.reduceat(tf, begins) if len(begins) else none
        least = np.minimum.reduceat(dl[at], begins).astype(np.int32) if len(begins) else none
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(by_token[block[begins] // places])), pa.array(group[at[begins]]), pa.array(most), pa.array(least), lists], ["token", "grp", "most_tf", "least_dl", "postings"])

    return stored.select("grp", "slot", "dl", "t").mapInArrow(run, "token string, grp long, most_tf int, least_dl int, postings array<struct<slot:int,tf:int,dl:int>>")


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's rows of the whole segments."""
    sizes = spark.read.option("basePath", f"{path}/size").parquet(f"{path}/size")
    names = [r.segment for r in sizes.select(F.col("segment").cast("string").alias("segment")).distinct().collect()]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*(f"{path}/{table}/segment={n}" for n in names)).withColumn("segment", F.col("segment").cast("string"))


def statistics(spark: SparkSession, path: str, epsilon: float = 0.25) -> DataFrame:
    """(token, idf, avgdl) over all segments; a negative idf becomes epsilon times the mean idf."""
    df = _read(spark, path, "terms").groupBy("token").agg(F.sum("df").alias("df"))
    size = F.broadcast(_read(spark, path, "size").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl")))  # a row
    idf = df.crossJoin(size).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(idf.agg(F.avg("idf").alias("mean_idf")))  # a row
    return idf.crossJoin(mean).select("token", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"), "avgdl")


def _gain(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (sizes[0] of them), starts[1], .."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _packed(blocks: DataFrame) -> DataFrame:
    """blocks (segment, grp, code, postings) as a row a group and batch: the blocks' codes and how many postings each has; the postings' slots and tfs; dls of the group's slots, 0 where none is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column(0).dictionary_encode()
            segment, grp, code = segments.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            count = pc.list_value_length(batch.column(3)).to_numpy()
            slot, tf, dl = (x.to_numpy() for x in batch.column(3).flatten().flatten())
            order = np.lexsort((code, grp, segment))
            entry = _ranges((np.cumsum(count) - count)[order], count[order])
            segment, grp, code, count = segment[order], grp[order], code[order], count[order]
            first = np.ones(len(order), bool)
            first[1:] = (segment[1:] != segment[:-1]) | (grp[1:] != grp[:-1])
            group = np.cumsum(first) - 1
            blocks_of = np.bincount(group)
            postings_of = np.bincount(group, weights=count).astype(np.int64)
            dls = np.zeros((len(blocks_of), GROUP), np.int32)
            dls[np.repeat(group, count), slot[entry]] = dl[entry]
            cuts = np.append(0, np.cumsum(postings_of)).astype(np.int32)
            slots = pa.Array.from_buffers(pa.binary(), len(blocks_of), [None, pa.py_buffer(cuts), pa.py_buffer(slot[entry].astype(np.uint8))])
            cols = [segments.dictionary.take(pa.array(segment[first])), pa.array(grp[first]), _lists(blocks_of, code), _lists(blocks_of, count.astype(np.int32)), slots, _lists(postings_of, tf[entry].astype(np.int32)), _lists(np.full(len(blocks_of), GROUP), dls.ravel())]
            yield pa.RecordBatch.from_arrays(cols, ["segment", "grp", "codes", "counts", "slots", "tfs", "dls"])

    return blocks.select("segment", "grp", "code", "postings").mapInArrow(run, "segment string, grp long, codes array<long>, counts array<int>, slots binary, tfs array<int>, dls array<int>")


class _Cell:
    """A block of queries (query_id, codes, weights, avgdl) with the k best of each among the documents of the groups that are put."""

    def __init__(self, queries: pa.RecordBatch, k: int, k1: float, b: float, digits: int):
        self.k, self.k1, self.b, self.scale, self.avgdl = k, k1, b, 10.0**digits, queries["avgdl"][0].as_py()
        self.names = queries["query_id"]
        n = pc.list_value_length(queries["codes"]).to_numpy()
        code, weight = queries["codes"].flatten().to_numpy(), queries["weights"].flatten().to_numpy()
        order = np.argsort(code, kind="stable")
        self.query, self.weight = np.repeat(np.arange(len(n)), n)[order], weight[order]
        self.known, self.starts, self.sizes = np.unique(code[order], return_index=True, return_counts=True)
        self.least, self.held, self.new = np.full(len(n), -np.inf), [], 0

    def put(self, group: pa.RecordBatch) -> None:
        """group: which queries want it, its documents, its packed postings."""
        kind = group["kind"].to_numpy()
        asked, docs, packed = (group.slice(int(np.searchsorted(kind, x)), int((kind == x).sum())) for x in (1, 2, 3))
        if not (asked.num_rows and packed.num_rows):
            return
        wanted = np.sort(pc.index_in(asked["query_id"], value_set=self.names).to_numpy())
        code, count = (packed[x].flatten().to_numpy() for x in ("codes", "counts"))
        order = np.argsort(code, kind="stable")  # the same order of additions for all documents
        entry = _ranges((np.cumsum(count) - count)[order], count[order])
        slot = np.frombuffer(b"".join(packed["slots"].to_pylist()), np.uint8)[entry].astype(np.int64)
        dl = packed["dls"].flatten().to_numpy().reshape(-1, GROUP).max(0)
        tf = packed["tfs"].flatten().to_numpy()[entry]
        gain = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[slot] / self.avgdl))
        at = np.minimum(np.searchsorted(self.known, code[order]), len(self.known) - 1)
        size = np.repeat(np.where(self.known[at] == code[order], self.sizes[at], 0), count[order])
        row = _ranges(np.repeat(self.starts[at], count[order]), size)
        query = np.searchsorted(wanted, self.query[row])
        on = wanted[np.minimum(query, len(wanted) - 1)] == self.query[row]
        cell = (np.repeat(slot, size) * len(wanted) + query)[on]
        score = np.bincount(cell, weights=(self.weight[row] * np.repeat(gain, size))[on], minlength=GROUP * len(wanted))
        hit = np.flatnonzero(score > 0)
        rounded, query = np.floor(score[hit] * self.scale + 0.5) / self.scale, wanted[hit % len(wanted)]
        on = rounded >= self.least[query]
        place = np.zeros(GROUP, np.int64)
        place[docs["slot"].to_numpy()] = np.arange(docs.num_rows)
        self.held.append((query[on], rounded[on], docs["doc_id"].take(pa.array(place[hit[on] // len(wanted)]))))
        self.new += int(on.sum())
        if self.new > 4 * self.k * len(self.least):
            self._cut()

    def _cut(self) -> None:
        query, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        ids = pa.concat_arrays([h[2] for h in self.held])
        keys = [("query", "ascending"), ("score", "descending"), ("id", "ascending")]
        order = pc.sort_indices(pa.table([query, score, ids], ["query", "score", "id"]), sort_keys=keys, null_placement="at_start").to_numpy()
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = (x[place < self.k] for x in (order, query, place))
        self.least[query[place == self.k - 1]] = score[order[place == self.k - 1]]
        self.held, self.new = [(query, score[order], ids.take(pa.array(order)))], 0

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            query, score, ids = self.held[0]
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(query)), ids, pa.array(score)], ["query_id", "doc_id", "score"])


def _best(rows: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of each cell. rows are in order of cell, segment, grp and kind: 0 its queries, of no group; 1 who wants a group, 2 its documents, 3 its packed postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, left = None, None
        for batch in chain(batches, [None]):
            whole = pa.concat_batches([x for x in (left, batch) if x is not None]) if left is not None or batch is not None else None
            if whole is None or not whole.num_rows:
                continue
            segment = pc.fill_null(whole["segment"].dictionary_encode().indices, -1).to_numpy()
            grp, of = pc.fill_null(whole["grp"], -1).to_numpy(), whole["cell"].to_numpy()
            cuts = np.append(0, np.flatnonzero((np.diff(segment) != 0) | (np.diff(grp) != 0) | (np.diff(of) != 0)) + 1)
            last = whole.num_rows if batch is None else int(cuts[-1])  # the last group may go on
            for start, stop in zip(cuts, [*cuts[1:], last], strict=True):
                if start == last:
                    break
                group = whole.slice(int(start), int(stop - start))
                if group["kind"][0].as_py():
                    cell.put(group)
                    continue
                if cell:
                    yield from cell.best()
                cell = _Cell(group, k, k1, b, digits)
            left = whole.slice(last) if batch is not None else None
        if cell:
            yield from cell.best()

    return rows.mapInArrow(run, T.StructType([rows.schema["query_id"], rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def search_plan(spark: SparkSession, path: str, queries: DataFrame, k: int, first: int = 8, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> dict[str, DataFrame]:
    """The parts of a search: `weights` of the queries' tokens, `bounds` a (query, group), `floors` a query, `groups` to be scored, and `hits`: the k best of each task."""
    q = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    weights = written(q.join(statistics(spark, path), "token").select("query_id", "token", (F.col("qf") * F.col("idf")).alias("weight"), "avgdl"))  # read by all steps, as bounds are
    asked = written(weights.select("token").distinct().withColumn("code", F.monotonically_increasing_id()))  # fixed by being written
    n_asked, n_blocks, parts = asked.count(), -(-weights.count() // _BLOCK_TOKENS) or 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = F.broadcast(asked) if n_asked <= _ASKED else asked
    blocks = _read(spark, path, "postings")
    heads = blocks.select("segment", "token", "grp", "most_tf", "least_dl").join(asked.select("token"), "token", "left_semi")
    most = F.greatest(_gain(F.col("most_tf"), F.col("least_dl"), k1, b), F.lit(0.0))
    bounds = written(heads.join(weights, "token").groupBy("query_id", "segment", "grp").agg(F.sum(most).alias("bound")))
    lead = bounds.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "grp"))).where(F.col("_r") <= first).drop("_r")

    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")
    part = F.pmod(F.xxhash64("segment", "grp"), F.lit(parts)).cast("int")
    each_block = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda x: x * parts + part)).alias("cell")
    each_part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda x: block * parts + x)).alias("cell")
    coded = weights.join(asked, "token").groupBy("query_id").agg(F.collect_list(F.struct("code", "weight")).alias("own"), F.first("avgdl").alias("avgdl"))
    coded = coded.select("query_id", F.col("own.code").alias("codes"), F.col("own.weight").alias("weights"), "avgdl")

    def scored(groups: DataFrame) -> DataFrame:
        wanted = written(groups.select("segment", "grp").distinct())
        few = wanted.count() <= _SENT_GROUPS
        these = lambda df: df.join(F.broadcast(wanted) if few else wanted, ["segment", "grp"], "left_semi")
        # which blocks: by their heads alone, then their postings
        own = blocks.select("segment", "token", "grp", "postings").join(asked, "token").drop("token")
        packed = _packed(these(own)) if few else these(_packed(own))
        named = these(_read(spark, path, "documents").select("segment", "grp", "slot", "doc_id"))
        held = coded.select("*", F.lit(0).alias("kind"), each_part)
        rows = held.unionByName(groups.select("query_id", "segment", "grp", F.lit(1).alias("kind"), (block * parts + part).alias("cell")), True)
        for kind, df in ((2, named), (3, packed)):
            rows = rows.unionByName(df.select("*", F.lit(kind).alias("kind"), each_block), True)
        return _best(rows.repartitionById(n_blocks * parts, F.col("cell")).sortWithinPartitions("cell", "segment", "grp", "kind"), k, k1, b, digits)

    floors = written(top_k(scored(lead), "query_id", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")))
    groups = bounds.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 2 * 10.0**-digits)).select("query_id", "segment", "grp", "bound")
    hits = scored(groups)
    return {"weights": weights, "bounds": bounds, "floors": floors, "groups": groups, "hits": hits}


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, **how) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query (query_id, text), scores rounded, ties by id."""
    hits = search_plan(spark, path, queries, k, **how)["hits"]
    return top_k(hits, "query_id", k)
