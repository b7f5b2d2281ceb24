"""An inverted file over vectors: cells, every row in its nearest cell, search in few cells, and an exact way for the rest.

Cells are fitted by k-means on a bounded sample (`sample` rows, those of least hash); every row is then assigned, and
stands in blocks of at most BLOCK rows of one cell, written as Parquet. A search meets a query's `probes` nearest cells.
`exact` then goes on: a cell can hold something better than the k-th best so far only if query . centroid + |query| x
radius is above it, so just those cells are searched as well, and the result is that of a full scan. Cells (at most
`cells`, a parameter, x dims numbers) are all that driver and tasks share. Rows of a cell are spread over tasks, however
many of all rows it holds, and pass by its queries in steps.

Scores are dot products in doubles. Rows with a null id or vector, or a null or non-finite component, are not indexed
and ask nothing; repeated rows are rows each; ids are longs; vectors must be of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, written
from .retrieve import best_in_cells

#: Rows of a block; queries of a slice, which meets a part of its cell's rows at once; parts that the rows of a cell are spread over for a share of 1 / SPREAD.
BLOCK, QUERIES, SPREAD = 1024, 8192, 64
_BLOCK = "cell int, part int, ids array<long>, vectors binary"


@dataclass
class Index:
    """A written index: centroids (cells, dims), radius and rows a cell, and the blocks' path."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")


def _vectors(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)) & (F.size("v") > 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
    cell = d.argmin(1)
    return cell, np.sqrt(((x - centroids[cell]) ** 2).sum(1))


def fit_cells(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Plain k-means on the sample, begun at rows far from one another; empty cells go."""
    x = np.unique(x, axis=0)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centroids = x[chosen]
    for _ in range(rounds):
        cell, _ = _nearest(x, centroids)
        n = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        centroids = sums[n > 0] / n[n > 0, None]
    return centroids


def build_index(df: DataFrame, row_id: str, vector: str, cells: int = 64, sample: int = 20_000, path: str | None = None) -> Index:
    """Fits cells on at most `sample` rows and writes every row in its cell's blocks, below path or in the shared folder."""
    spark = df.sparkSession
    rows = _vectors(df, row_id, vector)
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).toPandas()
    centroids = fit_cells(np.stack(some.v), cells) if len(some) else np.zeros((0, 1))
    path = path or shared_folder(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        part = 0

        def block(c: int) -> pa.RecordBatch:
            nonlocal part
            ids, vs = zip(*held.pop(c), strict=True)
            part += 1
            cols = [[c], [part], [list(ids)], [np.stack(vs).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["cell", "part", "ids", "vectors"])

        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), b.num_rows)
            for i, v, c in zip(b.column(0).to_pylist(), x, _nearest(x, centroids)[0].tolist(), strict=True):
                held.setdefault(c, []).append((i, v))
                if len(held[c]) == BLOCK:
                    yield block(c)
        for c in list(held):
            yield block(c)

    if len(centroids):
        rows.mapInArrow(blocks, _BLOCK).write.parquet(f"{path}/blocks")
    else:
        spark.createDataFrame([], _BLOCK).write.parquet(f"{path}/blocks")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, n, far = [], [], []
            for c, ids, vs in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                x = np.frombuffer(vs.as_buffer()).reshape(len(ids), -1)
                cell.append(c)
                n.append(len(ids))
                far.append(float(np.sqrt(((x - centroids[c]) ** 2).sum(1)).max()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64()), pa.array(far, pa.float64())], ["cell", "n", "far"])

    written = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    stats = {r.cell: r for r in written.mapInArrow(sizes, "cell int, n long, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}  # a row a cell
    get = lambda name: np.array([getattr(stats[c], name) if c in stats else 0 for c in range(len(centroids))], float)
    return Index(spark, path, centroids, get("far"), get("n"))


def _wanted(queries: DataFrame, index: Index, probes: int | None) -> DataFrame:
    """(cell, id, v, and with a floor column: those cells that may hold a better row) of every query. With probes: the nearest ones; without: the rest, by their bound."""
    centroids, radius, full = index.centroids, index.radius, index.rows > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), b.num_rows)
            dot = x @ centroids.T
            bound = np.where(full, dot + np.sqrt((x * x).sum(1))[:, None] * radius, -np.inf)
            order = np.argsort(-bound, axis=1, kind="stable")
            place = np.argsort(order, axis=1, kind="stable")
            if probes is not None:
                on = (place < probes) & full
            else:
                least = b.column(2).to_numpy(zero_copy_only=False)
                done = b.column(3).to_numpy(zero_copy_only=False)
                on = (place >= done[:, None]) & full & (bound >= least[:, None] - 1e-5)
            query, cell = on.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0).take(pa.array(query)), b.column(1).take(pa.array(query))], ["cell", "id", "v"])

    return queries.mapInArrow(run, "cell int, id long, v array<double>")


def _rows(index: Index) -> DataFrame:
    """(cell, id, v) of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, ids, vectors in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                x = np.frombuffer(vectors.as_buffer())
                ends = np.arange(len(ids) + 1, dtype=np.int32) * (len(x) // len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cell, np.int32)), ids.values, pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], ["cell", "id", "v"])

    return index.blocks().select("cell", "ids", "vectors").mapInArrow(run, "cell int, id long, v array<double>")


def _met(wanted: DataFrame, index: Index, k: int, digits: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of every part of a cell for every query that wants the cell.

    A cell's rows are dealt to parts, its queries to slices of about QUERIES, and each slice meets each part.
    """
    parts = np.maximum(1, np.ceil(index.rows / max(index.rows.sum(), 1) * SPREAD)).astype(int)
    asked = dict(wanted.groupBy("cell").count().collect())  # a row a cell
    slices = [max(1, -(-asked.get(c, 0) // QUERIES)) for c in range(len(parts))]
    first = np.concatenate(([0], np.cumsum(parts * slices)))
    n = {name: F.get(F.array(*(F.lit(int(x)) for x in values)), F.col("cell")) for name, values in (("parts", parts), ("slices", slices), ("first", first))}
    every = lambda name: F.explode(F.sequence(F.lit(0), n[name] - 1))
    of = lambda name, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n[name]).cast("int")
    placed = lambda x: x.select((n["first"] + F.col("slice") * n["parts"] + F.col("part")).alias("cell"), "id", "v")
    queries = placed(wanted.withColumn("part", every("parts")).withColumn("slice", of("slices", 1)))
    met = _rows(index).where(F.col("cell").isin([c for c in range(len(parts)) if asked.get(c)]))
    return best_in_cells(queries, placed(met.withColumn("slice", every("slices")).withColumn("part", of("parts", 2))), k, digits)


def search(index: Index, queries: DataFrame, query: str, vector: str, k: int, probes: int = 8, exact: bool = False, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best rows of each query, ties by id; scores rounded to `digits`. Query ids are told apart by their value."""
    if not len(index.centroids):
        return index.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    q = _vectors(queries, query, vector)
    first = _met(_wanted(q, index, probes), index, k, digits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    top = lambda hits: hits.withColumn("rank", rank).where(F.col("rank") <= k)
    if not exact:
        return top(first)
    best = written(top(first))  # read twice
    floor = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))
    more = q.join(floor, q["id"] == floor["query_id"], "left").select("id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.lit(probes).alias("done"))
    return top(best.drop("rank").unionByName(_met(_wanted(more, index, None), index, k, digits)))
