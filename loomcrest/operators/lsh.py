"""MinHash LSH search: signatures of sets, bands, candidates by bucket, estimated and exact Jaccard similarity.

Rows collapse to their different sets first; signatures, bands and candidates are those of sets, and pairs of rows are
made at the very end, so equal sets cost one another nothing. Slices of the queries' sets are held by tasks, with their
bands' buckets; the other sets pass by. A task keeps of its candidates those whose sizes and estimate allow the
similarity asked for, and counts what these share, so what is exchanged are sets, once a slice, and pairs found.

A pair of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands: with the 64 bands of 2 that are the
default a pair of 0.5 is missed once in 10^8, with 42 bands of 3 (of 126 permutations) once in 270; `bands_for` says how
many bands of more rows miss as little and meet fewer pairs of low similarity.

Null items are no items; rows without items are found by nothing and find nothing; repeated rows are rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

PERMUTATIONS, BANDS, ROWS = 128, 64, 2
#: Different sets of queries that a task holds; the others are dealt to PARTS tasks a core, or more if a task would get more than _PASSING.
SHARES, PARTS, _PASSING = 1 << 14, 2, 1 << 16
#: Items of a step of the signatures; pairs of a step of the buckets and of the estimates.
_STEP, _MARKS, _PAIRS = 64, 1 << 21, 1 << 12
#: Standard deviations below the similarity asked for at which an estimate is given up: one in 10^8.
_SLACK = 5.6
_SIGNED = "k long, s array<long>, m array<short>"


def bands_for(least: float, rows: int, miss: float = 1e-8) -> int:
    """How many bands of so many rows miss a pair of similarity `least` with that probability at most."""
    return ceil(log(miss) / log1p(-(least**rows)))


def permuted(hashes: np.ndarray, permutations: int) -> np.ndarray:
    """(items, permutations): each item's hash, folded to 32 bits, mixed with each permutation's seed and multiplied by its odd factor, twice."""
    n = np.arange(1, permutations + 1, dtype=np.uint64)
    seeds = n * np.uint64(0x9E3779B97F4A7C15)
    seeds ^= seeds >> np.uint64(29)
    seeds *= np.uint64(0xBF58476D1CE4E5B9)
    h = hashes.astype(np.uint64)
    y = (h ^ (h >> np.uint64(32))).astype(np.uint32)[:, None] ^ (seeds >> np.uint64(32)).astype(np.uint32)[None, :]
    y *= (seeds.astype(np.uint32) | np.uint32(1))[None, :]
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    return y


def sets(df: DataFrame, row_id: str, items: str) -> tuple[DataFrame, DataFrame]:
    """The rows as (row_id, k), and the different sets as (k, s): k names a set by 64 bits, s are its items' hashes in order."""
    hashed = F.array_sort(F.array_distinct(F.transform(F.array_compact(items), lambda x: F.xxhash64(x))))
    rows = df.select(row_id, hashed.alias("s")).where(F.size("s") > 0).withColumn("k", F.xxhash64("s"))
    return rows.select(row_id, "k"), rows.groupBy("k").agg(F.first("s").alias("s"))


def signatures(different: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """(k, s, m): 16 bits of the least value of every permutation over a set's items; those of two sets agree as often as the sets are similar, and else once in 2^16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, permutations), np.int16)
            for n, x in enumerate(batch.column(1)):
                h = x.values.to_numpy(zero_copy_only=False)
                least = [permuted(h[k : k + _STEP], permutations).min(0) for k in range(0, len(h), _STEP)]
                out[n] = np.minimum.reduce(least).astype(np.uint16).view(np.int16)
            if len(out):
                ends = np.arange(len(out) + 1, dtype=np.int32) * permutations
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], ["k", "s", "m"])

    return different.select("k", "s").mapInArrow(run, _SIGNED)


def _buckets(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(bands, sets): 64 bits of each band of each set's signature."""
    key = np.zeros((len(m), bands), np.uint64)
    for k in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + m[:, k : bands * rows : rows].view(np.uint16)
    return np.ascontiguousarray(key.T)


class _Held:
    """A slice of the queries' sets: (names, sets in a row, where each begins, signatures), and every band's buckets."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], bands: int, rows: int):
        k, flat, sizes, m = zip(*parts, strict=True)
        self.k, self.flat, self.sizes, self.m = np.concatenate(k), np.concatenate(flat), np.concatenate(sizes), np.concatenate(m)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bands, self.rows = bands, rows
        keys = _buckets(self.m, bands, rows)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def candidates(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, query) of sets with the signatures m: pairs that share a bucket, each once."""
        met = np.zeros((len(m), len(self.k)), bool)
        for keys, order, own in zip(self.keys, self.order, _buckets(m, self.bands, self.rows), strict=True):
            left = np.searchsorted(keys, own, "left")
            n = np.searchsorted(keys, own, "right") - left
            at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            met[np.repeat(np.arange(len(m)), n), order[at]] = True
        return met.nonzero()


def candidates(queries: DataFrame, docs: DataFrame, bands: int = BANDS, rows: int = ROWS, least: float = 0.0, exact: bool = True, expected: int = 0) -> DataFrame:
    """(qk, dk, estimate, score) of signed sets that share a bucket and have a score >= least: with `exact` what the sets share, else the estimate, the share of permutations with equal minima.

    Queries are read more than once. A task holds a slice of their sets, whatever their number; the other sets, of which
    there are `expected` at most, are copied once a slice.
    """
    slices = -(-queries.count() // SHARES) or 1
    parts = max(-(-PARTS * queries.sparkSession.sparkContext.defaultParallelism // slices), -(-expected // _PASSING))
    of = lambda n, seed: F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("part", every(parts)).withColumn("slice", of(slices, 1)).withColumn("kind", F.lit(0))
    passing = docs.withColumn("slice", every(slices)).withColumn("part", of(parts, 2)).withColumn("kind", F.lit(1))
    both = asked.unionByName(passing).select((F.col("slice") * parts + F.col("part")).alias("cell"), "kind", "k", "s", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, kinds, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(0, np.cumsum(sizes))
            m = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            begins = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]))))
            for at, to in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                if cells[at] != cell:
                    cell, waiting, held = cells[at], [], None
                if kinds[at] == 0:
                    waiting.append((k[at:to].copy(), flat[ends[at] : ends[to]].copy(), sizes[at:to], m[at:to].copy()))
                    continue
                if waiting:
                    held, waiting = _Held(waiting, bands, rows), []
                if held is None:
                    continue  # no query has this cell
                step = max(1, _MARKS // len(held.k))
                for n in range(at, to, step):
                    upto = min(n + step, to)
                    yield from found(held, k[n:upto], flat, ends[n : upto + 1], m[n:upto])

    def found(held: _Held, k: np.ndarray, flat: np.ndarray, ends: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, query = held.candidates(m)
        sizes = np.diff(ends)
        if exact:
            a, b = sizes[doc], held.sizes[query]
            on = np.minimum(a, b) >= least * np.maximum(a, b)
            doc, query = doc[on], query[on]
        estimate = np.concatenate([np.zeros(0), *((m[doc[x : x + _PAIRS]] == held.m[query[x : x + _PAIRS]]).mean(1) for x in range(0, len(doc), _PAIRS))])
        on = estimate >= (least - _SLACK * sqrt(least * (1 - least) / m.shape[1]) if exact else least)
        doc, query, estimate = doc[on], query[on], estimate[on]
        score = np.array(estimate)
        if exact and len(doc):
            begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            for x, to in zip(begins, [*begins[1:], len(doc)], strict=True):
                own, q = flat[ends[doc[x]] : ends[doc[x] + 1]], query[x:to]
                for y in range(0, len(q), _PAIRS):
                    some = q[y : y + _PAIRS]
                    items = np.concatenate([held.flat[held.starts[i] : held.starts[i] + held.sizes[i]] for i in some])
                    shared = own[np.minimum(np.searchsorted(own, items), len(own) - 1)] == items
                    shared = np.add.reduceat(shared, np.cumsum(held.sizes[some]) - held.sizes[some], dtype=np.int64)
                    score[x + y : x + y + len(some)] = shared / (len(own) + held.sizes[some] - shared)
        on = score >= least
        yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (held.k[query], k[doc], estimate, score)], ["qk", "dk", "estimate", "score"])

    cells = both.repartition(slices * parts, "cell").sortWithinPartitions("cell", "kind")
    return cells.mapInArrow(run, "qk long, dk long, estimate double, score double")


def lsh_search(queries: DataFrame, docs: DataFrame, least: float, items: str = "items", exact: bool = True, permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(query_id, doc_id, estimate, score) of (id, items): pairs of rows whose sets share a bucket and have score >= least.

    The score is the exact Jaccard similarity of the sets (items are compared by 64-bit hashes), or the estimate without `exact`.
    """
    if bands * rows > permutations:
        raise ValueError("bands * rows is more than the permutations")
    q, q_sets = sets(queries, "query_id", items)
    d, d_sets = sets(docs, "doc_id", items)
    near = candidates(written(signatures(q_sets, permutations)), signatures(d_sets, permutations), bands, rows, least, exact, docs.count())
    return q.withColumnRenamed("k", "qk").join(near, "qk").join(d.withColumnRenamed("k", "dk"), "dk").select("query_id", "doc_id", "estimate", "score")
