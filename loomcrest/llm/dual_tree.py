"""Dual-tree Lloyd: k-means on integer vectors, where a cover tree over vectors meets a tree over centroids.

Vectors are cut into pieces once, each with a cover tree of its own, and written to the shared folder. In every round a
tree of balls over the centroids (k x dims numbers, built on the driver) is walked against each piece's tree: a pair of
nodes goes when its least distance is above the largest distance to the best other pair of the same vectors; a node of
vectors that is left with one centroid is dealt whole; pairs of leaves are compared exactly, in integers. Only counts and
sums a centroid (k x dims numbers) come to the driver. Equal vectors of a piece stand in one node of radius 0.

Defined results: rows whose vector is null, of other length, or holds a null or non-finite component are left out;
components beyond +-2^27 after scaling count as that; ties go to the smaller number; repeated rows and ids are vectors
each; a null id is hashed as no digits; fewer vectors than k give as many centroids; an empty table gives no rows; other
columns are not read. A sum of distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

SCALE, LARGEST = 256, 1 << 27
#: Vectors of a piece; a cover tree's node of so many vectors or fewer is a leaf; its children's radius is this share of its own.
PIECE, LEAF, BASE = 4096, 16, 1 / 1.3
#: Pairs whose distances are computed at once.
STEP = 8192


def kept(vector: str, dims: int) -> Column:
    """Whether a vector has dims components, all finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) in doubles, as long, at most LARGEST either way."""
    return np.clip(np.floor(SCALE * np.asarray(x, np.float64)), -LARGEST, LARGEST).astype(np.int64)


@dataclass
class Tree:
    """Nodes in order of breadth; children and members (rows of the ordered points) are ranges."""

    start: np.ndarray
    end: np.ndarray
    child_from: np.ndarray
    child_to: np.ndarray
    centre: np.ndarray  # rows of points, or points themselves
    radius: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        return self.child_from == self.child_to


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The points' order and their cover tree. Centres are points; a node's centre is a centre of its first child (nesting), children's members lie within BASE x the node's radius of their centre (covering), and centres are that far apart (separation)."""
    x = points.astype(np.float64)
    order = np.arange(len(x))
    d = _distances(x, x[0])
    nodes = [[0, len(x), 0, 0, 0, float(d.max())]]
    near: list[np.ndarray | None] = [d]
    at = 0
    while at < len(nodes):
        start, end, _, _, centre, radius = nodes[at]
        if end - start > LEAF and radius > 0:
            rows, most = order[start:end], radius * BASE
            here = x[rows]
            nearest, owner, centres = near[at], np.zeros(end - start, np.int64), [centre]
            while (far := int(np.argmax(nearest))) is not None and nearest[far] > most:
                d = _distances(here, here[far])
                closer = d < nearest
                nearest = np.where(closer, d, nearest)
                owner[closer] = len(centres)
                centres.append(int(rows[far]))
            by = np.argsort(owner, kind="stable")
            order[start:end], nearest = rows[by], nearest[by]
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(centres)))))
            nodes[at][2:4] = len(nodes), len(nodes) + len(centres)
            for k, c in enumerate(centres):
                part = nearest[ends[k] : ends[k + 1]]
                nodes.append([start + int(ends[k]), start + int(ends[k + 1]), 0, 0, c, float(part.max())])
                near.append(part)
        near[at] = None
        at += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    cols = [np.array(c) for c in zip(*nodes, strict=True)]
    return order, Tree(*(c.astype(np.int64) for c in cols[:4]), place[cols[4].astype(np.int64)], cols[5].astype(np.float64))


def centroid_tree(points: np.ndarray) -> Tree:
    """A binary tree of balls over the centroids: each node is split between two far apart members; leaves hold one. Its members are numbers: start is a leaf's centroid."""
    x = points.astype(np.float64)
    members, nodes = [np.arange(len(x))], []
    at = 0
    while at < len(members):
        own = members[at]
        mean = x[own].mean(0)
        node = [int(own[0]), int(own[-1]) + 1, 0, 0, mean, float(_distances(x[own], mean).max()) if len(own) > 1 else 0.0]
        if len(own) == 1:
            node[4] = x[own[0]]
        else:
            a = own[np.argmax(_distances(x[own], mean))]
            b = own[np.argmax(_distances(x[own], x[a]))]
            left = _distances(x[own], x[a]) <= _distances(x[own], x[b])
            if left.all():
                left = np.arange(len(own)) < len(own) // 2
            node[2:4] = len(members), len(members) + 2
            members += [own[left], own[~left]]
        nodes.append(node)
        at += 1
    cols = list(zip(*nodes, strict=True))
    return Tree(*(np.array(c, np.int64) for c in cols[:4]), np.array(cols[4]), np.array(cols[5]))


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, in order, and the range of each."""
    sizes = end - start
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[which], which


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, int]:
    """The nearest centroid of every point (ties: the smaller number), and how many pairs of a point and a centroid were compared."""
    x = points.astype(np.float64)
    label = np.full(len(x), -1, np.int64)
    compared = 0
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, in order of v
    v_leaf, c_leaf = tree.leaf, over.leaf
    while len(v):
        d = np.concatenate([np.sqrt(((x[tree.centre[v[k : k + STEP]]] - over.centre[c[k : k + STEP]]) ** 2).sum(1)) for k in range(0, len(v), STEP)])
        spread = tree.radius[v] + over.radius[c]
        group = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        sizes = np.diff(np.append(group, len(v)))
        most = np.repeat(np.minimum.reduceat(d + spread, group), sizes)
        on = d - spread <= most * (1 + 1e-9) + 1e-6
        v, c, d = v[on], c[on], d[on]
        group = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        sizes = np.diff(np.append(group, len(v)))
        node = v[group]
        wide = ~c_leaf[c] & (over.radius[c] >= tree.radius[v])
        any_wide = np.add.reduceat(wide.astype(np.int64), group) > 0
        any_inner = np.add.reduceat((~c_leaf[c]).astype(np.int64), group) > 0
        one = (sizes == 1) & ~any_inner
        rows, which = _spread(tree.start[node[one]], tree.end[node[one]])
        label[rows] = over.start[c[group[one]]][which]
        split_c = ~one & (any_wide | (v_leaf[node] & any_inner))
        split_v = ~one & ~split_c & ~v_leaf[node]
        exact = ~one & ~split_c & ~split_v
        if exact.any():
            compared += _exact(points, tree, centroids, over, label, v, c, np.repeat(exact, sizes))
        by_pair = np.repeat(split_c, sizes)
        down = by_pair & ~c_leaf[c] & (wide | np.repeat(~any_wide, sizes))
        stay = by_pair & ~down
        kids, which = _spread(over.child_from[c[down]], over.child_to[c[down]])
        new_v, new_c = [v[stay], v[down][which]], [c[stay], kids]
        pairs = np.repeat(split_v, sizes)
        kids, which = _spread(tree.child_from[v[pairs]], tree.child_to[v[pairs]])
        new_v.append(kids)
        new_c.append(c[pairs][which])
        v, c = np.concatenate(new_v), np.concatenate(new_c)
        by = np.lexsort((c, v))
        v, c = v[by], c[by]
    return label, compared


def _exact(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree, label: np.ndarray, v: np.ndarray, c: np.ndarray, on: np.ndarray) -> int:
    """Labels of the points in leaves by their exact distances to the centroids left; v, c where on are pairs of leaves."""
    rows, which = _spread(tree.start[v[on]], tree.end[v[on]])
    number = over.start[c[on]][which]
    by = np.lexsort((number, rows))
    rows, number = rows[by], number[by]
    d = np.concatenate([((points[rows[k : k + STEP]] - centroids[number[k : k + STEP]]) ** 2).sum(1) for k in range(0, len(rows), STEP)])
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(rows))))
    hit = np.flatnonzero(d == least)
    label[rows[hit[::-1]]] = number[hit[::-1]]  # the smallest number is written last
    return len(rows)


_PIECE = "ids array<long>, points binary, nodes binary, radius binary"


def pieces(df: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """The kept rows as pieces with a cover tree each, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def piece() -> pa.RecordBatch:
            points = np.concatenate(held)
            order, tree = cover_tree(points)
            nodes = np.stack([tree.start, tree.end, tree.child_from, tree.child_to, tree.centre])
            row = [[ids[k] for k in order.tolist()]], [points[order].astype(np.int32).tobytes()], [nodes.astype(np.int32).tobytes()], [tree.radius.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.list_(pa.int64())), *(pa.array(r, pa.binary()) for r in row[1:])], ["ids", "points", "nodes", "radius"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, PIECE - len(ids))
                ids += part.column(0).to_pylist()
                held.append(scaled(part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims))
                at += part.num_rows
                if len(ids) == PIECE:
                    yield piece()
                    ids, held = [], []
        if ids:
            yield piece()

    rows = df.where(kept(vector, dims)).select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    return C.materialize(rows.mapInArrow(run, _PIECE), "none")


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for k in range(batch.num_rows):
        points, nodes = (np.frombuffer(batch.column(j)[k].as_buffer(), np.int32).astype(np.int64) for j in (1, 2))
        yield batch.column(0)[k].values, points.reshape(-1, dims), Tree(*nodes.reshape(5, -1), np.frombuffer(batch.column(3)[k].as_buffer()))


def first_centroids(df: DataFrame, vec_id: str, vector: str, k: int, dims: int, salt: int) -> np.ndarray:
    """The k kept vectors of smallest sha256 of `salt:id`, in that order."""
    some = df.where(kept(vector, dims)).select(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    return scaled(np.array([r.v for r in some.orderBy("h", "v").limit(k).collect()], np.float64).reshape(-1, dims))


def _moved(parts: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' mean, rounded down; of no vectors: itself."""
    k, dims = centroids.shape
    over = centroid_tree(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, points, tree in _read(batch, dims):
                label, _ = nearest(points, tree, centroids, over)
                n += np.bincount(label, minlength=k)
                own = np.zeros((k, len(points)))
                own[label, np.arange(len(points))] = 1
                sums += (own @ points.astype(np.float64)).astype(np.int64)  # below 2^53, so exact
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([[int(n[c]), *sums[c].tolist()] for c in some], pa.list_(pa.int64()))], ["cluster", "sums"])

    rows = parts.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("v").alias("v")).collect()
    total = {(r.cluster, r.at): r.v for r in rows}
    out = centroids.copy()
    for c in range(k):
        if (c, 0) in total:
            out[c] = [total[c, j + 1] // total[c, 0] for j in range(dims)]
    return out


def lloyd(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, salt: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance: squared) of every kept vector, written to the shared folder, and the final centroids."""
    centroids = first_centroids(df, vec_id, vector, k, dims, salt)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    parts = pieces(df, vec_id, vector, dims)
    for _ in range(rounds):
        centroids = _moved(parts, centroids)
    over, last = centroid_tree(centroids), centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, tree in _read(batch, dims):
                label, _ = nearest(points, tree, last, over)
                yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(((points - last[label]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    out = C.materialize(parts.mapInArrow(run, "vec_id long, cluster int, distance long"))
    C.forget(parts)
    return out, centroids


def op11_clusters(spark, sf_dir: str) -> DataFrame:
    out, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    whole = F.sum(F.col("distance").cast("decimal(20,0)"))
    inertia = out.groupBy("cluster").agg(whole.alias("d")).collect()  # a row a centroid
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(int(r.d) for r in inertia))
    rows = [(r.cluster, fits(int(r.d)), total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in inertia]
    few = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
