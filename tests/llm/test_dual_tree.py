"""Dual-tree Lloyd against plain Lloyd."""

import hashlib

import numpy as np
import pytest

from loomcrest.llm import dual_tree

rng = np.random.default_rng(11)


def brute_nearest(points, centroids):
    d = ((points[:, None] - centroids[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def brute(rows, k, rounds, dims):
    """(id, cluster, distance) and centroids, vector by vector, in Python's integers."""
    own = [(i, [min(max(int(np.floor(256.0 * x)), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(own, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        by = [[] for _ in centroids]
        for _, v in own:
            by[near(v)[1]].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c for vs, c in zip(by, centroids, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in own), key=str), centroids


def clouds(n, dims, kinds=7, spread=3):
    return (rng.integers(-300, 300, (kinds, dims))[rng.integers(0, kinds, n)] + rng.integers(-spread, spread + 1, (n, dims))).astype(np.int64)


@pytest.mark.parametrize("points", [clouds(700, 3), clouds(700, 64), clouds(500, 2, 3, 0), rng.integers(-50, 50, (600, 64)), np.zeros((90, 4), np.int64), clouds(1, 5), clouds(300, 8) * (1 << 18)])
@pytest.mark.parametrize("k", [1, 2, 9, 40])
def test_nearest_is_exact(points, k):
    order, tree = dual_tree.cover_tree(points)
    points = points[order]
    centroids = np.concatenate([points[rng.integers(0, len(points), k)] + rng.integers(-2, 3, (k, points.shape[1]))])
    centroids[k // 2] = centroids[0]  # a tie
    label, compared = dual_tree.nearest(points, tree, centroids, dual_tree.centroid_tree(centroids))
    assert (label == brute_nearest(points, centroids)[0]).all() and compared <= len(points) * k


def test_cover_tree_holds_its_invariants():
    points = np.concatenate([clouds(900, 5, 9, 20), np.repeat(clouds(1, 5), 300, 0)])
    order, t = dual_tree.cover_tree(points)
    x = points[order].astype(float)
    assert sorted(order) == list(range(len(points)))
    for n in range(len(t.start)):
        d = np.sqrt(((x[t.start[n] : t.end[n]] - x[t.centre[n]]) ** 2).sum(1))
        assert d.max() <= t.radius[n] + 1e-9
        kids = range(t.child_from[n], t.child_to[n])
        if kids:
            assert t.start[kids[0]] == t.start[n] and t.end[kids[-1]] == t.end[n] and t.centre[kids[0]] == t.centre[n]
            assert all(t.end[a] == t.start[a + 1] for a in kids[:-1]) and all(t.radius[a] <= t.radius[n] * dual_tree.BASE + 1e-9 for a in kids)
            c = x[t.centre[list(kids)]]
            gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert gaps.min() > t.radius[n] * dual_tree.BASE - 1e-9


def test_clouds_are_pruned():
    points = clouds(4000, 16, 12, 4)
    order, tree = dual_tree.cover_tree(points)
    centroids = points[::100]
    _, compared = dual_tree.nearest(points[order], tree, centroids, dual_tree.centroid_tree(centroids))
    assert compared < 0.3 * len(points) * len(centroids)


def test_rounds_against_plain_lloyd(spark):
    x = (clouds(300, 6) / 256 + 0.001).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(7, x[7]), (8, x[3]), (None, x[5]), (None, x[6])]
    rows += [(900, None), (901, x[0][:5]), (902, [*x[0][:5], None]), (903, [*x[0][:5], float("nan")]), (904, [*x[0][:5], float("inf")]), (905, [1e30] * 6), (906, [])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    for k, rounds in ((9, 4), (400, 1)):
        out, centroids = dual_tree.lloyd(df, k=k, rounds=rounds, dims=6)
        want, final = brute(rows, k, rounds, 6)
        assert sorted(map(tuple, out.collect()), key=str) == want and centroids.tolist() == final


def test_nothing_kept(spark):
    out, centroids = dual_tree.lloyd(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert out.count() == 0 and len(centroids) == 0
