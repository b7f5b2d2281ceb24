"""The additive model against plain definitions, and its accuracy on what it has not seen."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcrest.llm import gam

SF = "/root/testdata/sf0.01"
rng = np.random.default_rng(12)


def gain(g, h, l2):
    return g * g / (h + l2)


def test_first_cut_is_the_best_of_all():
    for _ in range(30):
        g, h, n = rng.normal(size=9), rng.random(9) + 0.1, rng.integers(0, 9, 9)
        got = gam.shallow_tree(g, h, n, 2, 4, 1.0)
        cuts = [(gain(g[:c].sum(), h[:c].sum(), 1) + gain(g[c:].sum(), h[c:].sum(), 1) - gain(g.sum(), h.sum(), 1), c) for c in range(1, 9) if n[:c].sum() >= 4 and n[c:].sum() >= 4]
        best = max(cuts, default=(0, 0))
        want = np.where(np.arange(9) < best[1], g[: best[1]].sum() / (h[: best[1]].sum() + 1), g[best[1] :].sum() / (h[best[1] :].sum() + 1)) if best[0] > 1e-9 else np.full(9, g.sum() / (h.sum() + 1))
        assert np.allclose(got, want)
        assert len(np.unique(gam.shallow_tree(g, h, n, 3, 1, 1.0))) <= 3


def test_quadrants_are_the_best_of_all():
    for _ in range(20):
        g, h, n = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1, rng.integers(1, 5, (4, 5))
        best = 0.0
        for a, b, c in ((g, h, n), (g.T, h.T, n.T)):
            for k in range(1, a.shape[0]):
                sides = [max((gain(a[r, :j].sum(), b[r, :j].sum(), 1) + gain(a[r, j:].sum(), b[r, j:].sum(), 1) for j in range(1, a.shape[1]) if c[r, :j].sum() >= 3 and c[r, j:].sum() >= 3), default=None) for r in (slice(0, k), slice(k, None))]
                if None not in sides:
                    best = max(best, sum(sides) - gain(a.sum(), b.sum(), 1))
        step, got = gam.pair_tree(g, h, n, 3, 1.0)
        assert got == pytest.approx(best) and len(np.unique(step.round(9))) <= 4


def test_scores_are_sums_of_the_tables():
    x, y = rng.normal(size=(900, 4)), rng.random(900)
    model = gam.learn(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0) & (y > 0.1), rounds=40, pair_rounds=20)
    assert model.pairs
    for row in x[:50]:
        bins = [sum(c < v for c in cuts) for cuts, v in zip(model.cuts, row, strict=True)]
        wide = [sum(c < v for c in cuts) for cuts, v in zip(model.wide, row, strict=True)]
        logit = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[wide[a], wide[b]] for (a, b), t in model.pairs.items())
        assert model.scores(row[None])[0] == pytest.approx(1 / (1 + np.exp(-logit)))


def test_pairs_learn_what_single_features_cannot():
    x = rng.random((4000, 5))
    y = (x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)
    model = gam.learn(x[:3000], y[:3000])
    assert next(iter(model.pairs)) == (1, 3) and ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    assert ((gam.learn(x[:3000], y[:3000], max_pairs=0).scores(x[3000:]) > 0.5) == y[3000:]).mean() < 0.6


def test_a_smooth_effect_and_noise():
    x = rng.normal(size=(6000, 3))
    p = 1 / (1 + np.exp(-3 * np.sin(2 * x[:, 0])))
    y = rng.random(6000) < p
    got = gam.learn(x[:5000], y[:5000]).scores(x[5000:])
    assert np.abs(got - p[5000:]).mean() < 0.08  # calibrated, as early rounds are kept


def test_features_by_hand():
    t = b"One two, two!\n\nOne two, two!\n  \nincomprehensibly 1 \xc3\xa9\xc3\xa9"
    f = dict(zip(gam.NAMES, gam.features([t])[0], strict=True))
    assert f["n_words"] == 9 and f["stops"] == 2 / 9 and f["commas"] == 2 / 9 and f["line_words"] == 3 and f["short_words"] == 1 / 9 and f["long_words"] == 1 / 9
    assert f["top_word"] == 2 / 9 and f["alone"] == 3 / 9 and f["same_lines"] == pytest.approx(1 / 3) and f["non_ascii"] == pytest.approx(4 / 43)
    assert not gam.features([None, b"", b" \n"]).any()


def test_held_out_accuracy(spark):
    got = gam.op12_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    assert (got.predicted == got.quality).mean() > 0.95 and got.predicted[got.quality == 1].mean() > 0.97
    assert ((got.score >= 0.3) == got.predicted).all() and got.score.between(0, 1).all()


def test_hard_rows(spark):
    rows = [(i, "a fine day in the long green valley of words " * 3 if i % 2 else "# $ % & " * 9) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "a b"), (500, None), (501, ""), (502, "x" * 3_000_000), (1, "# $")], "doc_id long, text string").withColumns({"score": F.lit("a"), "f": F.lit(1), "i": F.lit(2)})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0), (5, 0, 1), (500, 0, 0)], "doc_id long, quality int, toxic int")
    model = gam.fit(docs, labels)
    got = gam.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[7] > 0.9 and by[8] < 0.1 and by[500] == by[501]
    for few, want in ((labels.where("quality = 1 and doc_id > 100"), 0.9), (labels.limit(0), 0.5)):
        s = {round(r.score, 6) for r in gam.score(docs, gam.fit(docs, few)).collect()}
        assert len(s) == 1 and s.pop() >= want
    assert gam.score(docs.limit(0), model).count() == 0
