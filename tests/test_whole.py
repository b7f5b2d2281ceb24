"""Whole jobs against brute force, on small tables."""

import difflib
import random
import re

import numpy as np
from conftest import SF

from loomcrest.operators import retrieve
from loomcrest.plans import catalogue


def test_dense_searches_every_twentieth(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = set()
    for q in rows:
        if q % 20 == 0:
            best = sorted((-round(float(v @ rows[q]), 5), i) for i, v in rows.items())[:5]
            want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in catalogue.QUERIES["dense_topk"](spark, SF).collect()} == want and len(want) == 125


def test_dense_blocks_do_not_matter(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(50)] + [(50, None)], "doc_id long, embedding array<float>")
    q = v.withColumnRenamed("doc_id", "query_id")
    top = lambda x: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in retrieve.top_k(x, "query_id", 4).collect())
    plain = sorted((q, n + 1, d, s) for q in range(50) for n, (s, d) in enumerate(sorted(((float((q % 3) * (d % 3) + 1), d) for d in range(50)), key=lambda x: (-x[0], x[1]))[:4]))
    assert top(retrieve.dense_blocks(q, v, 4, 5, block=7)) == top(retrieve.dense_blocks(q, v, 4, 5)) == plain


def brute_mmr(queries, docs, top, k, weight=0.7):
    words = lambda t: set(re.findall(r"[a-z_]\w+|\d+|\S", t.lower()))
    out = set()
    for q, text in queries:
        w = words(text)
        hits = [(round(len(w & words(t)) / (len(w) ** 0.5 * len(words(t)) ** 0.5), 6), i, t) for i, t in docs if w & words(t)]
        left = sorted(hits, key=lambda h: (-h[0], h[1]))[:top]
        chosen = [left.pop(0)]
        while left and len(chosen) < k:
            gain = [weight * s - (1 - weight) * max(difflib.SequenceMatcher(None, t, c[2]).ratio() for c in chosen) for s, _, t in left]
            chosen.append(left.pop(gain.index(max(gain))))
        out |= {(q, i, n + 1) for n, (_, i, _) in enumerate(chosen)}
    return out


def test_mmr_compares_whole_texts(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    head, tails = " ".join(["needle", *(word() for _ in range(70))]), [" ".join(word() for _ in range(n)) for n in (60, 60, 90)]
    docs = [(i, f"{head} {tails[i % 3]} {' '.join(word() for _ in range(i % 5))}") for i in range(20)] + [(20, "needle"), (21, "nothing")]
    queries = [(1, "needle"), (2, f"needle {tails[1][:200]}"), (3, head)]
    assert all(len(t) > 400 for _, t in docs[:20])
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(queries, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["mmr_rerank"](spark, str(tmp_path)).collect()}
    assert got == brute_mmr(queries, docs, 15, 3)
    assert got != brute_mmr(queries, [(i, t[:400]) for i, t in docs], 15, 3)


def test_substring_graph_has_all_parts(spark):
    parts = {(r.p_type, r.p_name, f"{r.p_name} {r.p_brand} small ring red widget") for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    calls = {(g, f, o) for g, f, t in parts for h, o, _ in parts if g == h and f != o and o in t}
    said = lambda xs: ",".join(sorted(xs)[:3])
    want = {(g, n, said({o for h, f, o in calls if (h, f) == (g, n)}), said({f for h, f, o in calls if (h, o) == (g, n)})) for g, n, _ in parts}
    assert {tuple(r) for r in catalogue.QUERIES["substring_graph"](spark, SF).collect()} == want
