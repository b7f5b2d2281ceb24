"""LSH search, the vector index and the postings index against brute force."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcrest.operators import lsh, postings, retrieve, vector_index

rng = random.Random(21)


def overlapping_sets(n):
    """Sets in families of varying overlap, repeated ones among them."""
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((2, 10, 40)))]
        out.append(base)
        for _ in range(4):
            out.append([x if rng.random() < rng.choice((0.6, 0.8, 0.95)) else f"v{rng.randrange(5000)}" for x in base])
        out.append(list(reversed(base)))
    return out


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def families(spark):
    rows = list(enumerate(overlapping_sets(60))) + [(9000, None), (9001, []), (9002, [None]), (9003, [None, "w1"]), (9004, ["w1"])]
    return rows, spark.createDataFrame(rows, "doc_id long, items array<string>").cache()


def test_lsh_has_every_pair_of_half_or_more(spark, families):
    rows, df = families
    sets = {i: [x for x in s or [] if x is not None] for i, s in rows}
    want = {(a, b): jaccard(sets[a], sets[b]) for a in sets if a % 20 == 0 and sets[a] for b in sets if sets[b] and jaccard(sets[a], sets[b]) >= 0.5}
    q = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got = lsh.lsh_search(q, df, 0.5).collect()
    assert {(r.query_id, r.doc_id): r.score for r in got} == pytest.approx(want) and len(got) == len(want) > 60
    assert np.mean([abs(r.estimate - r.score) for r in got]) < 0.05
    three = lsh.lsh_search(q, df, 0.5, permutations=126, bands=42, rows=3).count()
    assert three >= 0.9 * len(want)


def test_lsh_pairs_are_of_sets_until_the_end(spark):
    rows = [(i, ["a", "b", "c"]) for i in range(300)] + [(1000 + i, [f"x{i}", f"y{i}"]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, items array<string>")
    _, different = lsh.sets(df, "doc_id", "items")
    signed = lsh.signatures(different)
    assert lsh.candidates(signed, signed).count() == 51
    assert lsh.lsh_search(df.withColumnRenamed("doc_id", "query_id"), df, 0.5).count() == 300 * 300 + 50


def test_lsh_estimates_and_hot_buckets(spark, families, monkeypatch):
    rows, df = families
    q = df.withColumnRenamed("doc_id", "query_id")
    plain = sorted(map(tuple, lsh.lsh_search(q, df, 0.3, exact=False).collect()))
    monkeypatch.setattr(lsh, "SHARES", 1 << 20)  # every bucket is dealt
    assert sorted(map(tuple, lsh.lsh_search(q, df, 0.3, exact=False).collect())) == plain and len(plain) > 300
    with pytest.raises(ValueError, match="permutations"):
        lsh.lsh_search(q, df, 0.5, bands=65)


def test_lsh_holds_slices_of_queries(spark, families, monkeypatch):
    rows, df = families
    sets = {i: {x for x in s or [] if x is not None} for i, s in rows}
    q = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    bands = lsh.bands_for(0.5, 3)
    assert (1 - 0.5**3) ** bands <= 1e-8 < (1 - 0.5**3) ** (bands - 1)
    pairs = lambda: sorted((r.query_id, r.doc_id) for r in lsh.lsh_search(q, df, 0.5, permutations=3 * bands, bands=bands, rows=3).collect())
    want = sorted((a, b) for a in sets if a % 20 == 0 and sets[a] for b in sets if sets[b] and jaccard(sets[a], sets[b]) >= 0.5)
    assert pairs() == want
    for name, few in (("SHARES", 7), ("_MARKS", 20), ("_PAIRS", 2), ("_STEP", 3)):
        monkeypatch.setattr(lsh, name, few)
    assert pairs() == want
    # no set or signature goes with a candidate
    signed = lsh.signatures(lsh.sets(df, "doc_id", "items")[1])
    assert lsh.candidates(signed, signed).columns == ["qk", "dk", "estimate", "score"]


def vectors(n, dims, kinds=9):
    g = np.random.default_rng(n)
    x = g.normal(size=(kinds, dims))[g.integers(0, kinds, n)] + 0.3 * g.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def cloud(spark):
    x = vectors(1500, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[3].tolist()) for i in range(400)]  # a hot cell, ties
    bad = [(None, x[0].tolist()), (9000, None), (9001, [None] * 12), (9002, [float("nan")] * 12), (9003, [])]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5)


def brute_topk(rows, queries, k, digits):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q, v in queries:
        s = np.round(x @ np.array(v), digits)
        out[q] = [(int(ids[j]), s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def by_query(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


def test_vector_index_exact_and_recall(spark, cloud):
    rows, df = cloud
    queries = [r for r in rows if r[0] % 20 == 0]
    want = brute_topk(rows, queries, 5, 6)
    index = vector_index.build_index(df, "vec_id", "embedding", cells=24, sample=500)
    assert index.rows.sum() == len(rows)  # all are indexed, few were fitted on
    ask = df.where("vec_id % 20 = 0")
    for probes in (1, 4, 24):
        assert by_query(vector_index.search(index, ask, "vec_id", "embedding", 5, probes, exact=True, digits=6)) == want
    some = by_query(vector_index.search(index, ask, "vec_id", "embedding", 5, probes=6, digits=6))
    score = lambda got: np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert score(some) >= 0.95
    assert by_query(vector_index.search(index, ask, "vec_id", "embedding", 5, probes=24, digits=6)) == want


def test_vector_index_skips_cells(spark, cloud):
    rows, df = cloud
    index = vector_index.build_index(df, "vec_id", "embedding", cells=24)
    q = vector_index._vectors(df.where("vec_id % 20 = 0"), "vec_id", "embedding")
    rest = vector_index._wanted(q.withColumns({"least": F.lit(0.9), "done": F.lit(2)}), index, None).count()
    assert rest < 0.6 * q.count() * 22


def test_vector_index_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    index = vector_index.build_index(df, "vec_id", "embedding")
    assert by_query(vector_index.search(index, df, "vec_id", "embedding", 5, exact=True)) == {1: [(1, 1.0), (2, 0.0)], 2: [(2, 1.0), (1, 0.0)]}
    empty = vector_index.build_index(df.limit(0), "vec_id", "embedding")
    assert vector_index.search(empty, df, "vec_id", "embedding", 5, exact=True).count() == 0


def brute_bm25(docs, queries, k):
    toks = [(i, (t or "").lower().split()) for i, t in docs]
    n, avgdl = len(toks), sum(len(t) for _, t in toks) / len(toks)
    df = Counter(w for _, t in toks for w in set(t))
    idf = {w: log(n - c + 0.5) - log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    out = {}
    for q, text in queries:
        hits = []
        for i, t in toks:
            tf = Counter(t)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in text.lower().split() if w in tf)
            if s > 0:
                hits.append((-round(s, 6), i))
        if hits:
            out[q] = [(i, -s) for s, i in sorted(hits)[:k]]
    return out


WORDS = [f"word{k}" for k in range(400)]


def texts(n, seed):
    g = random.Random(seed)
    return [" ".join(g.choices(WORDS, [1 / (k + 1) for k in range(400)], k=g.randrange(1, 60))) for _ in range(n)]


def test_postings_index_over_segments(spark, tmp_path):
    docs = list(enumerate(texts(700, 1))) + [(7000, None), (7001, ""), (7002, "word399 word399"), (7003, "word1 " * 500)]
    queries = list(enumerate(texts(20, 2))) + [(50, "word399"), (51, "unknown"), (52, "word0 word0 word5")]
    path = f"file://{tmp_path}/index"
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    for k in range(3):
        postings.append(df.where(f"doc_id % 3 = {k}"), path, segment=f"s{k}")
        own = [d for d in docs if d[0] % 3 <= k]
        got = by_query(postings.search(spark, path, q, 5))
        want = brute_bm25(own, queries, 5)
        assert {a: [(i, round(s, 5)) for i, s in b] for a, b in got.items()} == {a: [(i, round(s, 5)) for i, s in b] for a, b in want.items()}
    # what a failed call left behind is not read
    spark.createDataFrame([("zzz", 1)], "token string, df long").write.parquet(f"{path}/terms/segment=broken")
    assert by_query(postings.search(spark, path, q, 5)) == got
    plan = postings.search_plan(spark, path, q.where("query_id = 50 or query_id < 5"), 5)
    assert plan["groups"].count() <= plan["bounds"].count()


def test_postings_are_counted_where_documents_are_read(spark, tmp_path, monkeypatch):
    docs = list(enumerate(texts(300, 5))) + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = lambda path: sorted((r.token, r.grp, r.most_tf, r.least_dl, [tuple(p) for p in r.postings]) for r in spark.read.parquet(f"{path}/postings").collect())
    postings.append(df, f"file://{tmp_path}/a")
    got = rows(f"file://{tmp_path}/a")
    own = {}
    for n, (_, text) in enumerate(docs):
        words = (text or "").split()
        for w, tf in Counter(words).items():
            own.setdefault((w, n >> postings.GROUP_BITS), []).append((n & (postings.GROUP - 1), tf, len(words)))
    assert got == sorted((w, g, max(p[1] for p in ps), min(p[2] for p in ps), ps) for (w, g), ps in own.items())
    monkeypatch.setattr(postings, "_COUNT_TOKENS", 3)
    postings.append(df, f"file://{tmp_path}/b")
    assert rows(f"file://{tmp_path}/b") == got
    stored = spark.read.parquet(f"file://{tmp_path}/a/documents")
    plan = postings._blocks(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_postings_of_low_groups_are_left_out(spark, tmp_path):
    docs = [(i, "common " + ("rare " * (1 + i % 7) if i < 64 else " ".join(["filler"] * 30))) for i in range(2000)]
    path = f"file://{tmp_path}/index"
    postings.append(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), path)
    q = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    plan = postings.search_plan(spark, path, q, 5, first=1)
    assert plan["bounds"].count() > 30 and plan["groups"].count() == 1
    want = brute_bm25(docs, [(1, "rare common")], 5)
    got = by_query(postings.search(spark, path, q, 5, first=1))
    assert [i for i, _ in got[1]] == [i for i, _ in want[1]]


def test_postings_tasks_keep_the_best(spark, tmp_path, monkeypatch):
    docs = [(f"d{i:04}", t) for i, t in enumerate(["same words here"] * 500 + texts(200, 7))] + [(None, "same word3"), ("e", None), ("e", "word9 word9"), ("e", "word9")]
    queries = [(i, t) for i, t in enumerate(texts(6, 8))] + [(50, "same here"), (51, "unknown"), (52, "word9")]
    path = f"file://{tmp_path}/index"
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    for k in range(2):
        postings.append(df.where(f"pmod(xxhash64(doc_id), 2) = {k}"), path, segment=f"s{k}")
    q = spark.createDataFrame(queries, "query_id long, text string")
    rows = lambda: by_query(postings.search(spark, path, q, 5))
    got = rows()
    want = brute_bm25([(i or "", t) for i, t in docs], queries, 5)
    assert {a: [(i or "", round(s, 5)) for i, s in b] for a, b in got.items()} == {a: [(i, round(s, 5)) for i, s in b] for a, b in want.items()}
    # no row a pair: each task has the k best of a query at most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert postings.search_plan(spark, path, q, 5)["hits"].count() <= 5 * len(queries) * parts < 500
    # blocks of queries, and tables that are not broadcast
    for name, most in (("_BLOCK_TOKENS", 40), ("_SENT_GROUPS", 0), ("_ASKED", 0)):
        monkeypatch.setattr(postings, name, most)
    assert rows() == got


def test_overlap_gives_the_same_rows_on_both_paths(spark, monkeypatch):
    q = spark.createDataFrame([(1, "a b c"), (1, "a b"), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (None, "a")], "query_id long, text string")
    d = spark.createDataFrame([(1, "a b x"), (1, "a x y z"), (2, "c"), (2, "c"), (3, None), (4, ""), (None, "b c")], "doc_id long, text string")
    rows = lambda: sorted(((r.query_id, r.doc_id, round(r.score, 9)) for r in retrieve.token_overlap(q, d).collect()), key=str)
    few = rows()
    for name in ("QUERY_ROWS", "QUERY_TOKENS"):
        monkeypatch.setattr(retrieve, name, 0)
        assert rows() == few
        monkeypatch.undo()
    monkeypatch.setattr(retrieve, "_STEP_TOKENS", 2)
    assert rows() == few and few.count((1, 1, 0.666666667)) == 1 and few.count((2, 2, 0.577350269)) == 4


def test_bm25_top_keeps_the_best_in_its_tasks(spark, monkeypatch):
    docs = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "of", f"w{i % 7}")) for _ in range(rng.randrange(0, 12)))) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame([(1, "alpha w3 w3"), (2, "of beta"), (3, "nothing known"), (4, None)], "query_id long, text string")
    want = by_query(retrieve.top_k(retrieve.bm25(q, df).withColumn("score", F.round("score", 6)), "query_id", 5))
    for block in (256, 1):
        monkeypatch.setattr(retrieve, "_QUERY_BLOCK", block)
        monkeypatch.setattr(retrieve, "_SCORE_TOKENS", 50)
        assert by_query(retrieve.bm25_top(q, df, 5)) == want and set(want) == {1, 2}
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 0)
    assert by_query(retrieve.bm25_top(q, df, 5)) == want
    best = retrieve._Best(2, 3)
    for k in range(1000):
        best.put(np.array([0, 1]), np.array([float(k % 10), 1.0]), np.array([k, 1000 - k]))
    assert sum(len(x[0]) for x in best.held) <= 5 * 3 * 2 + 2 and list(best.taken()[2]) == [9, 19, 29, 1, 2, 3]


def test_cells_pass_by_their_queries_in_steps(spark, monkeypatch, cloud):
    rows, df = cloud
    queries = [r for r in rows if r[0] % 20 == 0]
    want, ask = brute_topk(rows, queries, 5, 6), df.where("vec_id % 20 = 0")
    monkeypatch.setattr(retrieve, "_STEP_PRODUCTS", 300)
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    index = vector_index.build_index(df, "vec_id", "embedding", cells=5, sample=500)
    assert by_query(vector_index.search(index, ask, "vec_id", "embedding", 5, 2, exact=True, digits=6)) == want
    good = lambda x: vector_index._vectors(x, "vec_id", "embedding").withColumn("cell", F.lit(3))
    hits = retrieve.best_in_cells(good(ask), good(df), 5, 6)
    assert by_query(retrieve.top_k(hits, "query_id", 5)) == want and hits.count() == 5 * len(queries)
    assert retrieve.best_in_cells(good(ask), good(df).withColumn("cell", F.lit(4)), 5, 6).count() == 0
