"""Whole results against SQL and brute force on the smallest tables, and hard inputs of every stage."""

import collections
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcrest.llm import _common, chat_format, decontaminate, lm_score, mixing, quality_rules, registry, secrets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "sales"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, registry.queries()[name](spark, SF).select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_packed_texts():
    ids, texts = [1, None, -3, 4], [b"a", None, b"", "é".encode() * 9]
    assert _common.unpack_texts(_common.pack_texts(ids, texts)) == (ids, texts)
    assert _common.unpack_texts(_common.pack_texts([], [])) == ([], [])


def brute_lm(rows):
    """The mixture's scores by plain counts; its weights by EM on every token, in the statistics' steps."""
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    text = {i: [*lower(t), None] for i, t in rows}
    train = [i for i in text if fold(i, 7) != 2]
    dev = [i for i in train if fold(i, 70) == 3]

    def counts(ids):
        one, two = collections.Counter(), collections.Counter()
        for i in ids:
            one.update(text[i])
            two.update(zip(["begin", *text[i][:-1]], text[i], strict=True))
        return one, two, len(ids)

    def terms(i, one, two, n):
        total = sum(one.values())
        for v, w in zip(["begin", *text[i][:-1]], text[i], strict=True):
            c = n if v == "begin" else one[v]
            yield min(int(math.log2(c)) + 1, lm_score.BUCKETS - 1) if c else 0, two[v, w] / max(c, 1), one[w] / total

    full = counts(train)
    uniform = 1 / (len(full[0]) + 1)
    part = counts([i for i in train if i not in dev])
    step = lambda p: round(math.log2(p / uniform) * 8) if p else lm_score._ZERO
    seen = collections.Counter((b, step(p), step(q)) for i in dev for b, p, q in terms(i, *part))
    weights = np.tile([0.4, 0.5, 0.1], (lm_score.BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]
    for b in range(lm_score.BUCKETS):
        x = [(*k[1:], n) for k, n in seen.items() if k[0] == b]
        if sum(n for *_, n in x) < 50:
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        a = weights[b]
        for _ in range(100):
            new = np.full(3, 1e-3)
            for p, q, n in x:
                each = a * np.array([*(0 if s == lm_score._ZERO else uniform * 2 ** (s / 8) for s in (p, q)), uniform])
                new += n * each / each.sum()
            a = new / new.sum()
        weights[b] = a
    return {i: sum(math.log10(weights[b] @ [p, q, uniform]) for b, p, q in terms(i, *full)) for i in text}


def test_lm_score(spark, rows):
    want = brute_lm(rows)
    assert sum(zlib.crc32(str(i).encode()) % 70 == 3 for i, _ in rows) > 0
    for r in lm_score.score(spark.read.parquet(f"{SF}/documents.parquet"), chunk_bytes=50_000).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)


def test_em_counts_rare_words():
    """A unigram estimate far below uniform must not look like it."""
    rare = lm_score.step_of(np.array([1e-6 / 50]), 1e-6)[0]
    assert rare < 0 and lm_score.step_of(np.array([0.0]), 1e-6)[0] == lm_score._ZERO
    w = lm_score.learn_weights([(4, lm_score._ZERO, int(rare), 1000)], 1e-6)
    assert w[4][2] > 0.95


def test_quality_verdicts(spark, rows):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out, name, rules = quality_rules.quality_rules(docs, labels)
    for r in out.collect():
        c = {k: np.array([float(v)]) for k, v in r[name].asDict().items() if k in quality_rules.COUNTS}
        x = {f: make(c) for f, make in quality_rules.FEATURES.items()}
        kept = not r[name].base_failed
        for rule in rules if kept else []:
            if rule.mask(x)[0]:
                kept = rule.keep
                break
        assert r[name].kept == kept
    again = docs.unionByName(docs.withColumn("text", F.lit("x")))  # an id's rows count as one
    assert quality_rules.quality_rules(again, labels)[0].count() == 2 * len(rows)


def brute_tiles(pattern, text, least):
    """Greedy string tiling as it is defined: the longest unmarked common run, first in the pattern, then in the text."""
    mp, mt, covered = [False] * len(pattern), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and not mp[p + n] and not mt[t + n] and pattern[p + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return covered
        mp[p : p + n], mt[t : t + n] = [True] * n, [True] * n
        covered += n


def test_contaminated_pairs(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 25)))) for i in range(8)] + [(9, None), (10, "")]
    docs = []
    for i in range(60):
        parts = [rng.choices(words, k=rng.randrange(0, 12)) for _ in range(3)]
        if i % 2:
            own = (items[i % 8][1] or "").split()
            cut = rng.randrange(1, len(own))
            parts.insert(1, own[cut:])
            parts.insert(3, own[:cut])
        docs.append((i, " ".join(w for p in parts for w in p)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for percent in (50, 80, 100):
        got = {(r.doc_id, r.item_id): r.covered_words for r in decontaminate.contaminated(df, bench, coverage_percent=percent).collect()}
        want = {}
        for i, t in docs:
            for k, p in items:
                ws = (p or "").split()
                n = brute_tiles(ws, t.split(), min(5, len(ws))) if ws else 0
                if ws and 100 * n >= percent * len(ws):
                    want[i, k] = n
        assert got == want and (percent < 100 or want)


def test_mixing_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}" if i % 5 else None) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    # the contract's words: by weight, at most three times a source's size, the excess to the others
    weight, goal, left, live = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, sum(size.values()), set(order)
    while live:
        over = {s for s in live if left * weight[s] / sum(weight[x] for x in live) > 3 * size[s]}
        if not over:
            total = sum(weight[x] for x in live)
            goal |= {s: left * weight[s] / total for s in live}
            break
        goal |= {s: 3 * size[s] for s in over}
        left -= sum(goal[s] for s in over)
        live -= over
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r.target, goal[r.source]) and r.source_size == size[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) < 300 for s in order)


LONG = "lorem ipsum dolor " * 30_000


def test_very_long_texts(spark):
    text = LONG + "user=al pwd=hunter2 " + LONG + "password: abcdefghijklmnop"
    got = secrets.scan(spark.createDataFrame([(1, text, 5, "x")], "doc_id long, text string, start int, kind string")).first()
    assert [(s.kind, text[s.start : s.end]) for s in got.spans] == [("account", "user=al"), ("phrase", "pwd=hunter2"), ("assign", "password: abcdefghijklmnop")]
    turns = spark.createDataFrame([(1, 0, "user", LONG, 9), (1, 1, "assistant", LONG + "#", 9)], "conv_id long, turn long, role string, text string, formatted int")
    r = chat_format.digest(chat_format.format_conversations(turns)).first()
    assert (r.n_turns, r.loss_chars) == (2, len(LONG) + 1)


HARD = [(1, "", "x", "a"), (2, None, "x", None), (3, " \n\t ", None, "b"), (4, "one two three four five six " * 5, "x", "a"), (4, "one two three four five six " * 5, "x", "a"), (5, LONG[:90_000], "x", "a"), (6, "seven words that no other text has here", "x", "b"), (None, "no id at all", "x", "a")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "c", 1) for r in HARD], "doc_id long, text string, lang string, source string, n_chars long, kept int, quality_stats string, size int")


def test_stage_rows(spark, hard):
    import corpus_pipeline as p

    texts = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    stage = dict(p.STAGES)
    kept = stage["quality_rules"](spark, hard, SF)
    # fewer than 20 words go, and so do texts that repeat themselves
    assert kept.columns == hard.columns and texts(kept) == []
    fine = spark.createDataFrame([(77, "The old mill by the river turned slowly all through the warm summer while children ran along its banks and laughed at every passing boat.")], "doc_id long, text string")
    with_fine = hard.unionByName(fine, allowMissingColumns=True)
    assert [i for i, _ in texts(stage["quality_rules"](spark, with_fine, SF))] == [77]
    near = stage["near_dedup"](spark, hard, SF)
    assert near.columns == hard.columns and texts(near) == texts(hard)  # an id's rows stay together; nothing else is alike
    clean = stage["decontamination"](spark, hard, SF)
    assert clean.columns == hard.columns and texts(clean) == texts(hard)
    mixed = stage["mixing"](spark, hard, SF)
    assert mixed.columns == hard.columns and {r.doc_id for r in mixed.collect()} >= {1, 2, 3} and set(texts(mixed)) <= set(texts(hard))
    index = stage["token_output"](spark, hard, SF).orderBy("start").collect()
    assert len(index) == len(HARD) and [r.n_tokens for r in index if r.doc_id in (1, 2)] == [1, 1]
    assert [r.start for r in index] == [sum(x.n_tokens for x in index[:k]) for k in range(len(index))]
    for name, f in p.STAGES:
        assert f(spark, hard.limit(0), SF).count() == 0, name


def dense_label_model(x, prior, rounds=50, correlated=0.4):
    """The model by its definition, on lists, with every pair of voters."""
    from math import exp, log, sqrt

    n, m = len(x), len(x[0])
    post = [0.95 if sum(r) >= 2 else 0.3 if sum(r) == 1 else 0.02 for r in x]
    weight = [1.0] * m
    for k in range(rounds):
        on = []
        for c in (0, 1):
            q = [p if c else 1 - p for p in post]
            on.append([(sum(a * r[j] for a, r in zip(q, x, strict=True)) + 0.1) / (sum(q) + 1) for j in range(m)])
        if k in (5, 20):
            e = [[r[j] - (1 - p) * on[0][j] - p * on[1][j] for j in range(m)] for r, p in zip(x, post, strict=True)]
            cov = [[sum(r[i] * r[j] for r in e) / n for j in range(m)] for i in range(m)]
            sd = [sqrt(cov[j][j]) + 1e-9 for j in range(m)]
            weight = [1 / max(1, sum(cov[i][j] / sd[i] / sd[j] > correlated for j in range(m))) for i in range(m)]
        new = []
        for r in x:
            s = log(prior / (1 - prior)) + sum(v * max(0, w * (log(b) - log(a))) for v, w, a, b in zip(r, weight, *on, strict=True))
            s += max(-4, sum((1 - v) * w * log((1 - b) / (1 - a)) for v, w, a, b in zip(r, weight, *on, strict=True)))
            new.append(1 / (1 + exp(-max(-30, min(30, s)))))
        gap = max(abs(a - b) for a, b in zip(new, post, strict=True))
        post = new
        if gap < 1e-6:
            break
    return post, weight


def random_votes(seed, n=200, m=14):
    import numpy as np

    g = np.random.default_rng(seed)
    y = g.random(n) < 0.3
    x = (g.random((n, m)) < np.where(y[:, None], 0.35, 0.04)).astype(int)
    x[:, 1] = x[:, 0]  # equal voters
    x[:, 2] = x[:, 0] * (g.random(n) < 0.9)
    x[:, 3] = 0  # one that never fires
    return x, y


def test_label_model_is_its_definition():
    import numpy as np

    from loomcrest.llm import toxicity

    for seed in range(4):
        x, _ = random_votes(seed)
        post, weight = toxicity.label_model(toxicity.Votes.of([np.flatnonzero(r) for r in x], x.shape[1]), 0.3)
        want, want_weight = dense_label_model(x.tolist(), 0.3)
        assert np.allclose(post, want, atol=1e-6) and np.allclose(weight, want_weight) and weight[0] <= 0.5


def test_linear_fit_is_the_minimum():
    import numpy as np

    from loomcrest.llm import toxicity

    for seed in range(3):
        x, y = random_votes(seed)
        y = np.where(y, 0.9, 0.05)
        w = toxicity.fit_linear(toxicity.Votes.of([np.flatnonzero(r) for r in x], x.shape[1]), y)
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        gradient = np.append(x.T @ (p - y) + 0.3 * w[:-1], (p - y).sum() + 1e-6 * w[-1])
        assert np.abs(gradient).max() < 1e-4


def test_many_voters_need_no_matrix():
    import numpy as np

    from loomcrest.llm import toxicity

    g = np.random.default_rng(1)
    votes = toxicity.Votes.of([g.integers(0, 60_000, 12) for _ in range(4000)], 60_000)  # a matrix of pairs had 29 GB
    post, weight = toxicity.label_model(votes, 0.2, rounds=8)
    assert len(weight) == 60_000 and len(toxicity.fit_linear(votes, post, rounds=2)) == 60_001


def test_tiling_of_one_word_is_bounded():
    import tracemalloc

    from loomcrest.llm import decontaminate

    tracemalloc.start()
    tiles = decontaminate.tile([1] * 200, [1] * 4000, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for *_, n in tiles) == 200 and peak < 3_000_000


def test_decontamination_in_many_blocks(spark):
    from loomcrest.llm import decontaminate

    item = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    bench = spark.createDataFrame([(k, item(k)) for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"a b {item(k)} c") for k in range(9)] + [(50, "clean words only")], "doc_id long, text string")
    for words in (12, 30, 1000):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_words=words).collect())
        assert got == [(k, k) for k in range(9)]
        assert [r.doc_id for r in decontaminate.decontaminated(docs, bench, block_words=words).collect()] == [50]


def test_near_duplicates_exact_setting(spark):
    """rows=1 and no slack: every pair of 0.8 or more is linked, whatever its signature."""
    import random

    from loomcrest.llm import minhash

    g = random.Random(70)
    docs = []
    for k in range(40):
        base = [f"w{g.randrange(4000)}" for _ in range(g.choice((6, 12, 30, 60)))]
        docs.append(" ".join(base))
        for _ in range(2):
            docs.append(" ".join(w if g.random() < 0.96 else f"x{g.randrange(4000)}" for w in base))
    rows = list(enumerate(docs))
    sets = {i: frozenset(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
                links += 1
    assert links > 15
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"rows": 1, "slack": float("inf")}, {}):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, width=2, **how).collect()}
        assert got == {i: root(i) for i in sets}


def test_planted_pairs_at_the_threshold(spark):
    """Of near copies whose exact similarity is 0.8 or more, all are in one group (the driver's own copies include ones below)."""
    from loomcrest.llm import minhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs.select("doc_id", "text"), width=5).collect()}

    def shingles(t):
        ws = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        return frozenset(tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, bool(ws))))

    by, pairs, caught = {}, set(), 0
    sets = {i: shingles(t) for i, t in text.items()}
    for i, s in sets.items():
        for x in list(s)[:400]:
            by.setdefault(x, []).append(i)
    for ids in by.values():
        pairs |= {(a, b) for a in ids[:60] for b in ids[:60] if a < b}
    near = [(a, b) for a, b in pairs if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    caught = sum(got[a] == got[b] for a, b in near)
    assert near and caught == len(near)
