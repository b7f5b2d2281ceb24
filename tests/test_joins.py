"""Interval joins, quantiles, mention graphs and source functions: against brute force, with hot keys, and in linear time."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomcrest.functions import source
from loomcrest.operators import evaluate, intervals, joins, logs, mentions, quantiles


def ranges(g, n, keys, most):
    out = []
    for i in range(n):
        s = g.randrange(-500, 5000)
        out.append((i, g.choice(keys), s, s + int(g.paretovariate(0.6)) % most - g.choice((0, 0, 0, 1))))
    return out


@pytest.mark.parametrize("width", [None, 1, 64, 4096])
def test_overlaps_are_those_of_all_pairs(spark, width):
    g = random.Random(5)
    keys = ["hot"] * 9 + ["a", "b", None]
    a, b = ranges(g, 260, keys, 3000), ranges(g, 240, keys, 40) + [(900 + i, "hot", -(10**9), 10**9) for i in range(3)]
    a, b = a + a[:3] + [(800, "hot", None, 5)], b + b[:3] + [(801, "a", 5, None)]
    df = lambda rows, p: spark.createDataFrame(rows, f"{p}_id long, key string, {p}_s long, {p}_e long")
    got = joins.overlap_join(df(a, "a"), df(b, "b"), "key", ("a_s", "a_e"), ("b_s", "b_e"), width)
    rows = sorted((r.a_id, r.b_id, r.clip_start, r.clip_end) for r in got.collect())
    whole = lambda rows: [r for r in rows if None not in r and r[2] <= r[3]]
    want = sorted((x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in whole(a) for y in whole(b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert rows == want and len(want) > 800
    assert got.columns == ["key", "a_id", "a_s", "a_e", "b_id", "b_s", "b_e", "clip_start", "clip_end"] or set(got.columns) == {"key", "a_id", "a_s", "a_e", "b_id", "b_s", "b_e", "clip_start", "clip_end"}


def test_a_file_with_nearly_all_rows(spark):
    """No task gets more than a few hundredths of the pairs' inputs, though one key has 90 % of the rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "big.sol").otherwise(F.concat(F.lit("f"), F.col("id") % 97)).alias("file"), (F.col("id") * 7919 % 20_000).alias("line"))
        r = spark.range(4000).select(F.when(F.col("id") % 10 > 0, "big.sol").otherwise(F.concat(F.lit("f"), F.col("id") % 97)).alias("file"), F.col("id").alias("n"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + F.when(F.col("id") % 50 == 0, 4000).otherwise(4)).alias("end"))
        out = joins.range_join(p, r, "file", "line", "start", "end")
        sizes = [x["n"] for x in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        plain = p.join(r, "file").where("line between start and end").count()
        assert sum(sizes) == plain and len(sizes) > 30 and max(sizes) < 0.15 * plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_base_width(spark):
    df = spark.createDataFrame([(i, i + 40) for i in range(50)] + [(5, 5)] * 99, "s long, e long")
    assert intervals.base_width([(df, "s", "e")]) == 64 and intervals.base_width([(df.where("s = e"), "s", "e")]) == 1


@pytest.mark.parametrize("partitions", [None, 1, 13])
def test_quantiles_are_exact(spark, partitions):
    g = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 500), ("b", 1), ("c", 2), (None, 40)) for v in np.round(g.normal(size=n), 2)] + [("hot", 1.5)] * 700 + [("hot", 9.0), ("empty", None), ("a", None)]
    asked = {"p0": 0.0, "p1": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = quantiles.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", asked, partitions).collect()
    assert {r.k for r in got} == {"a", "b", "c", None, "hot"}
    for r in got:
        own = [v for k, v in rows if k == r.k and v is not None]
        assert [r[p] for p in asked] == pytest.approx([np.quantile(own, q) for q in asked.values()])


def test_quantiles_of_a_million_values(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    got = quantiles.quantiles(df, [], "v", {"a": 0.25, "b": 0.999}, 50).first()
    x = np.arange(1_000_000) * 7919 % 1_000_003
    assert [got.a, got.b] == pytest.approx(np.quantile(x, [0.25, 0.999]).tolist())
    counted = df.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange(50, "v")
    assert max(r["n"] for r in counted.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 3 * 1_000_000 / 50  # what a task holds
    assert quantiles.quantiles(df.where("v < 0"), [], "v", {"a": 0.5}).count() == 0


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 10), ("b", None), (None, 4)], "g string, n int")
    one = logs.length_summary(df, "n", over=3).first()
    assert (one.n, one.min, one.max, one.p50, one.n_over, one.n_saved) == (4, 1, 10, 3.0, 2, 2)
    by = {r.g: r for r in logs.length_summary(df, "n", groups=["g"]).collect()}
    assert (by["a"].p50, by[None].p99, by["b"].n, by["b"].p50) == (2.0, 4.0, 0, 0.0)
    none = evaluate.score_summary(df.where("n > 99"), "n").first()
    assert (none.count if isinstance(none.count, float) else none["count"], none["p90"]) == (0.0, 0.0)


def brute_mentions(rows, most):
    rows = {r for r in rows if r[0] is not None and r[1] is not None}
    out = {(g, n): (set(), set()) for g, n, _ in rows}
    for g, n, t in rows:
        for h, o, _ in rows:
            if g == h and n != o and t is not None and o in t:
                out[g, n][0].add(o)
                out[g, o][1].add(n)
    return {k: tuple(sorted(s)[:most] for s in v) for k, v in out.items()}


@pytest.mark.parametrize("shares", [1, 256])
def test_mentions_are_those_of_all_pairs(spark, monkeypatch, shares):
    monkeypatch.setattr(mentions, "SHARES", shares)
    g = random.Random(3)
    names = ["add", "addAll", "é", "a b", "", "x" * 40, *(f"n{i}" for i in range(30))]
    rows = [(g.choice(["hot"] * 8 + ["b", None]), g.choice([*names, None]), g.choice([None, "", " ".join(g.choices(names, k=6)), "nothing"])) for _ in range(300)]
    got = mentions.mention_graph(spark.createDataFrame(rows + rows[:9], "g string, n string, t string"), "g", "n", "t").collect()
    want = brute_mentions(rows, 3)
    assert {(r.g, r.n): (r.callees, r.callers) for r in got if r.g is not None and r.n is not None} == want
    assert all(r.callees == r.callers == [] for r in got if r.g is None or r.n is None)


def timed(f):
    at = time.time()
    f()
    return time.time() - at


def test_mentions_take_linear_time(spark):
    def run(n):
        df = spark.range(n).select(F.lit("g").alias("g"), F.concat(F.lit("name"), F.col("id")).alias("n"), F.concat_ws(" ", *(F.concat(F.lit("name"), F.col("id") * k % n) for k in range(1, 9))).alias("t"))
        return timed(lambda: mentions.mention_graph(df, "g", "n", "t").write.format("noop").mode("overwrite").save())

    run(1000)
    small, large = run(10_000), run(40_000)
    assert large < 8 * small + 2  # pairs would take sixteen times as long


def test_snippets_and_functions_take_linear_time(spark):
    def lines(n):
        df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i)), "\n").alias("c"))
        return timed(lambda: df.select(F.md5(source.snippet(F.col("c"), F.lit(1), F.array(F.lit(2), F.lit(n - 1))))).collect())

    def functions(n):
        code = "".join(f"function f{i}(uint a) public {{ f{(i * 7) % n}(a); }}\n" for i in range(n))
        df = spark.createDataFrame([(1, code)], "i int, c string")
        return timed(lambda: source.function_contexts(df, "c", "i").collect())

    for f, n, extra in ((lines, 4000, 0.5), (functions, 40, 0.7)):
        f(n)
        assert min(f(2 * n) for _ in range(2)) < 2.5 * min(f(n) for _ in range(3)) + extra


def test_snippet_lines(spark):
    df = spark.createDataFrame([("a\nb\nc\nd", [11, 12]), ("a\nb", [9]), ("a", None), (None, [1]), ("a\nb\nc", [10, 12, 99])], "c string, m array<int>")
    got = [r[0] for r in df.select(source.snippet(F.col("c"), F.lit(10), F.col("m"))).collect()]
    assert got == ["// Line 10: a\n// Line 11 (VULNERABLE): b\n// Line 12 (VULNERABLE): c\n// Line 13: d", "", "", None, "// Line 10 (VULNERABLE): a\n// Line 11: b\n// Line 12 (VULNERABLE): c"]


def test_call_graph_of_names_inside_words(spark):
    code = "contract C { function add(uint a) public { } function addAll(uint a) public { x_add(a); } function both() public { addAll(1); } function add(uint b) public { both(); } }"
    got = {r.name: (r.callees, r.callers) for r in source.function_contexts(spark.createDataFrame([("f", code)], "f string, c string"), "c", "f").collect()}
    assert got == {"add": (["both"], ["addAll", "both"]), "addAll": (["add"], ["both"]), "both": (["add", "addAll"], ["add"])}


def test_functions_of_one_range_meet_their_notes_once(spark):
    n = 20_000
    functions = spark.range(n).select(F.lit("p").alias("path"), F.col("id").cast("string").alias("name"), F.lit(10).alias("start"), F.lit(19).alias("end"))
    functions = functions.unionByName(spark.createDataFrame([("p", None, 30, 31), ("p", "open", None, 5), ("q", "none", 1, 2)], "path string, name string, start int, end int"))
    line = lambda k: (F.lit(k) + F.col("id") * 0).cast("int")
    notes = spark.range(n).select(F.lit("p").alias("path"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("category"), F.array(line(12), line(12), line(15), line(30)).alias("lines"))
    notes = notes.unionByName(notes.where("category = 'c000000'"))
    got = joins.annotation_counts(functions, notes)
    assert {tuple(r) for r in got.select("n", "marked", "first_category", F.count("*").over(Window.partitionBy("start", "path"))).distinct().collect()} == {(n + 1, 3 * n + 3, "c000000", n), (n + 1, n + 1, "c000000", 1), (0, 0, None, 1)}
    few = joins.annotated_functions(functions.where("name is null or name in ('7', 'open', 'none')"), notes.where("category < 'c000003'"))
    assert {(r.path, r.name): [(v.category[-1], v.lines) for v in r.vulnerabilities] for r in few.collect()} == {("p", "7"): [(c, [12, 12, 15]) for c in "0012"], ("p", None): [(c, [30]) for c in "0012"], ("p", "open"): [], ("q", "none"): []}


def test_counts_of_notes_are_read_of_their_lists(spark):
    functions = spark.createDataFrame([("p", "a", 1, 9), ("p", "b", 1, 9), ("p", "c", 20, 30), ("p", None, None, 3), ("q", "d", 1, 9)], "path string, name string, start int, end int")
    notes = spark.createDataFrame([("p", "y", [3, 40, 3]), ("p", "y", [3, 40, 3]), ("p", "x", [9]), ("p", None, [5, 21]), ("p", "z", None), (None, "z", [1])], "path string, category string, lines array<int>")
    lists = joins.annotated_functions(functions, notes)
    got = {(r.path, r.name): r for r in joins.annotation_counts(functions, notes).collect()}
    for r in lists.collect():
        v, c = r.vulnerabilities, got[r.path, r.name]
        assert (c.n, c.marked, c.first_category, c.is_vulnerable) == (len(v), sum(len(x.lines) for x in v), min((x.category for x in v if x.category is not None), default=None), r.is_vulnerable)
    assert [(x.category, x.lines) for x in lists.where("name = 'b'").first().vulnerabilities] == [(None, [5]), ("x", [9]), ("y", [3, 3]), ("y", [3, 3])]
    assert "collect_list" in joins.annotation_counts(functions, notes)._jdf.queryExecution().optimizedPlan().toString()
