"""Operators on hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from loomcrest.functions import taxonomy
from loomcrest.operators import audit, curate, joins, logs, providers, retrieve, store
from loomcrest.sources import readers, sinks


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([("k1", "a", 1)], "k string, v string, created int")
    new = spark.createDataFrame([("k1", "b", 2, 0), ("k1", "c", 3, 1), ("k2", "d", 4, 2)], "k string, v string, created int, seq int")
    assert {tuple(r) for r in store.upsert(old, new, "k", "seq", keep=("created",)).collect()} == {("k1", "c", 1), ("k2", "d", 4)}
    has = spark.createDataFrame([(7, 1), (7, 2)], "f int, v int")
    more = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "f int, seq int")
    assert sorted((r.f, r.v) for r in store.append_versions(has, more, "f", "v", "seq").collect()) == [(7, 3), (7, 4), (8, 1)]


def test_dedup_keeps_first_of_best(spark):
    x = spark.createDataFrame([(1, " x", 0), (2, "x ", 120), (3, "x", 120), (4, None, 0)], "seq int, code string, p int")
    assert sorted(r.seq for r in curate.dedup_priority(x, "code", F.col("p"), "seq").collect()) == [2, 4]
    p = curate.priority(F.lit(False), F.lit(True), F.lit(2), F.lit(False), F.lit(None))
    assert spark.range(1).select(p.alias("p")).first().p == 120


def test_samples_and_splits(spark):
    x = spark.range(103).select("id", (F.col("id") < 3).alias("y"))
    got = curate.balanced_sample(x, "y", "id", 10, 0.5)
    assert got.where("y").count() == 3 and got.count() == 8
    for n, want in ((10, [8, 1, 1]), (7, [5, 0, 2])):
        s = curate.split(spark.range(n), "id", {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
        assert [sum(r.split == p for r in s) for p in ("train", "val", "test")] == want and len({r.id for r in s}) == n
    with pytest.raises(ValueError):
        curate.split(spark.range(1), "id", {"a": 0.5})
    eras = spark.createDataFrame([(v,) for v in ("0.4.25", "0.6.12", "0.7.0", "0.8.1", "1.2.3", "1.0")], "v string").select(curate.era(F.col("v")).alias("e")).collect()
    assert [r.e for r in eras] == ["early", "late", "transition", "modern", "modern", "unknown"]


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "a b c d")], "query_id int, text string")
    d = spark.createDataFrame([(1, "a b x"), (2, "z")], "doc_id int, text string")
    assert [(r.doc_id, round(r.score, 6)) for r in retrieve.token_overlap(q, d).collect()] == [(1, 0.57735)]
    hits = [("X", "token", 0, 0.8, 0), ("Y", "token", 0, 0.4, 1), ("W", "token", 0, 0.2, 2), ("Z", "bm25", 1, 5.0, 3), ("X", "bm25", 1, 3.0, 4)]
    h = spark.createDataFrame([(1, *x) for x in hits], "query_id int, doc_key string, source string, source_rank int, score double, seq int")
    got = retrieve.fuse(retrieve.merge_sources(h)).orderBy(F.desc(F.round("fused", 6)), "seq").collect()
    assert [(r.doc_key, round(r.fused, 6)) for r in got] == [("Y", 0.35), ("Z", 0.35), ("X", 0.0), ("W", 0.0)]
    p = spark.createDataFrame([(1, 1, 50, "a"), (1, 2, 80, "b"), (1, 3, 20, "c")], "query_id int, rank int, cost int, doc_id string")
    assert retrieve.pack(p, "cost", 80, 6).first()["items"] == ["a", "c"]
    sign = spark.range(1).select(retrieve.signature(F.lit("function f() { if (x) y.call(); emit E(); }")).alias("s")).first().s
    assert sign == ["function f", "if", "call", "emit E"]
    m = spark.createDataFrame([(1, i, s, t, i) for i, s, t in ((0, 1.0, "aaaa"), (1, 0.9, "aaaa"), (2, 0.8, "zzzz"))], "query_id int, doc_id int, score double, text string, seq int")
    assert [r.doc_id for r in retrieve.mmr(m, 2).orderBy("rank").collect()] == [0, 2]


def test_logs(spark):
    x = spark.createDataFrame([(0, i, c) for i, c in enumerate((5.0, 0.0, 0.0, 2.0))], "g int, i int, c double")
    assert [round(r["lambda"], 6) for r in logs.multiplier(x, "c", ["g"], ["i"]).orderBy("i").collect()] == [0.225, 0.2, 0.175, 0.25]
    e = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "g int, i int, v double")
    assert [round(r.baseline, 6) for r in logs.ema(e, "v", "g", "i").orderBy("i").collect()] == [0.1, 0.29]
    m = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.5)], "k string, s double")
    assert sorted((r.k, round(r.s_mean, 6), round(r.s_std, 6)) for r in logs.mean_std(m, ["k"], ["s"]).collect()) == [("a", 0.6, 0.141421), ("b", 0.5, 0.0)]
    assert round(logs.length_summary(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "n int"), "n").first().p90, 6) == 3.7


def test_joins_and_audit(spark):
    r = spark.createDataFrame([("f", 10, 14), ("f", 15, 20), ("f", 17, 30)], "k string, s int, e int")
    b = spark.createDataFrame([("f", 12, 16)], "k string, s2 int, e2 int")
    assert sorted((x.clip_start, x.clip_end) for x in joins.overlap_join(r, b, "k", ("s", "e"), ("s2", "e2")).collect()) == [(12, 14), (15, 16)]
    p = spark.createDataFrame([("f", 14), ("f", 16), ("f", 31)], "k string, at int")
    plain = sorted(map(tuple, joins.range_join(p, r, "k", "at", "s", "e").collect()))
    assert plain == sorted(map(tuple, joins.range_join(p, r, "k", "at", "s", "e", width=7).collect())) and len(plain) == 2
    rows = spark.createDataFrame([(1, "{x"), (2, "[1]"), (3, " "), (4, None), (5, '{"a":1}')], "id int, c string")
    assert sorted(map(tuple, audit.issues(rows, "id", ["c"], []).collect())) == [(1, "c.malformed_json"), (2, "c.type")]
    f = spark.createDataFrame([("High", 1), ("Medium", 2), ("High", 3)], "severity string, id int").agg(F.collect_list(F.struct("severity", "id")).alias("x"))
    assert f.select(taxonomy.most_severe(F.col("x")).alias("y")).first().y.id == 1


def test_readers(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("./A_ext.sol;C.f(uint256);10;20\n./A_ext.sol;C.g();22;30\nbad;row\n./A_ext.sol;C.h();x;40\n")
    (tmp_path / "res.txt").write_text("".join(f"A_ext.sol {x}\n" for x in ("ARTHM 12 toolA", "ARTHM 12 toolB", "ARTHM 25 toolA", "UE 21 toolA", "RENT C.g() toolA", "RENT C.g() toolB", "DOS 30 toolC", "DOS 29 toolD", "LE 12 toolA")))
    ranges = readers.function_ranges(spark, str(tmp_path / "lines.txt"))
    assert sorted(r.function for r in ranges.collect()) == ["f", "g"]
    got = {(r.signature, r.category): (r.lines, r.tools) for r in readers.voted_functions(ranges, readers.findings(spark, str(tmp_path / "res.txt"))).collect()}
    assert got == {("C.f(uint256)", "arithmetic"): ([12], ["toolA", "toolB"]), ("C.g()", "reentrancy"): ([22], ["toolA", "toolB"]), ("C.g()", "denial_of_service"): ([29, 30], ["toolC", "toolD"])}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "BugLog_1.csv").write_text("loc,length,bug type\n12,5,Re-entrancy\nx,1,bad\n")
    assert [(r.name, r.start, r.end, r.kind) for r in readers.bug_logs(spark, str(tmp_path / "logs")).collect()] == [("1", 12, 16, "Re-entrancy")]
    (tmp_path / "a.jsonl").write_text('{"id":"1"}\n\nnope\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id string").count() == 1
    assert readers.json_lines_counted(spark, str(tmp_path / "a.jsonl"), "id string").count() == 2


def test_sinks_and_providers(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "b"), (2, "val", "a")], "id int, split string, t string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"), ["split"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["split", "id", "t"]
    calls = providers.call(df, "t", lambda t: {"passed": 1 / (t != "b") > 0}, "passed boolean", on_error="closed")
    assert sorted((r.t, r.passed, r.error is None) for r in calls.collect()) == [("a", True, True), ("b", False, False)]
