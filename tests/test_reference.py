"""Results that were read off the sources the engine is to agree with, case by case."""

import pytest
from pyspark.sql import functions as F

from loomcrest.functions import responses, similarity, source, taxonomy, text
from loomcrest.operators import audit, candidates, corpus, evaluate, labels


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (source.pragma_version, "pragma solidity >0.5.0;", "0.5.0"),
        (source.pragma_version, "pragma solidity ^0.5.0;", "0.5.0"),
        (source.pragma_full, "pragma solidity >= 0.4.22 <0.9.0;", "0.4.22"),
        (source.pragma_full, "pragma solidity <0.9.0 >=0.4.22;", "0.4.22"),
        (source.pragma_full, "pragma solidity ~0.6;", "0.6.0"),
        (source.pragma_full, "pragma solidity 0.4.1 || 0.5.2;", "0.4.1"),
        (source.minimum_version, "revert('x')", "0.4.22"),
        (source.minimum_version, "// constructor notes, emit nothing", "0.4.11"),
        (source.minimum_version, "emit E (1)", "0.4.21"),
        (source.minimum_version, "pragma solidity ^0.8.0;", "0.4.11"),
        (source.recommended_version, "pragma solidity ^0.8.0; constructor()", "0.8.0"),
        (source.recommended_version, "pragma solidity ^0.4.2; constructor()", "0.4.22"),
        (source.location, "x.sol#5-5", "Line 5"),
        (source.mutability, "function f() external pure payable", "payable"),
        (source.visibility, "function f() external private", "private"),
        (text.compact_code, "a;\n\n\n\nb; // x\n```\nc;  \n", "a;\n\nb;\nc;"),
        (text.strip_comments, "a // x\r\nb", "a \nb"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("want", "found"), [("0.5.3", "0.5.7"), ("0.5.9", "0.5.9"), ("0.4.1", "0.4.11"), ("0.7.1", "0.8.1"), ("0.7.0", "0.6.0"), ("0.9.0", "0.8.1")])
def test_closest_version(spark, want, found):
    have = F.array(*map(F.lit, ("0.4.26", "0.5.7", "v0.6.0", "0.5.9", "0.8.1", "0.4.2")))
    assert one(spark, want, lambda v: source.closest_version(v, have)) == found


def test_gate_features(spark):
    f = lambda t: one(spark, t, source.gate_features)
    assert f("x REENTRANCY overflow")[1:] == [0, 0, 0, 0, 1, 1, 0, 0, 1] and f(None) == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert f("a.call(b) tx.origin require( blockhash onlyOwner")[1:] == [1, 1, 0, 1, 0, 0, 1, 1, 1] and f("z" * 9000)[0] == 1


def test_flags(spark):
    f = one(spark, "for (;;) { if (a) { b.staticcall(c); } } x = 1; function viewer() payable", source.flags)
    assert (f.has_loops, f.has_if_statements, f.complexity, f.has_external_calls, f.has_state_changes, f.has_require, f.is_view, f.is_payable, f.is_pure) == (True, True, 2, True, True, False, True, True, False)
    assert not one(spark, "a.send(b)", source.flags).has_external_calls


@pytest.mark.parametrize(("word", "kind", "want"), [("High", "access control", 10.0), ("high", "x", 5.0), ("Medium", "tx-origin-delegatecall", 7.0), ("Low", "", 4.0), ("Low", "Code Quality", 1.0)])
def test_severity(spark, word, kind, want):
    assert one(spark, word, lambda w: taxonomy.severity_score(w, F.lit(kind))) == want


def test_kinds(spark):
    assert one(spark, "Access Control", taxonomy.severity_estimate) == 8 and one(spark, "tx-origin", taxonomy.reason).endswith("phishing attacks.")
    assert one(spark, "odd", taxonomy.reason) == "The function contains a odd vulnerability."
    assert one(spark, "TOD", taxonomy.swc_loose) == ["SWC-114"] and one(spark, "rounding math", taxonomy.swc_loose) == [] and one(spark, "replay attack", taxonomy.swc_loose) == ["SWC-121"]
    details = F.array(F.struct(F.lit("b").alias("type")), F.struct(F.lit(None).cast("string").alias("type")))
    assert one(spark, "s", lambda s: taxonomy.type_list(F.array().cast("array<string>"), details, s)) == ["b"]


def test_suspicious(spark):
    f = lambda o, x: one(spark, x, lambda c: audit.suspicious(F.lit(o), c))
    assert f("tx.origin", "TX.ORIGIN") == ["uses_tx_origin"] and f("x", "rethrown") == [] and f("x", "throw;") == ["may_disable_functionality"]
    assert f("a" * 21, "b" * 10) == [] and f("a" * 22, "b" * 10) == ["much_shorter_than_original"] and f("", "") == []


def test_route(spark):
    rows = [(None, None, None), ("null", None, "made"), ("{}", None, None), ("{..}", "vulnerable", None), ("{..}", "unknown", None), ("{..}", None, None)]
    df = spark.createDataFrame(rows, "a string, l string, f string").select(candidates.route(F.col("a"), F.col("l"), F.col("f")).alias("r"))
    assert [r.r for r in df.collect()] == ["no_annotation", "processed", "no_annotation", "processed", "safe", "safe"]


def test_vulnerability_info(spark):
    f = lambda t: one(spark, t, text.vulnerability_info)
    got = f("- Type: A; B/C\nthe Vulnerability types: D|E,\n- Severity: 7.5\nmy severity : 3 or so")
    assert (got.types, got.severity) == (["A", "B", "C", "D", "E"], 3.0)
    assert (f("nothing").types, f("severity: high").severity) == (["Unknown"], None)


def test_costs(spark):
    df = spark.createDataFrame([(True, 0, False, False), (True, 3, False, True), (True, 0, True, False), (False, 9, True, True)], "c boolean, n int, p boolean, s boolean")
    assert [r.x for r in df.select(similarity.cost(F.col("c"), F.col("n"), F.col("s"), passed=F.col("p")).alias("x")).collect()] == [1, 4, 0, 6]
    r = df.select(F.round(similarity.reward(F.col("c"), F.col("p"), F.lit(0.5), F.lit(0.9), F.lit(1.0)), 6).alias("x")).collect()
    assert [x.x for x in r] == [1.01, 1.01, 1.91, 0.11]


@pytest.mark.parametrize(
    ("value", "note", "fix"),
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}', '{"a": 1}'),
        ('{"a": {"b": 1}} x {"c": 2}', '{"a": {"b": 1}} x {"c": 2}', '{"a": {"b": 1}}'),
        ('so {"a": "}"} end', '{"a": "}', '{"a": "}"}'),
        ('so {"a": [1, "]"]} end', '{"a": [1, "]"]}', '{"a": [1, "]"]}'),
        ("none", None, None),
        ("", None, None),
    ],
)
def test_json_in_text(spark, value, note, fix):
    assert one(spark, value, responses.json_of_annotation) == note and one(spark, value, responses.json_of_fix) == fix


def test_json_of_long_texts(spark):
    inner = ", ".join(f'"k{i}": "v{i}"' for i in range(3000))
    assert one(spark, f"so {{{inner}}} end", responses.json_of_fix) == f"{{{inner}}}" == one(spark, f"so {{{inner}}} end", responses.json_of_annotation)


def test_annotation(spark):
    a = one(spark, '{"is_safe": false, "analysis": ["x", "y"], "severity": "7.5", "vulnerability_types": ["T"], "slither_critique": "c"}', lambda c: responses.annotation(c, F.lit(False)))
    assert (a.label, a.analysis, a.severity, a.confidence, a.vulnerability_types, a.agreement, a.disagreement.tool, a.disagreement.critique) == ("vulnerable", "x\ny", 7.5, 0.5, ["T"], True, "safe", "c")
    assert one(spark, '{"severity": null}', lambda c: responses.annotation(c, F.lit(None).cast("boolean"))) is None
    assert one(spark, "[1]", lambda c: responses.annotation(c, F.lit(None).cast("boolean"))) is None


def test_nulls_and_lists(spark):
    assert one(spark, '{"fix":{"a":null,"b":[null,{"c":null,"d":1}]},"x":null}', responses.strip_nulls) == '{"fix":{"b":[null,{"d":1}]},"x":null}'
    assert one(spark, None, responses.strip_nulls) is None and one(spark, "{x", responses.strip_nulls) == "{x"
    df = spark.createDataFrame([(1, '{"modifiers":["m",{"name":"n"}]}', "[1]"), (2, "[1]", "{x"), (3, None, None), (4, " ", '[{"code":"a"},{"code":"b"}]')], "id int, contract_context string, called_functions string")
    got = sorted(map(tuple, audit.row_issues(df, "id").collect()))
    c = "contract_context"
    assert got == [(1, "called_functions.non_object_elems"), (1, f"{c}.modifiers.missing_keys"), (1, f"{c}.modifiers.mixed_types"), (1, f"{c}.modifiers.non_object_elems"), (2, "called_functions.malformed_json"), (2, f"{c}.type"), (4, f"{c}.type")]


def test_rebuild():
    src = "a\n  function f() {\n    x;\n\n    y;\n  }\nb\n"
    assert source.rebuild_contract(src, 2, 6, None, "F") == "a\nF\nb\n" and source.rebuild_contract(src, None, None, "x;\n\n    y;", "F") == "a\n  function f() {\n    F\n  }\nb\n"
    assert source.rebuild_contract(src, 9, 9, "function f() {\nx;\ny;\n}", "F\n") == "a\nF\nb\n" and source.rebuild_contract(src, None, None, "function g()", "F") is None
    assert source.rebuild_contract(None, 1, 2, "x", "F") is None


def test_functions_by_pattern(spark):
    code = "function f() { a; } function g(uint x) external view returns (uint) { if (x) { b; } } function f(uint y) private { c; }"
    got = one(spark, code, source.functions_by_pattern)
    assert [(f.name, f.visibility, f.mutability) for f in got] == [("f", "private", "nonpayable"), ("g", "external", "view")]
    ctx = one(spark, "contract C is A, B { uint x; mapping m ; modifier only() {} }", source.contract_context)
    assert (ctx.contract_name, ctx.inheritance, [(v.name, v.type) for v in ctx.state_variables], ctx.modifiers) == ("C", ["A", "B"], [("x", "uint"), ("m", "mapping")], ["only"])
    assert one(spark, "", source.contract_context).contract_name == "Unknown"
    assert one(spark, "function f() { a; ", source.headers)[0].code == ""


def test_snippet_spans_marks(spark):
    code = "\n".join("abcdefgh")
    assert one(spark, code, lambda x: source.snippet(x, F.lit(1), F.array(F.lit(3), F.lit(6), F.lit(99)))).split("\n") == ["// Line 2: b", "// Line 3 (VULNERABLE): c", "// Line 4: d", "// Line 5: e", "// Line 6 (VULNERABLE): f", "// Line 7: g"]
    assert one(spark, code, lambda x: source.snippet(x, F.lit(1), F.array(F.lit(99)))) == ""


def test_labels(spark):
    assert one(spark, "weak-prng", labels.detector_type) == "bad_randomness" and one(spark, "own", labels.detector_type) == "own"
    assert len({d for ds in labels.DETECTORS.values() for d in ds}) == sum(map(len, labels.DETECTORS.values())) == 99
    found = F.array(F.struct(F.lit("Low").alias("severity")), F.struct(F.lit("High").alias("severity")))
    assert one(spark, "x", lambda s: labels.label_severity(s, found)) == 9.0 and one(spark, "2", lambda s: labels.label_severity(s, found)) == 2.0


def test_corpus(spark):
    df = spark.createDataFrame([(i, ("curated", "wild", "solidifi", "scrawld")[i % 4], i % 8 < 4) for i in range(160)], "id long, dataset_type string, is_vulnerable boolean")
    got = corpus.corpus_split(df, "id")
    assert {(r.dataset_type, r.split): r["count"] for r in got.groupBy("dataset_type", "split").count().collect()} == {("curated", "test"): 40, ("wild", "train"): 28, ("wild", "val"): 6, ("wild", "test"): 6, ("solidifi", "train"): 28, ("solidifi", "val"): 6, ("solidifi", "test"): 6}
    assert corpus.reduction(0, 0) == 0 and corpus.reduction(4, 1) == 75
    x = spark.createDataFrame([(1, "a", 1.0, True), (2, "a", 2.0, True)], "id int, sample_id string, v double, raw boolean").withColumn("raw_data", F.when(F.col("id") == 9, "{}")).withColumn("function_name", F.lit("f"))
    assert corpus.lookup(x, "a").first().record == '{"function_name":"f"}' and corpus.lookup(x, "b").count() == 0


def test_evaluation(spark):
    rows = [("s", i, True, i != 1, 0.5, 0.9, float(i), f"c{i}") for i in range(6)] + [("t", 0, True, True, None, None, None, "x")]
    df = spark.createDataFrame(rows, "sample_id string, cand int, compiles boolean, passed boolean, orig_sim double, ir_sim double, ir_change double, code string")
    got = {r.sample_id: r for r in evaluate.evaluation_rows(df, max_orig_sim=0.99, max_change=4).collect()}
    assert (got["s"].total_generated, got["s"].correct_generated, got["s"].best_candidate_code, got["s"].passed_candidate_codes) == (6, 4, "c0", ["c0", "c2", "c3"])
    assert (got["t"].correct_generated, got["t"].best_candidate_code, got["t"].passed_candidate_codes) == (0, None, [])
    assert evaluate.evaluation_rows(df).where("sample_id = 't'").first().best_candidate_ir_sim == 0
    order = spark.createDataFrame([(1, [], 9), (2, ["f"], 1), (3, ["f"], 5)], "id int, flags array<string>, n int")
    assert [r.id for r in evaluate.review_order(order, "flags", "n").collect()] == [3, 2, 1]
    assert text.option_list(" a, ,b") == ["a", "b"] and text.option_list("None") is None and text.option_list(None) is None


def test_sources(spark, tmp_path):
    from loomcrest.sources import readers, sinks

    folder = tmp_path / "c" / "dataset"
    for label, name in (("reentrancy", "a"), ("dos", "b"), ("scripts", "x"), (".git", "y")):
        (folder / label).mkdir(parents=True)
        (folder / label / f"{name}.sol").write_text(f"contract {name} {{}}")
    notes = spark.createDataFrame([("dataset/reentrancy/a.sol", "reentrancy", [5, 50])], "path string, category string, lines array<int>")
    got = readers.annotated_files(readers.labelled_files(spark, str(tmp_path / "c")), notes).collect()
    assert sorted((r.label, r.name, [(v.category, v.lines) for v in r.vulnerabilities]) for r in got) == [("dos", "b.sol", []), ("reentrancy", "a.sol", [("reentrancy", [5, 50])])]
    with pytest.raises(FileNotFoundError):
        readers.require(spark, str(tmp_path / "none"))
    (tmp_path / "r.txt").write_text("")
    names = [r.name for r in readers.corpus_files(spark, str(folder / "dos"), str(tmp_path / "r.txt"), str(tmp_path / "r.txt"), "*.sol", limit=1).collect()]
    assert names == ["b.sol"]
    assert readers.normalize_config({"smartbugs_wild_dir": "w", "wild_sample_limit": 3, "k": 1}) == {"smartbugs_wild_dir": "w", "wild_sample_limit": 3, "k": 1, "datasets": [{"name": "smartbugs_wild", "path": "w", "type": "wild", "sample_limit": 3, "quality_filter": True}]}
    assert readers.normalize_config({"datasets": []}) == {"datasets": []}
    docs = spark.createDataFrame([("function f() { if (x) y.call(); }", 1), (None, 2)], "code string, id int").withColumn("dataset_name", F.lit("d"))
    sinks.write_index(docs, str(tmp_path / "index"))
    assert {r.id: (r.signature and r.signature[:2]) for r in sinks.read_index(spark, str(tmp_path / "index")).collect()} == {1: ["function f", "if"], 2: None}
    assert readers.raw_scan(docs, "d").count() == 2 and readers.raw_scan(docs, "e").count() == 0
    (tmp_path / "l.jsonl").write_text('{"id":"1"}\n{"id":"2"}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id string", limit=1).count() == 1


def test_joins_of_ranges(spark):
    from loomcrest.operators import joins, store

    a = spark.createDataFrame([("k", i * 7, i * 7 + 20) for i in range(30)], "k string, s1 int, e1 int")
    b = spark.createDataFrame([("k", i * 11, i * 11 + 3 * i) for i in range(30)], "k string, s2 int, e2 int")
    plain = sorted(map(tuple, joins.overlap_join(a, b, "k", ("s1", "e1"), ("s2", "e2")).collect()))
    assert plain == sorted(map(tuple, joins.overlap_join(a, b, "k", ("s1", "e1"), ("s2", "e2"), width=10).collect())) and len(plain) > 50
    has = spark.createDataFrame([(7, 1)], "function_id int, fix_version int")
    new = spark.createDataFrame([(7, 1, ["reentrancy", "dos"]), (8, 2, None)], "function_id int, seq int, vulnerabilities_fixed array<string>")
    assert sorted((r.function_id, r.fix_version, r.swc_ids) for r in store.append_fixes(has, new, "seq").collect()) == [(7, 2, ["SWC-107", "SWC-113"]), (8, 1, [])]
    fixes = spark.createDataFrame([(i, i > 1, i > 2, float(i)) for i in range(6)], "function_id int, compiles boolean, slither_passed boolean, fix_quality_score double")
    assert sorted(r.function_id for r in joins.usable_fixes(fixes, [3, 4, 1], 4).collect()) == [4] and joins.usable_fixes(fixes, limit=2).count() == 2


def test_overlap_by_token_and_by_block(spark, monkeypatch):
    from loomcrest.operators import retrieve

    q = spark.createDataFrame([(1, "a b c d"), (2, ""), (3, "z . z")], "query_id int, text string")
    d = spark.createDataFrame([(1, "A b x"), (2, "z"), (3, ""), (4, None)], "doc_id int, text string")
    rows = lambda: sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in retrieve.token_overlap(q, d).collect())
    block = rows()
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 0)
    assert block == rows() == [(1, 1, 0.57735), (3, 2, 0.707107)]
    items = spark.createDataFrame([(i, ["a", "b", str(i % 3)]) for i in range(9)], "doc_id int, items array<string>")
    got = retrieve.jaccard_search(items.withColumnRenamed("doc_id", "query_id"), items, 0.5)
    assert got.count() == 81 and got.where("score = 1").count() == 27


def test_stream(spark, tmp_path):
    """The windowed counts as a stream: late rows behind the watermark drop out."""
    from loomcrest.streaming import events

    schema = "ts timestamp, event_type string, value double"
    for k, rows in enumerate(([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a")], [("2024-01-01 05:00:00", "b")], [("2024-01-01 05:10:00", "b")], [("2024-01-01 00:02:00", "a"), ("2024-01-01 09:00:00", "c")])):
        spark.createDataFrame(rows, "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type", F.lit(1.5).alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = events.windowed_counts(stream)
    q = out.writeStream.format("memory").queryName("late_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("late_counts").collect()
    assert [(r.event_type, r.n, r.total) for r in sorted(got, key=lambda r: r.window_start)] == [("a", 2, 3.0), ("b", 2, 3.0)]
