"""Answer forms, run records, splits, prompts, table functions and streamed recurrences."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomcrest.functions import responses, source, text
from loomcrest.operators import curate, evaluate, providers, reports, retrieve
from loomcrest.sources import readers
from loomcrest.streaming import recurrences


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").select("x").collect()]


def test_answers_for_vulnerable_functions(spark):
    said = ['{"severity":8,"suggested_fix_for_others":"f"}', '{"suggested_fix_for_others":["a","b"],"severity":true,"vulnerability_types":"one","analysis":["x",1]}', '{"severity":false,"vulnerability_types":["A"],"confidence":"0.25"}', '{"severity":"high"}', "[1]", "nothing", None, '{"is_safe":true,"severity":null}']
    got = column(spark, said, responses.vulnerable_annotation)
    assert [(r.label, r.severity, r.suggested_fix, r.vulnerability_types) for r in got[:3]] == [("vulnerable", 8.0, "f", []), ("vulnerable", 1.0, "a\nb", ["one"]), ("vulnerable", 0.0, "", ["A"])]
    assert (got[0].confidence, got[2].confidence, got[1].analysis) == (0.5, 0.25, "x\n1") and got[3:] == [None] * 5


def test_answers_for_safe_functions(spark):
    said = ['{"safety_reasoning":["a","b"],"best_practices":"p","severity":9,"vulnerability_types":["A"]}', 'so ```json\n{"confidence": 1}\n```', '{"confidence":"x"}', "none"]
    got = column(spark, said, responses.safe_annotation)
    assert (got[0].label, got[0].reasoning, got[0].best_practices, got[0].severity, got[0].vulnerability_types) == ("safe", "a\nb", "p", 0.0, [])
    assert (got[1].confidence, got[1].reasoning) == (1.0, "") and got[2:] == [None, None]


def test_small_texts(spark):
    assert column(spark, ["", None, "e: a\nb\nc", "a\nb", "e: x "], lambda c: text.error_summary(c, 2, "e: ")) == ["No error details available"] * 2 + ["a\nb\n... (showing first 2 lines of 3 total)", "a\nb", "x"]
    assert column(spark, ["abc", "abcd", None], lambda c: text.shorten(c, 3)) == ["abc", "abc...", None]
    assert column(spark, ["x\n```solidity\nsome words\nuint a;\nb\n```\ny", "plain\nwords", "if (a) {\n```\n}", None, "  "], source.bare_body) == ["uint a;\nb", "", "if (a) {\n}", "", ""]
    got = column(spark, ["No issues found", "", None, "a\n SWC-1 b\nIssue 2", "\n".join(f"l{i}" for i in range(20))], providers.tool_text_issues)
    assert [r.passed for r in got] == [True, True, True, False, False] and got[3].issues == ["SWC-1 b", "Issue 2"] and got[4].issues[0].startswith("l0\nl1") and len(got[4].issues) == 1
    assert column(spark, ["slitherConstructorX", "f"], lambda c: source.kept_function(c, c == "f")) == [False, False]


def run_file(folder, name, meta, metrics, details="[]"):
    (folder / name).write_text(f'{{"meta": {json.dumps(meta)}, "metrics": {json.dumps(metrics)}, "details": {details}}}')


def test_run_records_of_files(spark, tmp_path):
    code = "function f(uint a) public returns (uint b)"
    detail = json.dumps([{"reference_code": code, "passed_candidate_codes": [code, "x", 7, None]}, {"reference_code": code, "passed_candidate_codes": []}, 5, {"reference_code": 3, "passed_candidate_codes": ["y"]}, {"reference_code": "a b c d e", "passed_candidate_codes": ["q w r t z"]}])
    base = {"model": "m", "n_samples": 5, "temperature": 0.5, "seed": 1}
    run_file(tmp_path, "a.json", base, {"solved_rate": 0.5}, detail)
    run_file(tmp_path, "b.json", base | {"seed": 2, "top_p": "None"}, {"solved_rate": 1, "highest_bleu": 0.125, "extra": 2})
    run_file(tmp_path, "c.json", base | {"top_p": "0.9", "rag_mode": "Always"}, {"solved_rate": 0}, '"none"')
    run_file(tmp_path, "d.json", base | {"seed": "x"}, {"solved_rate": 0})
    run_file(tmp_path, "e.json", [1], {"solved_rate": 0})
    run_file(tmp_path, "summary.json", base, {"solved_rate": 0})
    (tmp_path / "f.json").write_text("{broken")
    records = evaluate.run_records(readers.evaluation_files(spark, f"file://{tmp_path}/*.json")).cache()
    got = {r.path[-6:]: r for r in records.collect()}
    assert sorted(got) == ["a.json", "b.json", "c.json"]
    low = got["a.json"].metrics["highest_bleu"]
    assert 0.5 <= low < 0.75 and got["a.json"].metrics["highest_edit_sim"] == 0.5  # the last sample's are near 0
    assert got["b.json"].metrics == {"solved_rate": 1.0, "highest_bleu": 0.125, "highest_edit_sim": 0.0, "extra": 2.0} and got["c.json"].metrics["highest_bleu"] == 0.0
    s = {(r.config_key, r.metric): (r.num_runs, r.mean, r.std) for r in evaluate.sweep_summary(evaluate.last_runs(records)).collect()}
    none, some = "model=m|n=5|temp=0.5|top_p=none|rag=off", "model=m|n=5|temp=0.5|top_p=0.9|rag=always"
    assert s[none, "solved_rate"] == (2, 0.75, pytest.approx(math.sqrt(0.125))) and s[none, "extra"] == (2, 1.0, pytest.approx(math.sqrt(2))) and s[some, "extra"] == (1, 0.0, 0.0)
    assert evaluate.metric_columns(["solved_rate", "z", "n_A", "a"], ["solved_rate", "bleu"], ["A"], ["n"])[2:] == [f"{m}_{x}" for m in ("solved_rate", "n_A", "a", "z") for x in ("mean", "std")]
    name = records.where("config.seed = 2").select(evaluate.run_name(F.col("config"), F.lit("s"))).first()[0]
    assert name == "eval_m_n5_t0.5_pnone_ragoff_seed2_s"


def test_last_runs(spark):
    rows = [("a", 1, ("m", 1)), ("b", 3, ("m", 1)), ("c", 3, ("m", 1)), ("d", 2, ("n", None))]
    df = spark.createDataFrame(rows, "path string, modified int, config struct<model:string,seed:int>")
    assert sorted(r.path for r in evaluate.last_runs(df).collect()) == ["c", "d"]


def test_baseline_rows(spark):
    rows = [(1, "c", True, True, None, 0.5), (2, "c", True, True, False, None), (3, " ", True, True, True, 0.5), (4, None, None, None, None, None), (5, "c", None, True, True, 0.1)]
    got = {r.sample_id: r for r in evaluate.baseline_rows(spark.createDataFrame(rows, "sample_id int, code string, compiles boolean, passed boolean, other_passed boolean, ir_sim double").withColumn("ir_change", F.lit(0.2))).collect()}
    assert [got[i].correct_generated for i in range(1, 6)] == [1, 0, 0, 0, 0] and got[1].passed_candidate_codes == ["c"] and got[1].passed_candidate_ir_sims == [0.5]
    assert (got[2].best_candidate_code, got[2].best_candidate_ir_sim, got[3].best_candidate_ir_sim, got[3].total_generated) == (None, 0.0, 0.0, 1)


def test_bucket_metrics(spark):
    rows = [("A", 5, 5), ("A", 5, 0), ("B", 1, 1), ("zz", 5, 1), (None, 5, None)]
    got = {r.bucket: r for r in reports.bucket_metrics(spark.createDataFrame(rows, "b string, total_generated int, correct_generated int"), "b", ["A", "B", "C"], (1,)).collect()}
    assert (got["A"].n, got["A"].solved_rate, got["A"].pass_at_1) == (2, 0.5, 0.5) and (got["C"].n, got["C"].pass_at_1) == (0, 0.0) and (got["OTHER"].n, got["OTHER"].solved_rate) == (2, 0.5)


def test_era_split(spark):
    w = spark.createDataFrame([(i, f"0.{i % 9}.1") for i in range(90)] + [(500, "bad"), (501, None)], "i int, v string")
    c = spark.createDataFrame([(1000, "0.4.1"), (1001, None)], "i int, v string")
    got = {(r.i, r.split, r.era) for r in curate.era_split(w, c, "i", "v", 4).collect()}
    assert sum(e == "modern" for _, _, e in got) == 4 and {s for i, s, _ in got if i >= 1000} == {"test"} and not {500, 501} & {i for i, _, _ in got}
    assert {s for _, s, e in got if e in ("early", "late")} - {"test"} == {"train"} and {s for i, s, e in got if e == "transition"} == {"val"}


def test_augment(spark):
    p = spark.createDataFrame([(1, "ask", ["A"], 3.0, "q"), (2, "ask", ["Z"], None, ""), (3, "ask", None, None, None), (4, "ask", ["A"], 1.0, "q")], "query_id int, prompt string, types array<string>, severity double, code string")
    hits = spark.createDataFrame([(q, d, d) for q in (1, 2, 3) for d in (1, 2, 3)], "query_id int, doc_id int, rank int")
    docs = spark.createDataFrame([(1, "a; // x", "b;", "B"), (2, "```\nc;\n```", "d;", " a "), (3, "e;", None, None)], "doc_id int, code string, fixed_code string, kind string")
    got = {r.query_id: r for r in retrieve.augment(p, hits, docs, 2).collect()}
    assert [got[i].demo_ids for i in (1, 2, 3, 4)] == [[2], [1, 2], [1, 2], []] and (got[4].prompt, got[4].used, got[4].added_tokens) == ("ask", False, 0)
    assert got[1].prompt.startswith("<DEMO>\n### Vulnerable ( a ):\n```solidity\nc;\n```\n### Fixed:\n```solidity\nd;\n```\n</DEMO>\n\n<QUERY>") and got[1].prompt.endswith("ask") and "// x" not in got[2].prompt
    small = {r.query_id: r for r in retrieve.augment(p, hits, docs, 3, budget=6 + got[1].added_tokens).collect()}
    assert small[2].n_demos == 1 and small[2].added_tokens <= 6 + got[1].added_tokens


def test_function_blocks(spark):
    source.register(spark)
    code = "function a() { x('}'); } function b() { y; } function a() { x('}'); } function a(int i) { } function c(); function d() {"
    spark.createDataFrame([(1, code), (2, None), (3, "")], "i int, c string").createOrReplaceTempView("blocks_of")
    got = spark.sql("select i, place, name, code from blocks_of, lateral function_blocks(c) order by i, place").collect()
    assert [(r.i, r.place, r.name) for r in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "a")] and got[0].code == "function a() { x('}"  # braces count in strings
    assert got[2].code == "function a(int i) { }"


def brute_recurrence(rows):
    out, state = {}, {}
    for k, at, cost, reward in sorted(rows, key=lambda r: r[1]):
        lam, base = state.get(k, (0.0, 0.0))
        state[k] = max(0.0, lam + 0.05 * (cost - 0.5)), 0.9 * base + 0.1 * reward
        out[k, at] = tuple(round(x, 9) for x in state[k])
    return out


def test_recurrences_over_restarts(spark, tmp_path):
    rows = [(i % 3, i, float(i % 4), float(i % 7)) for i in range(120)]
    late = [r for r in rows if r[1] in (31, 44, 58)]
    base = f"file://{tmp_path}"
    schema = "k long, at long, cost double, reward double"

    def feed(part):
        spark.createDataFrame(part, schema).write.mode("append").json(f"{base}/in")
        recurrences.settled(spark, f"{base}/in", schema, lambda s: recurrences.recurrences(s, "k", "at", "cost", "reward", 30), f"{base}/out", f"{base}/state")
        return {(r.key, r.at): (r.multiplier and round(r.multiplier, 9), r.baseline and round(r.baseline, 9), r.too_late) for r in spark.read.parquet(f"{base}/out").collect()}

    one = feed([r for r in rows if r[1] < 60 and r not in late] + [(None, 5, 1.0, 1.0)])
    want = brute_recurrence(rows)
    assert 20 < len(one) < 40 and all(v[2] is False and (v[0], v[1]) == tuple(x or x for x in want[k]) for k, v in one.items())
    feed([r for r in rows if r[1] >= 60] + late)
    done = feed([(k, None, 0.0, 0.0) for k in range(3)] + [(0, 0, 9.0, 9.0)])
    assert done.pop((0, 0)) in (one[0, 0], (None, None, True))
    assert {k: (v[0], v[1]) for k, v in done.items()} == {k: v for k, v in want.items() if k != (0, 0)}


def test_records_of_an_analyzer(spark):
    from loomcrest.operators import contexts

    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    fs = "contract string, seq int, name string, signature string, code string, visibility string, mutability string, special boolean, nodes int, external_calls int, written int, read int"
    functions = df([("A", 0, "A", None, "x", "public", None, True, 1, 0, 0, 0), ("A", 1, "f", "f(int)", "while (1) { emit E; }", "external", "payable", False, 3, 1, 0, 2), ("A", 2, "g", None, None, None, None, None, None, None, None, None), ("A", 3, "slitherConstructorVariables", None, "", None, None, False, 1, 0, 0, 0), ("B", 0, "h", "h()", "require(tx.origin); delegatecall", None, "pure", False, 1, 0, 1, 0)], fs)
    calls = df([("A", "g", "A", "f", 0), ("A", "f", "A", "f", 1)], "contract string, caller string, callee_contract string, callee string, seq int")
    variables = df([("A", 2, "b", "int", "public", "int b;"), ("A", 1, "a", "uint", "private", None)], "contract string, seq int, name string, type string, visibility string, code string")
    events = df([("A", 0, "E", None), ("A", 1, "Other", "event Other();")], "contract string, seq int, name string, code string")
    c = contexts.contract_contexts(df([("A", ["Base"]), ("B", None)], "contract string, bases array<string>"), variables, functions, events=events)
    got = {r.contract: r.contract_context for r in c.collect()}
    assert [v.code for v in got["A"].state_variables] == ["uint private a;", "int b;"] and [e.code for e in got["A"].events] == ["event E(...);", "event Other();"] and got["A"].num_functions == 4
    assert (got["B"].inheritance, got["B"].state_variables, got["B"].modifiers, got["B"].num_functions) == ([], [], [], 1)
    found = df([("A", "f", "dos", "High"), ("A", "f", "dos", "Low"), ("A", "f", "abc", "Low")], "contract string, name string, type string, severity string")
    truth = df([("A", 1, "f", 9, 12, False, ["late"]), ("A", 0, "f", 3, 5, True, ["dos"]), ("B", 0, "h", 1, 2, None, None)], "contract string, seq int, name string, start int, end int, vulnerable boolean, categories array<string>")
    r = {x.name: x for x in contexts.function_records(functions, calls, c, found, truth).collect()}
    assert sorted(r) == ["f", "g", "h"]
    f, g, h = r["f"], r["g"], r["h"]
    assert (f.start_line, f.end_line, f.label.vulnerability_types, f.slither_result.vulnerability_types, f.slither_result.vulnerability_count) == (3, 5, ["dos"], ["abc", "dos"], 2)
    assert [x.name for x in f.caller_functions] == ["g"] and f.called_functions is None and [x.name for x in g.called_functions] == ["f"]
    assert [e.name for e in f.contract_context.events] == ["E"] and [e.name for e in g.contract_context.events] == ["E"]  # by what it calls
    a = f.ast_features
    assert (a.has_loops, a.has_if_statements, a.complexity, a.has_external_calls, a.has_state_changes, a.reads_state_vars, a.is_payable, a.visibility) == (True, True, 3, True, False, True, True, "external")
    assert (g.code, g.signature, g.start_line, g.label, g.ast_features.complexity, g.ast_features.visibility, g.slither_result.is_vulnerable) == ("function g() {}", "g", 1, None, 0, "unknown", False)
    assert (h.ast_features.has_require, h.ast_features.uses_tx_origin, h.ast_features.uses_delegatecall, h.ast_features.is_pure, h.label.is_vulnerable, h.label.vulnerability_types) == (True, True, True, True, False, [])


def test_verification(spark):
    from loomcrest.operators import providers

    kind = "c struct<passed:boolean,error:string>, a struct<passed:boolean,issues:array<string>>, b struct<passed:boolean,issues:array<string>,error:string>"
    rows = [((True, None), (True, []), (True, [], None)), ((False, "bad"), (False, ["x"]), (False, ["y"], None)), ((True, None), (False, ["x", "z"]), (True, [], None)), ((True, None), (True, []), (False, ["p", "q"], "tool_error: gone")), ((True, None), (False, ["x"]), (False, ["p"], None)), ((True, None), None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
    for unsure, want in ((True, [True, False, False, True, False, True, False]), (False, [True, False, False, False, False, True, False])):
        got = [r.v for r in df.orderBy("i").select(providers.verification(F.col("c"), F.col("a"), F.col("b"), unsure).alias("v")).collect()]
        assert [v.acceptable for v in got] == want
    assert [v.error for v in got] == [None, "does not compile: bad", "first tool: x, z", "second tool: p; q", "second tool: p", None, "does not compile: "]
    assert got[1].remaining_issues == [] and got[2].remaining_issues == ["x", "z"] and got[1].second_passed
    tools = spark.createDataFrame([({"a": (False, ["x"]), "b": (None, None), "c": (False, None)},), ({},)], "t map<string,struct<passed:boolean,issues:array<string>>>")
    r = [x.r for x in tools.select(providers.rolled_up(F.col("t")).alias("r")).collect()]
    assert not r[0].tools_passed and sorted((x.tool, x.issues) for x in r[0].remaining) == [("a", ["x"]), ("c", [])] and r[1].tools_passed and r[1].remaining == []


def test_repair_corpus(spark):
    show = "**Function:** pay\n**Source Code:**\ncontract C { function payAll() { a; } function pay(uint x) { if (x) { b; } } }\nPlease provide the complete fixed version now"
    rows = [(1, "i", show, "```solidity\nfunction other() { } function pay(uint x) { c; }\n```"), (2, "i", show, "function other() { d; } end"), (3, "i", "- Type: A\nno code", "text"), (4, "i", show, "  "), (5, None, None, "x"), (6, "i", show.replace("**Function:** pay", "**Function:** none"), "function broken( {")]
    got = {r.id: r for r in readers.repair_corpus(spark.createDataFrame(rows, "id int, instruction string, input string, output string")).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6]
    assert got[1].code == "function payAll() { a; }" and got[1].fixed_code == "function pay(uint x) { c; }"  # the first name that begins so, as the rule says
    assert got[2].fixed_code == "function other() { d; }" and (got[3].code, got[3].fixed_code, got[3].vulnerability_type) == ("- Type: A\nno code", "text", "A")
    assert (got[5].code, got[5].vulnerability_type) == ("", "Unknown") and got[6].code.startswith("**Function:** none") and got[6].fixed_code == "function broken( {"
    assert [r.id for r in readers.repair_corpus(spark.createDataFrame(rows, "id int, instruction string, input string, output string"), 2).orderBy("id").collect()] == [1, 2]


def test_fix_pairs_and_statistics(spark):
    from loomcrest.operators import joins

    f = spark.createDataFrame([(1, "s1", "a", "wild", "c", "f", True), (2, "s2", "b", "wild", "c", "g", None), (3, "s3", None, "wild", "c", "h", False)], "id int, sample_id string, dataset_name string, dataset_type string, contract_name string, function_name string, is_vulnerable boolean")
    x = spark.createDataFrame([(10, 1, True, True), (11, 1, True, False), (12, 2, None, True), (13, 9, True, True)], "id int, function_id int, compiles boolean, slither_passed boolean").withColumns({c: F.lit("t") for c in ("original_code", "fixed_code", "fix_analysis", "vulnerabilities_fixed", "original_severity", "fix_version", "model_name")})
    assert [r.fix_id for r in joins.fix_pairs(f, x).collect()] == [10] and sorted(r.fix_id for r in joins.fix_pairs(f, x, False).collect()) == [10, 11, 12]
    assert [r.fix_id for r in joins.fix_pairs(f, x, False, ["b"]).collect()] == [12] and len(joins.fix_pairs(f, x).columns) == 16
    got = {(r.dataset_name, r.is_total): r for r in reports.store_statistics(f, x).collect()}
    assert (got[None, True].functions, got[None, True].fixes, got[None, True].successful, got["a", False].success_rate, got[None, False].functions, got[None, False].fixes) == (3, 3, 1, 0.5, 1, 0)
    b = spark.createDataFrame([(["A", "A", "B"],), ([],), (None,)], "b array<string>")
    assert {tuple(r) for r in reports.bucket_sizes(b, "b").collect()} == {("A", 1), ("B", 1), ("OTHER", 2)}


def test_equal_and_disjoint_texts_need_no_matching(monkeypatch):
    from loomcrest.functions import similarity

    frequent = ["a", "b"] * 150  # no element begins a run
    want = similarity.ratio(frequent, frequent)
    assert similarity.edit_ratio(frequent, list(frequent)) == want
    assert [similarity.ratio(x, y) for x, y in (("abc", "abc"), ("abc", "xyz"))] == [1.0, 0.0]
    monkeypatch.setattr(similarity, "ratio", None)
    assert similarity.edit_ratio(list("abc"), list("abc")) == 1.0 and similarity.edit_ratio(list("abc"), list("xyz")) == 0.0
    monkeypatch.setattr(similarity, "Counter", None)
    assert similarity.bleu(list("abcd"), list("abcd")) == 1.0 and similarity.bleu(list("abcd"), list("wxyz")) == 0.0
