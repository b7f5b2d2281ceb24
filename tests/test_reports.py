"""Candidate selection and report tables on small rows."""

from pyspark.sql import functions as F

from loomcrest.operators import candidates, reports


def test_candidates(spark):
    rows = [(1, "null", '{"is_vulnerable":true}', False), (2, None, '{"is_vulnerable":true}', True), (3, "null", None, True), (4, "null", "{}", False), (5, "null", "{}", True)]
    df = spark.createDataFrame(rows, "id int, llm_audit string, slither_result string, is_vulnerable boolean")
    assert sorted(r.id for r in candidates.to_annotate(df).collect()) == [1, 5]
    audits = ['{"label":"vulnerable","severity":7,"vulnerability_types":["Re-Entrancy"]}', '{"label":"safe"}', "null", None, '{"label":"vulnerable","severity":2,"vulnerability_types":["x"]}']
    fix = spark.createDataFrame(list(enumerate(audits)), "id int, llm_audit string")
    assert [r.id for r in candidates.to_fix(fix, None, least_severity=5).collect()] == [0]
    assert [r.id for r in candidates.to_fix(fix, None, types=["re entrancy"]).collect()] == [0]
    done = spark.createDataFrame([(0,), (0,)], "id int")
    assert [r.id for r in candidates.to_fix(fix, done).collect()] == [4]
    assert candidates.resolve_types(["RENT", "tx-origin", "Foo Bar"]) == ["reentrancy", "access_control", "foo_bar"]
    one = spark.range(1)
    got = one.select(candidates.sample_id(F.lit("d"), F.lit("C"), F.lit("f"), F.lit(None)).alias("a"), candidates.function_id(F.lit("fix_12")).alias("b"), candidates.function_id(F.lit("7")).alias("c"), candidates.function_id(F.lit("x")).alias("d")).first()
    assert tuple(got) == ("d_C_f_0", 12, 7, None)
    grid = spark.createDataFrame([("m", None), ("m", 1)], "model string, k int")
    assert [r.k for r in candidates.configs_left(grid, grid.where("k is null"), ["model", "k"]).collect()] == [1]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, ["x", "x", "y"]), ("b", 2, ["y"]), ("c", 3, [])], "id string, seq int, v array<string>")
    got = [(r.value, r.samples, r.labels, r.examples) for r in reports.histogram(df, F.col("v"), "id", "seq").collect()]
    assert got == [("y", 2, 2, ["a", "b"]), ("x", 1, 2, ["a"])]
    s = spark.createDataFrame([(5, 2, 0.5, 0.1), (5, 0, 0.1, 0.3)], "total_generated int, correct_generated int, bleu double, edit_sim double")
    r = reports.suite(s, (1, 5)).first()
    assert (round(r.solved_rate, 6), round(r.pass_at_1, 6), round(r.pass_at_5, 6), r.bleu_solved, r.bleu_unsolved) == (0.5, 0.2, 0.5, 0.5, 0.1)
    v = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    assert [tuple(r) for r in reports.top_versions(v, "v", 1).collect()] == [("a", 2, 66.67)]
    x = spark.createDataFrame([(i, float(i)) for i in range(4)], "id int, s double")
    assert sorted((r.end, r.id) for r in reports.extremes(x, "s", "id", 1).collect()) == [("highest", 3), ("lowest", 0)]
