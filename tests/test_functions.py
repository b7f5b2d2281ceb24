"""Column functions on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from loomcrest.functions import similarity, source, taxonomy, text
from loomcrest.operators import providers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (source.pragma_version, "pragma solidity >=0.5.0 <0.7.0;", "0.5.0"),
        (source.pragma_full, "pragma solidity >=0.5.0 <0.7.0;", "0.5.0"),
        (source.pragma_full, "pragma solidity >0.4.21;", "0.4.22"),
        (source.pragma_version, "contract C {}", "0.4.25"),
        (source.pragma_full, "contract C {}", None),
        (source.minimum_version, "pragma solidity 0.4.11; contract C { constructor() public {} function f() public view {} }", "0.4.22"),
        (source.visibility, "function f() external payable returns (uint)", "external"),
        (source.mutability, "function f() external payable returns (uint)", "payable"),
        (source.location, "x.sol:12-15", "Lines 12-15"),
        (source.location, "x.sol#9", "Line 9"),
        (source.location, "no line", "Function body"),
        (text.clean_text, "a\tb  \r\n\r\n\r\n\r\nc", "a    b\n\nc"),
        (text.type_line, "- Type: A, B\n- Type: C", ["A", "B"]),
        (text.tokens, "foo_1 = x + 12;", ["foo_1", "=", "x", "+", "12", ";"]),
        (text.token_estimate, "", 0),
        (text.token_estimate, "abc", 1),
        (text.token_estimate, "x" * 40, 10),
        (text.unwrap_fence, "so:\n```sol\ncode\n```\n", "code"),
        (text.strip_comments, "a /* x\ny */ b // z\nc", "a  b \nc"),
        (taxonomy.swc_of, "reentrancy-eth", ["SWC-107"]),
        (taxonomy.swc_of, "7", ["SWC-007"]),
        (taxonomy.swc_of, "foo", []),
    ],
)
def test_column(spark, f, value, want):
    assert one(spark, value, f) == want


def test_taxonomy_sets(spark):
    ids = lambda x: taxonomy.swc_ids(F.array(x))
    assert one(spark, "Unchecked DoS call", ids) == ["SWC-104", "SWC-113"]
    assert one(spark, "Integer overflow in timestamp calc", ids) == ["SWC-101", "SWC-116"]
    assert one(spark, "Unchecked DoS call", lambda x: taxonomy.swc_ids(F.array(x), ["104"])) == ["SWC-113"]
    two = lambda x: taxonomy.buckets(F.split(x, ","))
    assert one(spark, "reentrancy,missing access control", two) == ["REENTRANCY", "ACCESS_CONTROL"]
    assert one(spark, "foo", two) == ["foo"]
    sizes = {"REENTRANCY": 9, "ACCESS_CONTROL": 2}
    assert one(spark, "REENTRANCY,ACCESS_CONTROL", lambda x: taxonomy.primary_bucket(F.split(x, ","), sizes)) == "ACCESS_CONTROL"
    assert one(spark, "x", lambda x: taxonomy.primary_bucket(F.split(x, ","))) == "OTHER"


@pytest.mark.parametrize(("word", "kind", "want"), [("High", "reentrancy", 10.0), ("Low", "gas_optimization", 1.0), ("other", "x", 5.0)])
def test_severity(spark, word, kind, want):
    assert one(spark, word, lambda x: taxonomy.severity_score(x, F.lit(kind))) == want


def test_spans():
    code = 'function f() { s = "}"; x(); }'
    assert source.block_of(code, "f", naive=True) == 'function f() { s = "}'
    assert source.block_of(code, "f") == code
    assert source.block_of("function foobar() { }", "foo", naive=True) == "function foobar() { }"
    assert source.block_of("function foobar() { }", "foo") is None
    assert [s[0] for s in source.spans("function a(); function b() { /* } */ }")] == ["a", "b"]


def test_snippet(spark):
    got = one(spark, "a;\nb;\nc;", lambda x: source.snippet(x, F.lit(10), F.array(F.lit(11))))
    assert got == "// Line 10: a;\n// Line 11 (VULNERABLE): b;\n// Line 12: c;"


def test_metrics(spark):
    rows = spark.createDataFrame([(5, 2), (10, 3), (4, 2), (5, 5)], "n int, c int").select(*(F.round(similarity.pass_at_k(F.col("n"), F.col("c"), k), 6).alias(f"k{k}") for k in (1, 2, 5))).collect()
    assert (rows[0].k1, rows[0].k2, rows[1].k5, rows[2].k5, rows[3].k5) == (0.4, 0.7, 0.916667, 0.0, 1.0)
    assert round(similarity.edit_ratio("a b c d".split(), "a b d".split()), 6) == 0.857143
    assert similarity.text_ratio("  a\n\n b", "a\nb") == 1 and similarity.text_ratio("", "") == 1 and similarity.text_ratio("", "a") == 0
    assert similarity.bleu("a b c d e".split(), "a b c d e".split()) == 1.0 and similarity.bleu(["a"], []) == 0.0
    costs = spark.createDataFrame([(False, 0, False), (True, 2, False), (True, 0, False), (True, 0, True)], "c boolean, n int, s boolean").select(similarity.cost(F.col("c"), F.col("n"), F.col("s")).alias("x")).collect()
    assert [r.x for r in costs] == [5, 2, 0, 1]
    assert spark.range(1).select(similarity.correct(F.lit(True), F.lit(True), F.lit(0.999), 0.995, F.lit(0.1), 0.5).alias("x")).first().x is False


def test_tool_report(spark):
    j = '{"issues":[{"title":"T","swc-id":"107","severity":"High","description":"d","locations":[{"lineno":7}]},{"title":"L","severity":"Low"},{"title":"N"}]}'
    assert one(spark, j, lambda x: providers.tool_issues(x, ["high", "medium"])) == ["107 T (High) @L7: d", "N"]


def test_vulnerability_info(spark):
    got = one(spark, "- Type: A; B/C\n- Severity: 7.5", text.vulnerability_info)
    assert (got.types, got.severity) == (["A", "B", "C"], 7.5)


@pytest.mark.parametrize(("value", "want"), [("re-entrancy", None), ("Reentrancy attack", "REENTRANCY"), ("auth bypass", "ACCESS_CONTROL"), ("unsafe math", "ARITHMETIC"), ("external call to x", "UNCHECKED_CALL"), ("tx_origin", "TX_ORIGIN"), ("front-running", "FRONT_RUNNING"), ("nothing", None)])
def test_canonical(spark, value, want):
    assert one(spark, value, taxonomy.canonical_type) == want


def test_code_building(spark):
    assert source.fit_header("function f() public { a; }", "b;") == "function f() public {\nb;\n}"
    assert source.fit_header("function f() { a; }", "text function f() { b; } more") == "function f() { b; }"
    assert source.replace_function("x function f() { a; } y", "f", "F") == "x F y" and source.replace_function("x", "f", "F") is None
    assert one(spark, "0.5.3", lambda v: source.closest_version(v, F.array(F.lit("0.4.26"), F.lit("0.5.7"), F.lit("0.6.0")))) == "0.5.7"
    assert one(spark, "a;\n\nb;", lambda x: source.simple_contract(x, F.lit("C"), F.lit("0.5.0"))).endswith("contract C {\n    a;\n\n    b;\n}")
    assert one(spark, "delegatecall", source.gate_features)[1] == 1.0 and len(one(spark, "", source.gate_features)) == 10
    assert one(spark, "dos attack", taxonomy.severity_estimate) == 6 and one(spark, "zzz", taxonomy.severity_estimate) == 5
