"""Sanitized sources, strict lines, and small functions of readers, sinks and records."""

import pytest
from pyspark.sql import functions as F

from loomcrest.functions import sanitize, similarity, taxonomy, text
from loomcrest.operators import corpus, evaluate, providers, retrieve, store
from loomcrest.sources import readers, sinks


def test_stubs_stand_behind_the_pragma():
    assert sanitize.sanitized("pragma solidity ^0.5.0;\nx.transfer(a, 1);") == "pragma solidity ^0.5.0;\n\n" + sanitize.TOKEN_STUB + "x.transfer(a, 1);"
    assert sanitize.sanitized("x.approve(a);").startswith("interface IERC20 {") and sanitize.sanitized("interface IERC20 { }\nx.approve(a);") == "interface IERC20 { }\nx.approve(a);"
    made = sanitize.sanitized("contract C {\n    function f() public { a.add(1); }\n}")
    assert made.startswith("library SafeMath {") and "contract C {\n    using SafeMath for uint256;\n    function f" in made
    assert "using" not in sanitize.sanitized("contract C is A {\n a.add(1);\n}").split("library")[0]
    assert sanitize.sanitized("contract C {\n using SafeMath for uint256;\n a.div(1);\n}").count("using SafeMath") == 1


def test_types_of_declarations():
    one = lambda line: sanitize.sanitized(line)
    assert one("  MyToken public t;") == "IERC20 public t;" and one("Thing token;") == "IERC20 token;" and one("Owner public o;") == "address public o;"
    assert one("  Thing t;") == "  Thing t;" and one("Deal memory token;") == "Deal memory token;" and one("thing public t;") == "thing public t;"
    assert one("  Vault v = new Vault(1);") == "  Vault v;" and one("Vault public v = new Vault();") == "address public v;" and one("x = y;") == "x = y;"
    assert one(" \n") == " \n" and one(None) is None


def test_structures_of_undeclared_types():
    source = "contract C {\n function f() {\n  Deal memory d;\n  Deal memory e;\n  Known storage k;\n  Empty calldata m;\n  d.b = d.a;\n  e.z = 1;\n }\n struct Known { uint a; }\n}"
    out = sanitize.sanitized(source)
    assert out.startswith("contract C {\n    struct Deal {\n    uint256 a;\n    uint256 b;\n    }\n\n    struct Empty {\n    uint256 _dummy;\n    }\n function f")
    assert out.count("struct Known") == 1 and sanitize.sanitized(source.replace("contract C {", "contract C is D {")).count("struct") == 1


def test_strict_lines_name_their_place(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\n')
    (path / "b.jsonl").write_text('{"id":"3"}\n{"id":\n{"id":"4"}\nno\n')
    at = f"file://{path}"
    assert [(f.rsplit("/", 1)[1], n) for f, n in readers.malformed_lines(spark, at, "id string")] == [("b.jsonl", 2), ("b.jsonl", 4)]
    with pytest.raises(ValueError, match=r"b\.jsonl:2, .*b\.jsonl:4"):
        readers.json_lines(spark, at, "id string", strict=True)
    assert readers.json_lines(spark, f"{at}/a.jsonl", "id string", strict=True).count() == 2
    assert readers.json_lines(spark, f"{at}/a.jsonl", "id string", limit=1).count() == 1
    big = tmp_path / "big.jsonl"
    big.write_text("".join(f'{{"id":"{i:09d}"}}\n' if i != 4321 else "broken\n" for i in range(9000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [n for _, n in readers.malformed_lines(spark, f"file://{big}", "id string")] == [4322]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sampled_files(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"{i}.sol").write_text("x")
    few = lambda: sorted(r.name for r in readers.source_files(spark, f"file://{tmp_path}", sample=4).collect())
    assert few() == few() and len(few()) == 4 and readers.source_files(spark, f"file://{tmp_path}").count() == 9


def test_union_of_sources(spark):
    a, b = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([(2, "x")], "i int, t string")
    got = sorted(map(tuple, readers.union_sources({"one": ("wild", a), "two": ("curated", b)}).select("i", "t", "dataset_name", "dataset_type").collect()))
    assert got == [(1, None, "one", "wild"), (2, "x", "two", "curated")]


def test_paired_files(spark):
    s = spark.createDataFrame([("buggy_1.sol", "a"), ("buggy_2.sol", "b"), ("plain.sol", "c")], "name string, text string")
    logs = spark.createDataFrame([("1", 3), ("1", 9), ("7", 1)], "name string, start int")
    assert sorted((r.name, r.text, r.start) for r in readers.paired_files(s, logs).collect()) == [("1", "a", 3), ("1", "a", 9)]


def test_sink_helpers(spark):
    df = spark.createDataFrame([(1, "Re-entrancy  x", "train", ""), (2, "a/b", "val", "body"), (3, None, "val", None)], "i int, k string, split string, s string")
    assert [r[0] for r in df.orderBy("i").select(sinks.record_name("fix", F.col("k"), F.col("i"))).collect()][:2] == ["fix_re_entrancy_x_1", "fix_a_b_2"]
    assert {(r.split, r.n) for r in sinks.split_summary(df).collect()} == {("train", 1), ("val", 2)} and sinks.preview(df, 2).count() == 2
    pages = [r.page for r in sinks.report(df.orderBy("i"), F.lit("# T"), {"Part": F.col("s")}).collect()]
    assert "body" in pages[1] and "Part" in pages[1] and "Part" not in pages[0] and "Part" not in pages[2]


def test_record_helpers(spark):
    df = spark.createDataFrame([(["reentrancy", "Reentrancy attack", None, "zzz"], ["A"], None), (None, None, ["dos"]), ([], [], [])], "t array<string>, p array<string>, a array<string>")
    types = [r[0] for r in df.select(taxonomy.canonical_types(F.col("t"))).collect()]
    assert types[1] is None and len(types[0]) == len(set(types[0])) and types[2] == []
    kinds = [r[0] for r in df.select(evaluate.result_types(F.col("p"), F.col("a"))).collect()]
    assert [k.vulnerability_types for k in kinds] == [["A"], ["dos"], []]
    assert [r[0] for r in df.select(retrieve.jaccard(F.col("p"), F.array(F.lit("A"), F.lit("B")))).collect()][0] == 0.5
    tools = spark.createDataFrame([({"a": (True,), "b": (None,)},), ({"a": (False,)},), ({},)], "t map<string,struct<passed:boolean>>")
    assert [r[0] for r in tools.select(providers.all_passed(F.col("t"))).collect()] == [True, False, True]
    assert store.add_columns(df, t="string", new="int").columns == ["t", "p", "a", "new"]
    split = spark.createDataFrame([("train", True), ("train", None), ("test", False)], "split string, is_vulnerable boolean")
    assert {tuple(r) for r in corpus.split_counts(split).collect()} == {("train", 2, 1, 1), ("test", 1, 0, 1)}
    code = spark.createDataFrame([("a; // <yes> here\n// TODO x\n  // <YES>\nb; // keep",)], "c string")
    assert code.select(text.strip_marked_comments(F.col("c"), ("<yes>",))).first()[0] == "a;\n// TODO x\nb; // keep"
    ops = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], ["a"]), (None, ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in ops.select(similarity.operation_similarity(F.col("x"), F.col("y"))).collect()] == [0.5, None, None]
