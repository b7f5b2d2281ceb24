"""The versioned store and resumable rounds."""

import json

import pytest
from pyspark.sql import functions as F

from loomcrest.operators import rounds, versioned


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_merges_once_a_batch(spark, tmp_path):
    first = spark.createDataFrame([(i, f"a{i}", 0, 1) for i in range(50)] + [(3, "later", 0, 2)], "k long, v string, created int, seq int")
    store = versioned.Store.create(spark, f"file://{tmp_path}/s", "k", first.drop("seq").schema, 8, ("created",))
    assert store.read().count() == 0 and store.upsert(first, "seq", "one") == 1
    second = spark.createDataFrame([(3, "x", 9, 1), (99, "y", 9, 1)], "k long, v string, created int, seq int")
    before = store.version()["places"]
    assert store.upsert(second, "seq", "two") == 2
    once = rows(store.read())
    assert store.upsert(second, "seq", "two") == 2 and rows(store.read()) == once and store.versions() == [0, 1, 2]
    assert dict((r[0], r[1:]) for r in once)[3] == ("x", 0) and (99, "y", 9) in once and len(once) == 51
    assert ("later",) == store.read(1).where("k = 3").select("v").first()
    after = store.version()["places"]
    assert 0 < sum(before.get(b) != w for b, w in after.items()) <= 2  # the other buckets' files are the same


def test_a_failed_batch_leaves_the_old_version(spark, tmp_path):
    store = versioned.Store.create(spark, f"file://{tmp_path}/s", "k", spark.createDataFrame([], "k string, v int").schema, 4)
    store.upsert(spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, seq int"), "seq", "one")
    good = rows(store.read())
    bad = spark.createDataFrame([("a", 5, 1), ("c", 0, 1)], "k string, v int, seq int").withColumn("v", F.expr("if(v = 0, raise_error('broken'), v)").cast("int"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(bad, "seq", "two")
    assert rows(store.read()) == good and versioned.Store(spark, store.path).versions() == [0, 1]
    with pytest.raises(ValueError, match="null in the key"):
        store.upsert(spark.createDataFrame([(None, 1, 1)], "k string, v int, seq int"), "seq", "three")
    with pytest.raises(versioned.Conflict):
        store._commit(1, store.version())
    assert not [p for p in (tmp_path / "s" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert store.upsert(spark.createDataFrame([("a", 5, 1)], "k string, v int, seq int"), "seq", "two") == 2 and ("a", 5) in rows(store.read())
    with pytest.raises(FileNotFoundError):
        versioned.Store(spark, f"file://{tmp_path}/none").read()


def test_columns_come_later(spark, tmp_path):
    store = versioned.Store.create(spark, f"file://{tmp_path}/s", "k", spark.createDataFrame([], "k int, v int").schema, 4)
    store.upsert(spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "k int, v int, seq int"), "seq", "one")
    store.upsert(spark.createDataFrame([(2, 7, "n", 1)], "k int, v int, note string, seq int"), "seq", "two")
    assert rows(store.read()) == [(1, 1, None), (2, 7, "n")] and store.read(1).columns == ["k", "v"]
    assert store.rewrite(lambda df: df.withColumn("note", F.coalesce("note", F.lit("old"))), "fill") == 3
    assert store.rewrite(lambda df: df.withColumn("note", F.lit("never")), "fill") == 3
    assert store.rewrite(lambda df: df, "nothing") == 3
    assert rows(store.read()) == [(1, 1, "old"), (2, 7, "n")]
    assert store.rewrite(lambda df: df.withColumn("more", F.col("v") + 1), "grow") == 4 and rows(store.read()) == [(1, 1, "old", 2), (2, 7, "n", 8)]


def flaky(calls):
    """Accepts a text at the attempt that its length says, raises at the second one of texts with 'z', and notes its calls."""

    def provider(text, attempt, previous, feedback):
        with open(calls, "a") as f:
            f.write(json.dumps([text, attempt, previous, feedback]) + "\n")
        if "z" in text and attempt == 2:
            raise RuntimeError("away")
        return {"answer": f"{text}{attempt}", "accepted": attempt >= len(text), "feedback": f"said {attempt}"}

    return provider


TEXTS = [(1, "a"), (2, "bb"), (3, "ccc"), (4, "dddddd"), (5, "zz"), (6, "zzz"), (7, None), (8, ""), (9, "a")]


def read_calls(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []  # a chunk may have no record


def test_rounds(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "i int, t string")
    calls = tmp_path / "calls"
    out = rounds.run_rounds(df, "t", flaky(str(calls)), "answer string", f"file://{tmp_path}/state", every=2)
    got = {r.i: (r.answer, r.accepted, r.attempts, r.used_feedback, r.error, [json.loads(c)["answer"] for c in r.candidates]) for r in out.collect()}
    assert got[1] == got[9] == ("a1", True, 1, False, None, ["a1"]) and got[7] == got[8] == ("1", True, 1, False, None, ["1"])
    assert got[3] == ("ccc3", True, 3, True, None, ["ccc1", "ccc2", "ccc3"]) and got[4] == ("dddddd3", False, 3, True, None, ["dddddd1", "dddddd2", "dddddd3"])
    assert got[5] == ("zz3", True, 3, True, None, ["zz1", "zz3"])
    made = read_calls(calls)
    assert len(made) == 7 + 5 + 4 and [c for c in made if c[0] == "zz"] == [["zz", 1, None, None], ["zz", 2, {"answer": "zz1"}, "said 1"], ["zz", 3, {"answer": "zz1"}, "said 1"]]
    one = rounds.round_statistics(out, 3).first()
    assert tuple(one) == (9, 8, 1, 4, 4, 1, 3)


def test_rounds_go_on_after_a_kill(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "i int, t string")
    whole = rows(rounds.run_rounds(df, "t", flaky(str(tmp_path / "c0")), "answer string", f"file://{tmp_path}/s0", every=2))

    class Killed(BaseException):
        pass

    for stop in (1, 3, 5):
        state, calls, real, seen = f"file://{tmp_path}/s{stop}", tmp_path / f"c{stop}", rounds._whole, []

        def dying(d, p, stop=stop, real=real, seen=seen):
            seen.append(p)
            if len(seen) > stop:
                raise Killed
            return real(d, p)

        rounds._whole = dying
        try:
            with pytest.raises(Killed):
                rounds.run_rounds(df, "t", flaky(str(calls)), "answer string", state, every=2)
        finally:
            rounds._whole = real
        before = len(read_calls(calls))
        assert rows(rounds.run_rounds(df, "t", flaky(str(calls)), "answer string", state, every=2)) == whole
        made = [tuple(c[:2]) for c in read_calls(calls)]
        assert (stop == 1 or before) and before < len(made) == len(set(made))  # nothing is called twice


def test_rounds_of_nothing_and_without_feedback(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "i int, t string")
    assert rounds.run_rounds(df.limit(0), "t", flaky(str(tmp_path / "c")), "answer string", f"file://{tmp_path}/e").count() == 0
    calls = tmp_path / "d"
    rounds.run_rounds(df, "t", flaky(str(calls)), "answer string", f"file://{tmp_path}/f", feedback=False).collect()
    assert all(c[2] is None and c[3] is None for c in read_calls(calls))
