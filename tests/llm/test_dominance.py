"""Dominance counts against their definition."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcrest.llm import dominance


def brute(rows):
    """(id, slot, level, weight) to {id: (n, w)}, pair by pair."""
    whole = [r for r in rows if r[1] is not None and r[2] is not None]
    out = {}
    for i, s, v, _ in rows:
        above = [r for r in whole if s is not None and v is not None and r[1] < s and r[2] > v]
        out[i] = (None, None) if s is None or v is None else (len(above), sum(r[3] or 0 for r in above))
    return out


def counted(spark, rows):
    df = spark.createDataFrame(rows, "id long, x long, y long, dominance long")  # names that clash with the operator's own
    out, name = dominance.dominance(df, F.col("x"), F.col("y"), F.col("dominance"))
    assert out.columns == ["id", "x", "y", "dominance", name]
    return [(r.id, (r[name].above_n, r[name].above_w)) for r in out.collect()]


@pytest.mark.parametrize("span", [1, 5, 40, 3000])
def test_counts_are_those_of_all_pairs(spark, span):
    rng = random.Random(span)
    rows = [(i, rng.randrange(-span, span), rng.randrange(-span, span), rng.choice((0, 1, 2, 7, None))) for i in range(400)]
    rows += [(1000 + i, 3, 3, 1) for i in range(60)]  # a hot cell
    rows += [(2000, None, 1, 1), (2001, 1, None, 1), (2002, None, None, None)]
    got = counted(spark, rows)
    assert len(got) == len(rows) and dict(got) == brute(rows)


def test_cells_below_the_hot_bound(spark, monkeypatch):
    monkeypatch.setattr(dominance, "HOT_CELLS", 2)  # all but one cell go by the merge join
    rows = [(i, i % 37, (i * i) % 53, 1) for i in range(500)] + [(1000 + i, 5, 9, 2) for i in range(600)]
    assert dict(counted(spark, rows)) == brute(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, 9, 2), (1, 0, 9, 2), (2, 1, 3, 1), (2, 1, 3, 1), (3, 1, 9, 1), (4, 0, 3, 1)]
    assert sorted(counted(spark, rows)) == [(1, (0, 0)), (1, (0, 0)), (2, (2, 4)), (2, (2, 4)), (3, (0, 0)), (4, (0, 0))]
    assert counted(spark, []) == [] and counted(spark, [(1, None, 2, 1)]) == [(1, (None, None))]


def test_tiles_over_many_batches():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    x, y = rng.integers(0, 16, 4000), rng.integers(0, 16 * 40, 4000)
    cells = sorted({(0, b >> 4, 0, a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)})
    cols = [*zip(*cells, strict=True), [1] * len(cells), [2] * len(cells)]
    names = ["tx", "ty", "kind", "x", "y", "n", "w"]
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)
    got = [r for step in (1, 7, 100, 10_000) for r in [pa.Table.from_batches(list(dominance._tiles(whole.slice(k, step) for k in range(0, whole.num_rows, step)))).to_pandas()]]
    for g in got:
        want = [sum(c[1] == r.y >> 4 and c[3] < r.x and c[4] > r.y for c in cells) for r in g.itertuples()]
        assert list(g.row_n) == list(g.full_n) == want and list(g.full_w) == [2 * n for n in want]


def test_slots_hold_in_any_zone(spark):
    rows = [(datetime.datetime(2024, 1, 1, 23, 59, 59),), (datetime.datetime(2024, 1, 2),), (datetime.datetime(1969, 12, 31, 23, 0, 0, 5),), (None,)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame(rows, "t timestamp_ntz")
            assert [r[0] for r in df.select(dominance.day_slot(df, "t")).collect()] == [19723, 19724, -1, None]
            df = spark.sql("select timestamp'2024-01-01 23:59:59 UTC' t")
            assert df.select(dominance.day_slot(df, "t")).first()[0] == 19723
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_levels_and_copies(spark):
    import zlib

    df = spark.createDataFrame([(1, 12.34), (2, float("nan")), (3, float("inf")), (4, None), (5, -0.004), (None, 1e18)], "i long, t double")
    got = df.select("i", dominance.money_level(F.col("t")).alias("v"), dominance.copies(F.col("i")).alias("c")).collect()
    assert [r.v for r in got] == [1, None, None, None, 0, None]
    assert [r.c for r in got] == [1 + zlib.crc32(str(r.i).encode()) % 3 if r.i else 1 for r in got]
