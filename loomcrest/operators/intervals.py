"""Interval joins that hold for long ranges and for hot keys.

Ranges stand in a tree of buckets: level 0 has buckets of a width taken from the data, each level above has buckets of
twice the width. A range's own level is the lowest at which it touches two buckets at most. Two ranges meet at the higher
of their own levels, in the bucket where their overlap begins, so each pair is made once and without a later distinct.
A row is sent to its own level and to those higher levels where the other side has ranges of its own: two buckets each.
Cells (key, level, bucket) that hold a large share of a side are split, and the other side's rows of such a cell copied.

Rows with a null key, start or end, or with an end before the start, overlap nothing. Repeated rows are rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell with one in so many rows of a side is split into at most PARTS parts.
SHARES, PARTS = 512, 16
_CELL = ["_key", "_level", "_bucket"]


def base_width(sides: list[tuple[DataFrame, str, str]]) -> int:
    """A power of two near the median length of the ranges that are no points; 1 if there are none."""
    lengths = None
    for df, start, end in sides:
        one = df.select((F.col(end) - F.col(start)).cast("double").alias("n")).where("n > 0")
        lengths = one if lengths is None else lengths.unionAll(one)
    middle = lengths.agg(F.percentile_approx("n", 0.5, 1000).alias("m")).first().m
    return 1 << max(0, int(middle or 0).bit_length())


def _level(start: Column, end: Column, width: int) -> Column:
    """The lowest level whose buckets are as wide as the range is long: it then touches two at most."""
    steps = F.ceil(F.log2(F.greatest((end - start + 1).cast("double"), F.lit(1.0)) / width))
    return F.greatest(F.lit(0), steps).cast("int")


def _bucket(at: Column, level: Column, width: int) -> Column:
    return F.floor(at.cast("double") / (F.pow(F.lit(2.0), level) * width)).cast("long")


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("_own").distinct().collect())  # 64 at most


def _side(df: DataFrame, start: str, end: str, width: int, others: list[int]) -> DataFrame:
    """Each row in the buckets of its own level and of the higher levels that the other side has."""
    s, e, own = F.col(start), F.col(end), F.col("_own")
    up = F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > own)
    rows = df.withColumn("_level", F.explode(F.concat(F.array(own), up)))
    both = F.array_distinct(F.array(_bucket(s, F.col("_level"), width), _bucket(e, F.col("_level"), width)))
    return rows.withColumn("_bucket", F.explode(both))


def interval_join(a: DataFrame, b: DataFrame, key: str, a_range: tuple[str, str], b_range: tuple[str, str], width: int | None = None) -> DataFrame:
    """Pairs of rows of one key whose ranges (whole numbers, ends included) overlap, with clip_start and clip_end. Names other than the key must differ between the sides."""
    (s1, e1), (s2, e2) = a_range, b_range
    a, b = (df.where(F.col(key).isNotNull() & (F.col(s) <= F.col(e))) for df, (s, e) in ((a, a_range), (b, b_range)))
    width = width or base_width([(a, s1, e1), (b, s2, e2)])
    a, b = (df.withColumn("_own", _level(F.col(s), F.col(e), width)) for df, (s, e) in ((a, a_range), (b, b_range)))
    in_a, in_b = _levels(a), _levels(b)
    b = b.withColumnsRenamed({key: "_key_b", "_own": "_own_b"})
    left = _side(a, s1, e1, width, in_b).withColumn("_key", F.col(key))
    right = _side(b.withColumnRenamed("_own_b", "_own"), s2, e2, width, in_a).withColumnsRenamed({"_own": "_own_b", "_key_b": "_key"})
    # parts of a cell: by what each side has in it
    hot = {}
    for side, df in (("a", left), ("b", right)):
        n = df.groupBy(*_CELL).agg(F.count("*").alias("n"))
        total = n.agg(F.sum("n").alias("_total"))
        many = n.crossJoin(F.broadcast(total)).where(F.col("n") * SHARES >= F.col("_total"))  # SHARES rows at most
        hot[side] = many.select(*_CELL, F.least(F.lit(PARTS), F.ceil(F.col("n") * SHARES / F.col("_total"))).cast("int").alias(f"_parts_{side}"))
    parts = F.broadcast(hot["a"].join(hot["b"], _CELL, "full").select(*_CELL, *(F.coalesce(f"_parts_{x}", F.lit(1)).alias(f"_parts_{x}") for x in "ab")))

    def salted(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(parts, _CELL, "left")
        mine, theirs = (F.coalesce(f"_parts_{x}", F.lit(1)) for x in (own, other))
        put = F.pmod(F.xxhash64(*(c for c in df.columns if not c.startswith("_parts"))), mine).cast("int")
        return df.withColumns({f"_salt_{own}": put, f"_salt_{other}": F.explode(F.sequence(F.lit(0), theirs - 1))}).drop("_parts_a", "_parts_b")

    pairs = salted(left, "a", "b").join(salted(right, "b", "a"), [*_CELL, "_salt_a", "_salt_b"])
    clip = F.greatest(s1, s2)
    pairs = pairs.where((F.col("_level") == F.greatest("_own", "_own_b")) & (F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1)) & (F.col("_bucket") == _bucket(clip, F.col("_level"), width)))
    return pairs.withColumns({"clip_start": clip, "clip_end": F.least(e1, e2)}).drop(*_CELL, "_salt_a", "_salt_b", "_own", "_own_b")
