"""Dominance counts: for each row, the rows of smaller slot and strictly larger level, and what they weigh.

Rows collapse to distinct (slot, level) cells. Cells lie in tiles of SIDE x SIDE; a tile's cells get exclusive
two-dimensional cumulative sums in numpy, many tiles at once. What lies outside a tile comes in as carries: a carry row
(a value a slot: rows of the same strip of slots, higher strips of levels), a carry column (a value a level: the same
strip of levels, earlier strips of slots) and one corner (both). Carries are themselves cumulative sums over tiles of
coarser cells, whose slots, levels or both are divided by SIDE, and so on up to one tile, so that no task ever holds more
than a bounded number of cells of a tile, whatever slots and levels there are: every pair of cells differs first, from
the top, in one digit of the slot and one of the level, and is counted in that tile alone. Work is cells x digits of the
slot x digits of the level at most, and about 1.2 x cells where neighbours are there. Counts join back to the rows by
cell; cells with a thousandth of all rows or more (a thousand cells at most) are broadcast, so that none fills a task.

Defined results: a null slot or level stands above nothing and its own counts are null; null weights weigh nothing;
repeated rows are rows each; equal slots or equal levels are not above each other; an empty table gives no rows; other
columns pass through whatever their names; slots and levels are longs of any sign, whose span fits in a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

BITS = 4
SIDE = 1 << BITS
#: Cells with this share of all rows are joined by broadcast: at most so many cells.
HOT_CELLS = 1000
#: Tiles that are held as dense arrays at once.
TILES_HELD = 2048
CELL, ROW, COLUMN, CORNER = range(4)
SUMS = ("row_n", "row_w", "col_n", "col_w", "full_n", "full_w")
_IN = "tx long, ty long, kind int, x long, y long, n long, w long"
_OUT = "x long, y long, " + ", ".join(f"{c} long" for c in SUMS)


def _above(v: np.ndarray) -> np.ndarray:
    """For each place of (tiles, SIDE, SIDE) the sum over smaller first and larger second index."""
    v = np.cumsum(v, 1) - v
    return np.cumsum(v[:, :, ::-1], 2)[:, :, ::-1] - v


def tile_sums(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums of the cells among rows sorted by tile (columns of _IN); whole tiles only."""
    new = np.concatenate(([True], (t["tx"][1:] != t["tx"][:-1]) | (t["ty"][1:] != t["ty"][:-1])))
    tile = np.cumsum(new) - 1
    x, y, kind = t["x"] & (SIDE - 1), t["y"] & (SIDE - 1), t["kind"]
    cell, row, column, corner = (np.flatnonzero(kind == k) for k in range(4))
    at, i, j = tile[cell], x[cell], y[cell]
    out = {"x": t["x"][cell], "y": t["y"][cell]}
    for c in ("n", "w"):
        v, many = t[c], int(tile[-1]) + 1
        dense = np.zeros((many, SIDE, SIDE), np.int64)
        dense[at, i, j] = v[cell]
        rows, columns, corners = np.zeros((many, SIDE), np.int64), np.zeros((many, SIDE), np.int64), np.zeros(many, np.int64)
        rows[tile[row], x[row]] = v[row]
        columns[tile[column], y[column]] = v[column]
        corners[tile[corner]] = v[corner]
        own = _above(dense)[at, i, j]
        out[f"row_{c}"], out[f"col_{c}"] = own + rows[at, i], own + columns[at, j]
        out[f"full_{c}"] = own + rows[at, i] + columns[at, j] + corners[at]
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _IN.split(", ")]
    held: list[pa.RecordBatch] = []

    def done(rows: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
        """Sums of the whole tiles, and the rows of the tile that may go on."""
        whole = pa.Table.from_batches(rows).combine_chunks()
        t = {c: whole.column(c).to_numpy() for c in names}
        ends = np.append(np.flatnonzero((t["tx"][1:] != t["tx"][:-1]) | (t["ty"][1:] != t["ty"][:-1])) + 1, whole.num_rows)
        if not last:
            ends = ends[:-1]
        out, start = [], 0
        while len(ends):
            end = int(ends[: TILES_HELD][-1])
            got = tile_sums({c: v[start:end] for c, v in t.items()})
            out.append(pa.RecordBatch.from_arrays([pa.array(got[c]) for c in ("x", "y", *SUMS)], ["x", "y", *SUMS]))
            start, ends = end, ends[TILES_HELD:]
        return out, whole.slice(start).to_batches()

    for batch in batches:
        if batch.num_rows:
            out, held = done([*held, batch], False)
            yield from out
    if held:
        yield from done(held, True)[0]


def _up(c: str) -> Column:
    return F.shiftright(c, BITS)


def _kind(df: DataFrame, tx: Column, ty: Column, kind: int, n: str, w: str) -> DataFrame:
    return df.select(tx.alias("tx"), ty.alias("ty"), F.lit(kind).alias("kind"), "x", "y", F.col(n).alias("n"), F.col(w).alias("w"))


def _digits(span: int) -> int:
    """Digits of base SIDE that numbers of 0 to span have."""
    return -(-span.bit_length() // BITS)


def cell_sums(cells: DataFrame) -> DataFrame:
    """(x, y, above_n, above_w) of distinct cells (x, y, n, w), which are read more than once. Only the least and largest x and y come to the driver."""
    ends = cells.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy")).first()
    a_most, b_most = (_digits(ends[f"max_{c}"] - ends[f"min_{c}"]) if ends[f"min_{c}"] is not None else 0 for c in "xy")
    if not a_most or not b_most:
        return cells.select("x", "y", F.lit(0).cast("long").alias("above_n"), F.lit(0).cast("long").alias("above_w"))
    grid = {(0, 0): cells.withColumns({c: F.col(c) - ends[f"min_{c}"] for c in "xy"})}
    for a in range(a_most):
        for b in range(b_most):
            if (a, b) != (0, 0):
                below, x, y = (grid[a, b - 1], F.col("x"), _up("y")) if b else (grid[a - 1, b], _up("x"), F.col("y"))
                grid[a, b] = C.materialize(below.groupBy(x.alias("x"), y.alias("y")).agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    sums: dict[tuple[int, int], DataFrame] = {}
    for a in reversed(range(a_most)):
        for b in reversed(range(b_most)):
            parts = [_kind(grid[a, b], _up("x"), _up("y"), CELL, "n", "w")]
            if b + 1 < b_most:
                parts.append(_kind(sums[a, b + 1], _up("x"), F.col("y"), ROW, "row_n", "row_w"))
            if a + 1 < a_most:
                parts.append(_kind(sums[a + 1, b], F.col("x"), _up("y"), COLUMN, "col_n", "col_w"))
            if a + 1 < a_most and b + 1 < b_most:
                parts.append(_kind(sums[a + 1, b + 1], F.col("x"), F.col("y"), CORNER, "full_n", "full_w"))
            rows = reduce(DataFrame.unionAll, parts).repartition("tx", "ty").sortWithinPartitions("tx", "ty")
            sums[a, b] = C.materialize(rows.mapInArrow(_tiles, _OUT))
            for gone in [grid.pop((a, b)) if (a, b) != (0, 0) else None, sums.get((a + 1, b + 1))]:
                C.forget(gone)
    return sums[0, 0].select(*((F.col(c) + ends[f"min_{c}"]).alias(c) for c in "xy"), F.col("full_n").alias("above_n"), F.col("full_w").alias("above_w"))


def dominance(df: DataFrame, slot: Column, level: Column, weight: Column, name: str | None = None) -> tuple[DataFrame, str]:
    """df with a struct (slot, level, above_n, above_w) appended, and its name: the rows above each row, and their summed weight."""
    name = name or C.fresh(df, "dominance")
    rows = df.select(F.struct("*").alias("row"), slot.cast("long").alias("x"), level.cast("long").alias("y"))
    keyed = df.select(slot.cast("long").alias("x"), level.cast("long").alias("y"), F.coalesce(weight.cast("long"), F.lit(0)).alias("w"))
    cells = C.materialize(keyed.where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w")))
    above = cell_sums(cells)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot_cell = F.col("n") * HOT_CELLS >= F.lit(total)
    hot = F.broadcast(cells.where(hot_cell).select("x", "y"))
    hot_sums = F.broadcast(above.join(hot, ["x", "y"]))
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    nothing = [F.lit(None).cast("long").alias(c) for c in ("above_n", "above_w")]
    parts = [
        rows.where(~whole).select("*", *nothing),
        rows.where(whole).join(hot_sums, ["x", "y"]),
        rows.where(whole).join(hot, ["x", "y"], "left_anti").join(above.hint("shuffle_merge"), ["x", "y"]),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("row.*", F.struct(F.col("x").alias("slot"), F.col("y").alias("level"), "above_n", "above_w").alias(name)), name


def day_slot(df: DataFrame, at: str) -> Column:
    """Days since 1970 of a timestamp with or without a zone, whatever the session's zone: one without is taken as UTC."""
    if dict(df.dtypes)[at] == "timestamp_ntz":
        return F.unix_date(F.col(at).cast("date")).cast("long")
    return F.floor(F.unix_micros(F.col(at)) / F.lit(86_400_000_000))


def money_level(total: Column) -> Column:
    """floor(floor(100 * total + 0.5) / 1000) in doubles; null for null, and for what is no number or no long."""
    t = total.cast("double")
    return F.when(F.abs(t) < 9e16, F.floor(F.floor(100 * t + 0.5).cast("double") / 1000))


def copies(sale_id: Column) -> Column:
    """1 + (crc32 of the id in decimal) mod 3; a null id stands for one row."""
    return 1 + F.coalesce(F.crc32(sale_id.cast("string").cast("binary")), F.lit(0)) % 3


def op13_dominance(spark, sf_dir: str) -> DataFrame:
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet").select("sale_id", "sold_at", "total")
    out, d = dominance(sales, day_slot(sales, "sold_at"), money_level(F.col("total")), copies(F.col("sale_id")))
    return out.select("sale_id", f"{d}.slot", f"{d}.level", F.col(f"{d}.above_n").alias("n_sales"), F.col(f"{d}.above_w").alias("n_rows"))
