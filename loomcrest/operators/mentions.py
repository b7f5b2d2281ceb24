"""Who mentions whose name inside a group: one automaton a group over all its names, one scan a text.

Names and texts of a group meet in sorted streams, names first, so a task holds the names of one group (and of each name
the few mentions that are asked for), never its texts. Groups with a large share of the rows are dealt to several tasks,
which all get the group's names. Work grows with the texts' length, not with texts x names.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shares import copied, dealt, hot_keys

#: A group with one in so many rows is dealt to PARTS tasks.
SHARES, PARTS = 256, 32


def _keep(found: dict[str, list[str]], key: str, value: str, most: int) -> None:
    """Keeps the `most` smallest different values of a key."""
    own = found.setdefault(key, [])
    if value in own or (len(own) == most and value > own[-1]):
        return
    insort(own, value)
    del own[most:]


class _Names:
    """The names of a group as an automaton; the empty name stands in every text."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.empty = "" in names
        self.automaton = ahocorasick.Automaton()
        for n in names:
            if n:
                self.automaton.add_word(n, n)
        if len(self.automaton):
            self.automaton.make_automaton()

    def said(self, text: str) -> set[str]:
        out = {n for _, n in self.automaton.iter(text)} if len(self.automaton) else set()
        return out | {""} if self.empty else out


def mention_graph(df: DataFrame, group: str, name: str, text: str, most: int = 3) -> DataFrame:
    """(group, name, callees, callers): other names of the group that stand in the name's texts, and names whose texts hold it, each the first `most` in order.

    Equal rows count once; a null name or text mentions nothing and is not mentioned; rows of a null group keep empty lists.
    """
    kind = df.schema[group].dataType
    rows = df.select(F.col(group).alias("g"), F.col(name).alias("n"), F.col(text).alias("t")).where("g is not null and n is not null").distinct()
    hot = hot_keys(rows, ["g"], SHARES)
    texts = dealt(rows.where("t is not null"), hot, ["g"], PARTS, F.struct("n", "t")).select("g", "_part", F.lit(1).alias("k"), "n", "t")
    names = copied(rows.select("g", "n").distinct(), hot, ["g"], PARTS).select("g", "_part", F.lit(0).alias("k"), "n", F.lit(None).cast("string").alias("t"))
    both = names.unionByName(texts).repartition("g", "_part").sortWithinPartitions("g", "_part", "k", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, index = None, [], None
        found: dict[str, dict[str, list[str]]] = {"callee": {}, "caller": {}}

        def flush() -> Iterator[pa.RecordBatch]:
            out = [(at[0], side, n, o) for side, by in found.items() for n, os in by.items() for o in os]
            for k in range(0, len(out), 10_000):
                cols = list(zip(*out[k : k + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], to), *(pa.array(c, pa.string()) for c in cols[1:])], ["g", "side", "n", "o"])

        for b in batches:
            to = b.schema.field(0).type
            for g, part, k, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, part) != at:
                    yield from flush()
                    at, known, index = (g, part), [], None
                    found = {"callee": {}, "caller": {}}
                if not k:
                    known.append(n)
                    continue
                index = index or _Names(known)
                for o in index.said(t):
                    if o != n:
                        _keep(found["callee"], n, o, most)
                        _keep(found["caller"], o, n, most)
        if at is not None:
            yield from flush()

    schema = T.StructType([T.StructField("g", kind), *(T.StructField(c, T.StringType()) for c in ("side", "n", "o"))])
    edges = both.mapInArrow(run, schema).distinct()
    rank = F.row_number().over(Window.partitionBy("g", "side", "n").orderBy("o"))
    few = edges.withColumn("_rank", rank).where(F.col("_rank") <= most)
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("o"))))
    by = few.groupBy(F.col("g").alias(group), F.col("n").alias(name)).agg(side("callee").alias("callees"), side("caller").alias("callers"))
    empty = F.array().cast("array<string>")
    nodes = df.select(group, name).distinct().join(by, [group, name], "left")
    return nodes.select(group, name, F.coalesce("callees", empty).alias("callees"), F.coalesce("callers", empty).alias("callers"))
