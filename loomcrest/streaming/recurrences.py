"""A run log's recurrences while it is written: Lagrange multiplier and moving baseline of each key, row by row.

Rows of a key count in the order of a number. A row may come late: it waits in the key's state until a row that is more
than `late` ahead has been seen, and what has waited long enough is then counted in order; a row that comes after its
place was passed is given back with `too_late` and null values. A row without an order closes its key: all that waits is
counted. State is a key's waiting rows and two numbers, kept by the state store, so a stopped query goes on from its
checkpoint with the rows of one that never stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key long, at long, multiplier double, baseline double, too_late boolean"


class _Recurrences(StatefulProcessor):
    def __init__(self, late: int, rate: float, target: float, decay: float):
        self.late, self.rate, self.target, self.decay = late, rate, target, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "multiplier double, baseline double, seen long, passed long")
        self.waiting = handle.getListState("waiting", "at long, cost double, reward double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of Spark's interface
        lowest = -(1 << 62)
        multiplier, baseline, seen, passed = self.sums.get() if self.sums.exists() else (0.0, 0.0, lowest, lowest)
        waiting, closed, out = [tuple(r) for r in self.waiting.get()], False, []
        for batch in rows:
            for at, cost, reward in zip(batch["at"], batch["cost"], batch["reward"], strict=True):
                if pd.isna(at):
                    closed = True
                elif int(at) <= passed:
                    out.append((key[0], int(at), None, None, True))
                else:
                    waiting.append((int(at), float(cost), float(reward)))
                    seen = max(seen, int(at))
        waiting.sort()
        ready = len(waiting) if closed else sum(at < seen - self.late for at, _, _ in waiting)
        for at, cost, reward in waiting[:ready]:
            multiplier = max(0.0, multiplier + self.rate * (cost - self.target))
            baseline = self.decay * baseline + (1 - self.decay) * reward
            out.append((key[0], at, multiplier, baseline, False))
            passed = at
        self.sums.update((multiplier, baseline, seen, passed))
        if waiting[ready:]:
            self.waiting.put(waiting[ready:])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "multiplier", "baseline", "too_late"])

    def close(self) -> None:
        pass


def recurrences(log: DataFrame, key: str, at: str, cost: str, reward: str, late: int, rate: float = 0.05, target: float = 0.5, decay: float = 0.9) -> DataFrame:
    """(key, at, multiplier, baseline, too_late) of a streamed log. Null costs and rewards are 0; rows of a null key are left out. The session's state store must be PROVIDER."""
    rows = log.select(F.col(key).cast("long").alias("key"), F.col(at).cast("long").alias("at"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((cost, "cost"), (reward, "reward")))).where("key is not null")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Recurrences(late, rate, target, decay), outputStructType=_OUT, outputMode="Append", timeMode="None")


def settled(spark, source: str, schema: str, make, target: str, checkpoint: str) -> None:
    """Runs a stream over the JSON files below source until all are read, appending make(stream) as Parquet; called again it goes on from the checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(schema).json(source)
        make(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
