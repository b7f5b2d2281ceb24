"""Rounds of calls to an external tool over many records: attempts with feedback, committed as they go, resumed after a kill.

A provider is a function (text, attempt, previous, feedback) -> dict: the fields of a schema, and `accepted` and `feedback`;
`previous` is its last result's fields (as a dict) and `feedback` what was said of it, both None at first. Equal texts are
called once. A round calls only records that no earlier attempt had accepted, in chunks of about `every` records, each
written as Parquet below `path` when it ends. A run that finds the path goes on with the first chunk that is not whole.
Which records are open, and which chunk each is in, follows from the rounds before alone, so a run with a kill between
gives the rows of one without.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "_k string, attempt int, accepted boolean, feedback string, error string, result string"


def _whole(df: DataFrame, path: str) -> bool:
    sc = df.sparkSession.sparkContext
    mark = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark)


def _state(df: DataFrame, path: str, rounds: int, chunks: dict[int, int]) -> DataFrame:
    """All attempts of the first so many rounds."""
    paths = [f"{path}/round={r}/chunk={c}" for r in range(1, rounds + 1) for c in range(chunks[r])]
    return df.sparkSession.read.schema(_STATE).parquet(*paths) if paths else df.sparkSession.createDataFrame([], _STATE)


def run_rounds(df: DataFrame, text: str, provider: Callable[[str, int, dict | None, str | None], dict], schema: str, path: str, attempts: int = 3, every: int = 100_000, feedback: bool = True, parallel: int | None = None) -> DataFrame:
    """df with the schema's fields, `accepted`, `attempts`, `used_feedback`, `error` and `candidates` (all attempts' results as JSON, in order).

    The fields are those of the accepted attempt, else of the last one that gave a result; null where none did. A call that
    raises is an attempt without a result, its message is the `error`, and the next one gets the feedback of before. A null
    text is the empty one; repeated rows share a record. With feedback=False each attempt is a first one.
    """
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    records = df.select(key.alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).dropDuplicates(["_k"])
    names = [c.strip().split()[0] for c in schema.split(",")]

    def call(attempt: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for k, t, last, said in zip(b["_k"], b["_t"], b["_last"], b["_said"], strict=True):
                    last, said = (json.loads(last) if isinstance(last, str) else None), (said if isinstance(said, str) else None)
                    try:
                        r = provider(t, attempt, last, said)
                        made = json.dumps({n: r.get(n) for n in names}, ensure_ascii=False)
                        rows.append((k, attempt, bool(r.get("accepted")), r.get("feedback"), None, made))
                    except Exception as e:  # an attempt that failed; the next one may not
                        rows.append((k, attempt, False, said, f"{type(e).__name__}: {e}", None))
                yield pd.DataFrame(rows, columns=["_k", "attempt", "accepted", "feedback", "error", "result"])

        return run

    chunks: dict[int, int] = {}
    for r in range(1, attempts + 1):
        state = _state(df, path, r - 1, chunks)
        results = state.where("result is not null").groupBy("_k").agg(F.max_by("result", "attempt").alias("_last"), F.max_by("feedback", "attempt").alias("_said"))
        done = state.where("accepted").select("_k").distinct()
        left = records.join(done, "_k", "left_anti").join(results, "_k", "left") if r > 1 else records.withColumns({"_last": F.lit(None).cast("string"), "_said": F.lit(None).cast("string")})
        if not feedback:
            left = left.withColumns({"_last": F.lit(None).cast("string"), "_said": F.lit(None).cast("string")})
        n = left.count()
        chunks[r] = -(-n // every)
        for c in range(chunks[r]):
            part = f"{path}/round={r}/chunk={c}"
            if not _whole(df, part):
                own = left.where(F.pmod(F.xxhash64("_k"), F.lit(chunks[r])) == c)
                own = own.repartition(parallel, "_k") if parallel else own
                own.mapInPandas(call(r), _STATE).write.mode("overwrite").parquet(part)
    state = _state(df, path, attempts, chunks)
    order = F.struct("accepted", F.col("result").isNotNull(), "attempt")  # an accepted attempt is the last; then the last with a result
    best = state.groupBy("_k").agg(
        F.max_by(F.struct("accepted", "result", "attempt"), order).alias("b"),
        F.max("attempt").alias("attempts"),
        F.max_by("error", "attempt").alias("error"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("result").isNotNull(), F.struct("attempt", "result")))), lambda x: x["result"]).alias("candidates"),
    )
    fields = F.from_json("b.result", schema)
    out = best.select("_k", *(fields[n].alias(n) for n in names), F.col("b.accepted").alias("accepted"), "attempts", (F.lit(feedback) & (F.col("b.attempt") > 1)).alias("used_feedback"), "error", "candidates")
    return df.withColumn("_k", key).join(out, "_k", "left").drop("_k")


def round_statistics(done: DataFrame, most: int) -> DataFrame:
    """One row: records, accepted, failed, accepted after a retry, and how many were accepted at each attempt."""
    ok = F.col("accepted")
    return done.agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col("attempts") > 1)).alias("retried"), *(F.count_if(ok & (F.col("attempts") == k)).alias(f"at_{k}") for k in range(1, most + 1)))
