"""A table at rest that batches merge into: versions, copy-on-write of touched buckets, one atomic swap a batch.

Below a store's path lie `data/<write>/_bucket=<n>` (Parquet) and `versions/<number>.json`. A version names, for every
bucket that has rows, the write that holds it; it also has the schema, the key, and the batches applied so far. A batch
reads and rewrites just the buckets its keys fall into, then puts the next version's file in place by a rename that fails
if the file exists: of two writers one is refused and may try again. Until the rename readers see the old version, also
after a crash, and what a failed batch wrote is never read. A batch whose name was applied before changes nothing, so a
batch may be replayed. Columns that a batch brings anew are added to the schema; older files give nulls for them.

A version lists buckets, not rows; choose `buckets` so that one fits a task. Rows with a null key are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import upsert


class Conflict(RuntimeError):
    """Another writer has put this version in place."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext
        self._jvm = jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(sc._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64, keep: tuple[str, ...] = ()) -> Store:
        """A new, empty store; `keep` columns stay as they were when a row is replaced."""
        store = cls(spark, path)
        store._commit(0, {"key": key, "keep": list(keep), "buckets": buckets, "schema": json.loads(schema.json()), "places": {}, "batches": []})
        return store

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> dict:
        """What a version's file says; of the last one without a number."""
        number = max(self.versions(), default=None) if number is None else number
        if number is None:
            raise FileNotFoundError(f"no store at {self.path}")
        stream = self._fs.open(self._path(f"{self.path}/versions/{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": number}

    def _commit(self, number: int, content: dict) -> None:
        """Puts a version in place, or raises Conflict."""
        draft = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        final = self._path(f"{self.path}/versions/{number:012d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} exists") from None
            raise

    def _rows(self, at: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(at["schema"])
        places = [f"{self.path}/data/{w}/_bucket={b}" for b, w in at["places"].items() if buckets is None or int(b) in buckets]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last without a number."""
        return self._rows(self.version(number))

    def _bucket(self, at: dict):
        return F.pmod(F.xxhash64(F.col(at["key"]).cast("string")), F.lit(at["buckets"])).cast("int")

    def _apply(self, at: dict, changed: DataFrame, touched: list[int], schema: T.StructType, batch: str) -> int:
        write = uuid.uuid4().hex
        changed.withColumn("_bucket", self._bucket(at)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{write}")
        filled = {str(r[0]) for r in self.spark.read.parquet(f"{self.path}/data/{write}").select("_bucket").distinct().collect()} if touched else set()  # a row a bucket
        places = {b: w for b, w in at["places"].items() if int(b) not in touched} | {b: write for b in filled}
        kept = {k: at[k] for k in ("key", "keep", "buckets")}
        self._commit(at["number"] + 1, kept | {"schema": json.loads(schema.json()), "places": places, "batches": [*at["batches"], batch]})
        return at["number"] + 1

    def upsert(self, new: DataFrame, seq: str, batch: str) -> int:
        """Merges new's last row (by seq) of every key and returns the version; the columns `keep` of a key that is there stay. Applied once a batch name."""
        at = self.version()
        if batch in at["batches"]:
            return at["number"]
        key = at["key"]
        if new.where(F.col(key).isNull()).limit(1).count():
            raise ValueError(f"null in the key {key}")
        known = T.StructType.fromJson(at["schema"])
        fresh = [f for f in new.schema.fields if f.name not in known.fieldNames() and f.name != seq]
        schema = T.StructType([*known.fields, *(T.StructField(f.name, f.dataType, True) for f in fresh)])
        touched = [r[0] for r in new.select(self._bucket(at)).distinct().collect()]  # a row a bucket at most
        old = self._rows(at | {"schema": json.loads(schema.json())}, touched)
        return self._apply(at, upsert(old, new, key, seq, tuple(at["keep"])), touched, schema, batch)

    def rewrite(self, change: Callable[[DataFrame], DataFrame], batch: str) -> int:
        """Puts change(rows) in place of the rows, for the buckets where it changes something; keys must stay. Applied once a batch name."""
        at = self.version()
        if batch in at["batches"]:
            return at["number"]
        old = self.read(at["number"])
        new = change(old)
        both = new.unionByName(old, allowMissingColumns=True) if new.columns != old.columns else None
        if both is None:
            differ = new.exceptAll(old).select(self._bucket(at).alias("b")).union(old.exceptAll(new).select(self._bucket(at).alias("b")))
            touched = [r[0] for r in differ.distinct().collect()]  # a row a bucket at most
        else:
            touched = [int(b) for b in at["places"]]
        if not touched:
            return at["number"]
        rows = change(self._rows(at, touched))
        return self._apply(at, rows, touched, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]), batch)
