"""Shared helpers: words, Arrow chunks, shared-folder checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.split() cuts at exactly \x20 and \x09-\x0D, so a word is `[^\x20\x09-\x0D]+`.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MASK64 = (1 << 64) - 1


def words(text: bytes | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text; none of a null."""
    return text.split() if text else []


def bytes_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, nulls kept."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], name: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut so that a piece has at most max_bytes of `name` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(name))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where the setting is absent (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomcrest-")
        sc._conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomcrest/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage is cut, executors may be lost."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)  # with the application
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; nothing may read it any more."""
    if path := getattr(df, "_written", None):
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def fold_of(doc_id: str, n: int):
    """crc32(doc_id as text) mod n; null ids belong to fold -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(-1)).cast("int")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df lacks (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_ids(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids of all words in order (equal words, equal ids), words per document, the vocabulary by id."""
    table: dict[bytes, int] = {}
    get = table.setdefault
    ids = np.fromiter((get(w, len(table)) for ws in docs for w in ws), np.int64)
    return ids, np.fromiter(map(len, docs), np.int64, len(docs)), list(table)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public-domain splitmix64) on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack_texts(ids: list, texts: list[bytes | None]) -> bytes:
    """Ids (long or null) and texts (bytes or null) of some rows in one compressed string of bytes."""
    import zstandard

    head = np.array([[len(ids), 0, 0], *([i or 0, i is None, -1 if t is None else len(t)] for i, t in zip(ids, texts, strict=True))], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(t for t in texts if t), 3)


def unpack_texts(data: bytes) -> tuple[list, list[bytes | None]]:
    import zstandard

    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 3 * n, 24).reshape(n, 3)
    ends = 24 * (n + 1) + np.cumsum(np.maximum(head[:, 2], 0))
    texts = [None if k < 0 else data[e - k : e] for k, e in zip(head[:, 2].tolist(), ends.tolist(), strict=True)]
    return [None if null else i for i, null, _ in head.tolist()], texts


def pieces(docs: DataFrame, doc_id: str, text: str, piece_bytes: int) -> DataFrame:
    """All rows of docs as (piece, data): up to piece_bytes of text (or one text) in a row, packed, written to the shared folder.

    So several passes see the same pieces whatever becomes of executors, and texts travel compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack_texts(ids, texts)], pa.binary())], ["piece", "data"])

        for part in slices(batches, "text", 1 << 20):
            for i, t in zip(part.column(0).to_pylist(), bytes_column(part, "text"), strict=True):
                if ids and held + len(t or b"") > piece_bytes:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t or b"") + 24
        if ids:
            yield row()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, "piece long, data binary"), "none")
