"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. One pass makes each document's set hash, `perms` minima in bands, and a packed signature of the minima's low `bits`.
2. Equal sets collapse into a class (pre-aggregated), so copies never meet each other.
3. Classes share a band's bucket. `pivots` classes of each bucket are paired with every other (linear in the bucket); a
   pair goes on if its collision-corrected estimate, read from bit counts, is not `slack` standard errors below the
   threshold, and is confirmed on the full sets. This is done `star_rounds` times, the next time with pivots among what
   the first left outside the bucket's main component.
4. What is still outside its bucket's main component is compared with the whole bucket, block by block (`_BLOCK` by
   `_PANEL` classes a task, and `_SHINGLES` shingles of either): bit counts first, then full sets, and only confirmed links leave the task. Pairs inside one
   component can't change the result and are skipped. So the links found connect exactly what all of the bucket's
   links connect.

A pair at the threshold 0.8 misses all 32 bands of 4 minima with probability 5e-8, and the estimate of 5 standard errors
drops it with one of 3e-7; rows=1 with slack=inf leaves only the bands' 128 single minima (1e-89). Sets and classes are
compared by 64-bit hashes of shingles.

Defined results: a document without words (null, empty, blank) has an empty set and links with nothing; one of fewer
words than a shingle has the whole sequence as its one shingle; repeated ids are rows of their own, each in its text's
class; a row of null id links with nothing and is kept, its component null; ids are read as long; other columns are not
looked at, whatever their names; a very long text is signed whole, and its set must fit in a task; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .components import components

_LANES = 0x5555555555555555
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    """64-bit hashes of words (xxhash; the library's function on each)."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))


def shingle_hashes(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every document's distinct shingles, sorted within each; and how many each has."""
    split = [C.words(t.translate(C.ASCII_LOWER)) if t else [] for t in texts]
    ids, sizes, vocabulary = C.word_ids(split)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = word_hashes(vocabulary)[ids]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = h.copy()
    for k in range(1, width):  # word k behind the first, where the document still has it
        ok = np.zeros(len(ids), bool)
        ok[: len(ids) - k] = doc[k:] == doc[: len(ids) - k]
        nxt = np.zeros(len(ids), np.uint64)
        nxt[: len(ids) - k] = h[k:]
        mixed = np.where(ok, C.splitmix(mixed * _BASE + nxt), mixed)
    size_of = np.repeat(sizes, sizes)
    keep = (at + width <= size_of) | (at == 0) & (size_of < width)
    mixed, doc = C.splitmix(mixed[keep]), doc[keep]
    order = np.lexsort((mixed, doc))
    mixed, doc = mixed[order], doc[order]
    first = np.ones(len(mixed), bool)
    first[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    return mixed[first], np.bincount(doc[first], minlength=len(texts))


def sign(hashes: np.ndarray, counts: np.ndarray, perms: int, rows: int, bits: int, block: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """Per document: hashes of its bands (perms / rows of them) and its packed low bits, as 64-bit integers."""
    rng = np.random.default_rng(20_240_611)
    a = rng.integers(1, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(counts)
    minima = np.full((n, perms), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        ends = np.cumsum(counts[full])
        starts = ends - counts[full]
        d = 0
        while d < len(full):  # whole documents, about `block` shingles at a time; a longer document in pieces
            e = max(d + 1, int(np.searchsorted(ends, starts[d] + block, "right")))
            if e == d + 1 and counts[full[d]] > block:
                for x in range(starts[d], ends[d], block):
                    part = hashes[x : min(x + block, ends[d])]
                    got = ((part[:, None] * a) >> np.uint64(32)).astype(np.uint32).min(0)
                    minima[full[d]] = np.minimum(minima[full[d]], got)
            else:
                part = hashes[starts[d] : ends[e - 1]]
                values = ((part[:, None] * a) >> np.uint64(32)).astype(np.uint32)
                minima[full[d:e]] = np.minimum.reduceat(values, starts[d:e] - starts[d], axis=0)
            d = e
    bands = np.zeros((n, perms // rows), np.uint64)
    for k in range(rows):
        bands = C.splitmix(bands * _BASE + minima[:, k::rows].astype(np.uint64))
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64)
    lanes = 64 // bits
    packed = np.zeros((n, perms // lanes), np.uint64)
    for k in range(lanes):
        packed |= low[:, k::lanes] << np.uint64(k * bits)
    return bands, packed


def _signed(docs: DataFrame, width: int, perms: int, rows: int, bits: int) -> DataFrame:
    words64 = perms * bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text"):
            hashes, counts = shingle_hashes(C.bytes_column(piece, "text"), width)
            bands, packed = sign(hashes, counts, perms, rows, bits)
            has = counts > 0
            starts = (np.cumsum(counts) - counts)[has]
            key = np.zeros(len(counts), np.uint64)  # an order-free hash of the set
            if has.any():
                key[has] = np.add.reduceat(C.splitmix(hashes), starts)
            key = C.splitmix(key + counts.astype(np.uint64)).view(np.int64)
            band = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), bands.shape[1]).cast(pa.list_(pa.int64()))
            named = has & ~pc.is_null(piece.column(0)).to_numpy(zero_copy_only=False)
            cols = [piece.column(0), piece.column(1), pa.array(counts), pa.array(key, mask=~named), band, *(pa.array(np.ascontiguousarray(packed[:, j]).view(np.int64)) for j in range(words64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n_shingles", "node", "bands", *(f"s{j}" for j in range(words64))])

    schema = "doc_id long, row long, n_shingles long, node long, bands array<long>, " + ", ".join(f"s{j} long" for j in range(words64))
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles (sorted hashes) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text"):
            hashes, counts = shingle_hashes(C.bytes_column(piece, "text"), width)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            # sorted as signed integers, within each
            doc = np.repeat(np.arange(len(counts)), counts)
            values = hashes.view(np.int64)
            values = values[np.lexsort((values, doc))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def mismatch_limit(threshold: float, perms: int, bits: int, slack: float) -> int:
    """Most mismatching lanes of a pair whose estimate is within `slack` standard errors of the threshold.

    P(lanes match) = J + (1 - J) / 2^bits, the second term being chance collisions.
    """
    p = threshold + (1 - threshold) / 2**bits
    return perms if slack == np.inf else int(np.ceil(perms * (1 - p) + slack * np.sqrt(perms * p * (1 - p))))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, threshold_percent: int = 80, perms: int = 128, rows: int = 4, bits: int = 2, slack: float = 5.0, star_rounds: int = 2, pivots: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs. Links: 100 * shared >= threshold_percent * union."""
    if bits != 2:
        raise ValueError("bit counts are written for lanes of two bits")
    words64 = perms * bits // 64
    sig = [f"s{j}" for j in range(words64)]
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = C.materialize(_signed(docs, width, perms, rows, bits))
    classes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in sig))
    classes = C.materialize(classes.select("node", "least.*", "n", "bands", *sig))

    banded = classes.select("node", "n", *sig, F.posexplode("bands").alias("band", "hash")).select("node", "n", *sig, F.xxhash64("band", "hash").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    members = C.materialize(banded.join(shared, "bucket"))

    lanes = [f"bit_count(((a.{c} ^ b.{c}) | shiftrightunsigned(a.{c} ^ b.{c}, 1)) & {_LANES}L)" for c in sig]
    limit = mismatch_limit(threshold_percent / 100, perms, bits, slack)
    alike = F.expr(f"a.node <> b.node and 100 * least(a.n, b.n) >= {threshold_percent} * greatest(a.n, b.n) and {' + '.join(lanes)} <= {limit}")
    pair = [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]
    edges, comp = None, None
    for k in range(star_rounds + 1):
        if comp is None:
            live, least = members.withColumn("comp", F.col("node")), members.withColumn("comp", F.col("node"))
        else:
            named = members.join(comp.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left").withColumn("comp", F.coalesce("component", "node")).drop("cn", "component")
            # the component of the bucket's least class is its main one; buckets of one component are done
            main = named.groupBy("bucket").agg(F.min_by("comp", "node").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "main")
            live = C.materialize(named.join(main, "bucket"))
            if not live.take(1):
                break
            least = live.where("comp <> main")
        if k < star_rounds:
            chosen = F.array_distinct(F.array(*(F.min_by(F.struct("node", "n", *sig, "comp"), F.xxhash64("node", F.lit(j))) for j in range(pivots))))
            star = least.groupBy("bucket").agg(chosen.alias("r")).select("bucket", F.explode("r").alias("r")).select("bucket", "r.*")
            found = live.alias("a").join(star.alias("b"), "bucket").where(alike & F.expr("a.comp <> b.comp"))
        else:
            links = C.materialize(_blocks(docs, classes, live, sig, width, threshold_percent, limit))
            edges = edges.unionByName(links.select("u", "v", F.lit(True).alias("linked")))
            comp = components(edges.where("linked"))
            break
        found = found.select(*pair).distinct()
        if edges is not None:
            found = found.join(edges.select("u", "v"), ["u", "v"], "left_anti")
        confirmed = C.materialize(_confirm(docs, classes, C.materialize(found), width, threshold_percent))
        edges = confirmed if edges is None else edges.unionByName(confirmed)
        comp = components(edges.where("linked"))
    out = signed.join(_labels(classes, comp), "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _labels(classes: DataFrame, comp: DataFrame | None) -> DataFrame:
    """node, component_id: the least document of the classes in a node's component."""
    if comp is None:
        return classes.select("node", F.col("doc_id").alias("component_id"))
    named = classes.select("node", "doc_id").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.select("node", "component").join(least, "component").select("node", "component_id")


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The shingles of one document of each class in nodes, written once."""
    chosen = nodes.join(classes.select("node", "doc_id", "row"), "node")
    texts = docs.withColumn("row", F.xxhash64("text")).join(chosen, ["doc_id", "row"]).dropDuplicates(["node"])
    return C.materialize(_shingle_sets(texts, width), "lz4")


#: Classes of a block and of a panel, and shingles of either; whichever is reached first.
_BLOCK, _PANEL, _SHINGLES = 256, 4096, 1 << 21


def _blocks(docs: DataFrame, classes: DataFrame, live: DataFrame, sig: list[str], width: int, percent: int, limit: int) -> DataFrame:
    """(u, v): confirmed links between classes outside a bucket's main component and all classes of the bucket."""
    live = live.withColumn("rest", F.col("comp") != F.col("main"))
    sizes = live.groupBy("bucket").agg(F.sum(F.col("rest").cast("int")).alias("r"), F.count("*").alias("m"), F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0)).alias("rn"), F.sum("n").alias("mn"))
    parts = lambda rows, most, shingles, name: F.expr(f"int(greatest(ceil({rows} / {most}), ceil({shingles} / {_SHINGLES})))").alias(name)
    dealt = live.join(sizes.select("bucket", parts("r", _BLOCK, "rn", "rows"), parts("m", _PANEL, "mn", "panels")), "bucket")
    place = lambda n: F.expr(f"pmod(xxhash64(node, {n}), {n})").cast("int")
    cols = ["bucket", "node", "n", "comp", *sig]
    left = dealt.where("rest").select(*cols, F.lit(True).alias("a"), place("rows").alias("i"), F.explode(F.expr("sequence(0, panels - 1)")).alias("j"))
    right = dealt.select(*cols, F.lit(False).alias("a"), F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), place("panels").alias("j"))
    sets = _sets(docs, classes, live.select("node").distinct(), width)
    both = left.union(right).join(sets, "node")

    def run(t: pa.Table) -> pa.Table:
        on = t.column("a").to_numpy()
        node, n, comp = (t.column(c).to_numpy() for c in ("node", "n", "comp"))
        packed = np.stack([t.column(c).to_numpy() for c in sig], 1).view(np.uint64)
        sets = t.column("shingles").combine_chunks()
        ends = sets.offsets.to_numpy()
        flat = sets.flatten().to_numpy()
        ends = ends - ends[0]
        panel = np.flatnonzero(~on)
        u, v = [], []
        for k in np.flatnonzero(on):
            x = packed[panel] ^ packed[k]
            x = (x | x >> np.uint64(1)) & np.uint64(_LANES)
            near = np.bitwise_count(x).sum(1) <= limit
            near &= (comp[panel] != comp[k]) & (100 * np.minimum(n[panel], n[k]) >= percent * np.maximum(n[panel], n[k]))
            own = flat[ends[k] : ends[k + 1]]
            for p in panel[near]:
                other = flat[ends[p] : ends[p + 1]]
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                shared = int((own[at] == other).sum())
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    u.append(min(node[k], node[p]))
                    v.append(max(node[k], node[p]))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return both.groupBy("bucket", "i", "j").applyInArrow(run, "u long, v long").distinct()


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (u, v) with linked: whether their full sets reach the threshold. One document stands for a class."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = _sets(docs, classes, nodes, width)
    joined = pairs.join(sets.withColumnsRenamed({"node": "u", "shingles": "x"}), "u").join(sets.withColumnsRenamed({"node": "v", "shingles": "y"}), "v")
    both = F.size(F.array_intersect("x", "y"))
    return joined.select("u", "v", both.alias("i"), (F.size("x") + F.size("y") - both).alias("o")).select("u", "v", (F.col("i") * 100 >= F.col("o") * percent).alias("linked"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without the documents that are not the least of their group.

    An id goes only if all of its rows do, so rows of a repeated id stay or go together, and a group keeps one id.
    """
    name = C.fresh(docs, "_gone")
    gone = near_duplicates(docs, text, doc_id, **how).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
