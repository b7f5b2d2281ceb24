"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a window of `seed` words are tiled: the longest common matches of words not yet
marked are found by running Karp-Rabin with falling search lengths, and marked, until none of `seed` words is left.
Tiles may lie in any order, so reordered passages are caught. A document is contaminated by an item whose words are
covered to `coverage_percent` or more.

The item set is a stated query set: it is cut into blocks of at most `block_words` words (the proven bound of each
broadcast), and every block meets all rows. Documents stream through; nothing is shuffled but the few matches.

Defined results: null, empty or blank texts match nothing; an item of fewer words than `seed` is its own seed; an
item without words, or null, is ignored; repeated rows and repeated items each give their own matches; letters A-Z
are lower-cased. A very long text is read whole, in one task; a document's id may be of any type, an item's is read as
long; extra columns pass through decontaminated() whatever their names, contaminated() does not look at them; an empty
table of either kind gives no matches.

Items travel to the executors in broadcasts of at most `block_words` words (or one item); each is a pass over the texts,
and its candidates are bounded from above before they are tiled: tiles lie within the windows that share a seed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

_HASH_BASE, _HASH_MOD = 1_000_003, (1 << 61) - 1


def tile(pattern: list[int], text: list[int], least: int, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id lists: (pattern start, text start, length), longest first; ties by position.

    A negative id in text matches nothing.
    """
    marked_p, marked_t = bytearray(len(pattern)), bytearray(int(x < 0) for x in text)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(first, len(pattern)))
    while True:
        found = _scan(pattern, text, marked_p, marked_t, length)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * length:  # much longer ones exist: look for those first
            length = longest
            continue
        again = False
        for p, t, n in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
            if any(marked_p[p : p + n]) or any(marked_t[t : t + n]):
                again = True  # part of it was taken: what is left may still be a match
                continue
            marked_p[p : p + n] = b"\x01" * n
            marked_t[t : t + n] = b"\x01" * n
            tiles.append((p, t, n))
        if again:
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)


def _windows(ids: list[int], marked: bytearray, length: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of every window without a marked word."""
    top, h, run = pow(_HASH_BASE, length - 1, _HASH_MOD), 0, 0
    for i, x in enumerate(ids):
        if marked[i]:
            h, run = 0, 0
            continue
        if run >= length:
            h = (h - ids[i - length] * top) % _HASH_MOD
        h = (h * _HASH_BASE + x) % _HASH_MOD
        run += 1
        if run >= length:
            yield i - length + 1, h


def _scan(pattern: list[int], text: list[int], marked_p: bytearray, marked_t: bytearray, length: int) -> list[tuple[int, int, int]]:
    """Matches of `length` or more unmarked words, each extended to the right; for a text start the longest, first in the pattern."""
    table = defaultdict(list)
    for p, h in _windows(pattern, marked_p, length):
        table[h].append(p)
    if not table:
        return []
    out: list[tuple[int, int, int]] = []
    last, row = -2, {}  # only the row before is needed: what is left of a match, by its place in the pattern
    for t, h in _windows(text, marked_t, length):
        before, row = row if last == t - 1 else {}, {}
        last = t
        for p in table.get(h, ()):
            if before.get(p - 1, 0) > length:  # inside a match that began to the left
                row[p] = before[p - 1] - 1
                continue
            if pattern[p : p + length] != text[t : t + length]:
                continue
            n = length
            while p + n < len(pattern) and t + n < len(text) and not marked_p[p + n] and not marked_t[t + n] and pattern[p + n] == text[t + n]:
                n += 1
            row[p] = n
            out.append((p, t, n))
    return out


class Items:
    """A block of test items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int):
        self.seed = seed
        self.vocabulary: dict[bytes, int] = {}
        self.words, self.ids = [], []
        for item, text in items:
            ws = C.words(text.translate(C.ASCII_LOWER))
            if ws:
                self.ids.append(item)
                self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws])
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)  # width -> (hash, item)
        for k, ws in enumerate(self.words):
            width = min(seed, len(ws))
            a = np.array(ws, np.int64)
            by[width] += [(int(h), k) for h in np.unique(self._hash(a, width))]
        self.seeds = {}
        for width, pairs in by.items():
            table = defaultdict(list)
            for h, k in pairs:
                table[h].append(k)
            self.seeds[width] = (np.array(sorted(table), np.int64), table)

    @staticmethod
    def _hash(ids: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(ids) - width + 1, np.uint64)
        for k in range(width):
            h = C.splitmix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k].astype(np.uint64))
        return h.view(np.int64)

    def matches(self, texts: list[bytes | None], coverage_percent: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, tiles, covered words, item words, longest tile) of every contaminated pair."""
        split = [C.words(t.translate(C.ASCII_LOWER)) if t else [] for t in texts]
        get = self.vocabulary.get
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((get(w, -1) for ws in split for w in ws), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(split)), sizes)
        candidates: dict[tuple[int, int], list[int]] = defaultdict(list)
        for width, (known, table) in self.seeds.items():
            if len(ids) < width:
                continue
            ok = (doc[: len(ids) - width + 1] == doc[width - 1 :])
            bad = np.cumsum(np.concatenate(([0], (ids < 0).astype(np.int64))))
            at = np.flatnonzero(ok & (bad[width:] == bad[: len(ids) - width + 1]))
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(width):
                h = C.splitmix(h * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64))
            h = h.view(np.int64)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in np.flatnonzero(known[place] == h):
                for k in table[int(h[i])]:
                    candidates[(int(doc[at[i]]), k)].append(int(at[i]))
        for (row, k), hits in candidates.items():
            pattern = self.words[k]
            width = min(self.seed, len(pattern))
            need = coverage_percent * len(pattern)
            if 100 * len(hits) * width < need:  # tiles lie within the hits' windows
                continue
            # words in no shared window can't be in a tile; runs of the others stay apart
            text: list[int] = []
            end = -1
            for a in sorted(hits):
                if a > end and text:
                    text.append(-1)
                text += ids[max(a, end) : a + width].tolist()
                end = max(end, a + width)
            if 100 * len(text) < need:
                continue
            tiles = tile(pattern, text, width)
            covered = sum(n for _, _, n in tiles)
            if covered * 100 >= need:
                yield row, self.ids[k], len(tiles), covered, len(pattern), max(n for _, _, n in tiles)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", seed: int = 5, coverage_percent: int = 80, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, longest_tile): one row for each contaminated row of docs and item."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("item_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_tiles", "covered_words", "item_words", "longest_tile"))]
    out = None
    for block, last in _blocks(benchmark, item_id, item_text, seed, block_words):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block.value
            for piece in C.slices(batches, "text"):
                got = list(items.matches(C.bytes_column(piece, "text"), coverage_percent))
                if got:
                    row, *rest = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], [f.name for f in fields])

        part = rows.mapInArrow(run, T.StructType(fields))
        if not last:  # what stands in the shared folder no longer needs its items
            part = C.materialize(part)
            block.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], T.StructType(fields))


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, seed: int, block_words: int) -> Iterator[tuple]:
    """Broadcasts of Items and whether each is the last, each of at most block_words words (or one item), made as the rows stream to the driver: with those that are not the last done with, two are live at most."""
    sc = benchmark.sparkSession.sparkContext
    held, n, ready = [], 0, None
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").toLocalIterator():
        text = r.t.encode("utf-8", "surrogatepass")
        size = len(text.split())
        if held and n + size > block_words:
            if ready is not None:
                yield ready, False
            ready, held, n = sc.broadcast(Items(held, seed)), [], 0
        held.append((r.i, text))
        n += size
    if held:
        if ready is not None:
            yield ready, False
        yield sc.broadcast(Items(held, seed)), True


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs that no item contaminates, in one pass a block; all columns pass through."""
    schema, place = docs.schema, docs.columns.index(text)
    seed, percent = how.pop("seed", 5), how.pop("coverage_percent", 80)
    names = docs.columns
    for block, last in _blocks(benchmark, how.pop("item_id", "item_id"), how.pop("item_text", "text"), seed, how.pop("block_words", 1_000_000)):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block.value
            for batch in batches:
                at = 0
                for piece in C.slices([batch.select([place]).rename_columns(["text"])], "text"):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[row for row, *_ in items.matches(C.bytes_column(piece, "text"), percent)]] = False
                    yield batch.slice(at, piece.num_rows).filter(pa.array(clean)).rename_columns(names)
                    at += piece.num_rows

        docs = docs.mapInArrow(run, schema)
        if not last:
            docs = C.materialize(docs)
            block.unpersist()
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, bench)
