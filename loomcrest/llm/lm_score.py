"""Language-model scoring by deleted interpolation.

p(w | v) = a2(b) c(v, w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1), b being the frequency bucket of the context v. The
mixture weights are learned by expectation-maximisation on counts of a held-out part of the training documents
(`dev`), against counts from which that part is deleted; scores then use the counts of all training documents.

The order is 2: a third would about triple what pieces exchange (a corpus has nearly as many different trigrams as
tokens), and the contract's texts are scored whole either way.

Counts cover all training documents and never leave the cluster. Texts are first written as pieces of at most PIECE_BYTES
(or one text), which both passes read. Pass one sends each piece's distinct n-grams, as packed hashes, to shards by hash
range (a frequent n-gram costs one entry a piece); a shard adds up and sends back, for each n-gram in the order it came
in, its total if other pieces have it as well. Pass two brings the totals together with the piece's texts and scores.

There are SHARDS_A_CORE shards a core, and more only where a shard would get over `shard_bytes` of packed text; a shard works
through SLOTS hash ranges, one after the other, and holds the rest compressed. A piece sends a row to a shard that gets
some of its n-grams, so rows made are the pieces times a constant up to cores * SHARDS_A_CORE * shard_bytes, and never
more than the n-grams of all pieces.

Defined results: a null or empty text is one end token; a very long text is a piece of its own and must fit in a task;
repeated rows count and are scored each; without training tokens the model is uniform over one symbol (score 0); ids are
read as long, and null ids are in no held-out fold, so they are trained on; other columns are not looked at, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

FOLDS, HELD_OUT = 7, 2
#: Of training documents, those with crc32(id) mod DEV_FOLDS = DEV are `dev`.
DEV_FOLDS, DEV = 70, 3
BUCKETS = 24
PIECE_BYTES = 8 << 20
SHARD_BYTES, SHARDS_A_CORE, SLOTS = 64 << 20, 4, 8
_BEGIN, _PAIR = np.uint64(0x51ED270B7A3F4C95), np.uint64(0xD6E8FEB86659FD93)


class Chunk:
    """The tokens of some documents: words by id, the end token's id last, and the distinct pairs (previous, word)."""

    def __init__(self, texts: list[bytes | None]):
        import xxhash

        table: defaultdict[bytes, int] = defaultdict()
        table.default_factory = table.__len__
        sizes = np.zeros(len(texts), np.int64)
        parts = []
        for k, t in enumerate(texts):
            ws = C.words(t.translate(C.ASCII_LOWER)) if t else []
            sizes[k] = len(ws)
            parts.append(np.fromiter(map(table.__getitem__, ws), np.int32, len(ws)))
        n = len(table)
        self.hashes = np.empty(n + 2, np.uint64)  # words, the end, the begin (a context only)
        self.hashes[:n] = np.fromiter(map(xxhash.xxh3_64_intdigest, table), np.uint64, n)
        self.hashes[n], self.hashes[n + 1] = _PAIR, _BEGIN
        del table
        self.sizes = sizes + 1
        ends = np.cumsum(self.sizes)
        self.tokens = np.full(int(ends[-1]) if len(ends) else 0, n, np.int32)
        is_word = np.ones(len(self.tokens), bool)
        is_word[ends - 1] = False
        self.tokens[is_word] = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts, is_word
        self.previous = np.empty_like(self.tokens)
        self.previous[1:] = self.tokens[:-1]
        self.previous[ends - self.sizes] = n + 1
        pairs, pair_of = np.unique(self.previous * np.int64(n + 2) + self.tokens, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        self.pair_keys = C.splitmix(self.hashes[pairs // (n + 2)] * _PAIR + self.hashes[pairs % (n + 2)])
        self.word_keys = C.splitmix(self.hashes[: n + 1])
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)

    def counts(self, of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen documents: counts of words and of pairs."""
        on = of_docs[self.doc]
        return np.bincount(self.tokens[on], minlength=len(self.word_keys)), np.bincount(self.pair_of[on], minlength=len(self.pair_keys))


def _planes(x: np.ndarray) -> np.ndarray:
    """Integers as byte planes, low bytes first."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of one length as byte planes, compressed."""
    import zstandard

    return zstandard.compress(b"".join(np.ascontiguousarray(_planes(x)).tobytes() for x in arrays), 1)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(data)
    widths = [np.dtype(t).itemsize for t in types]
    n, out, at = len(data) // sum(widths), [], 0
    for t, w in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def pack_keys(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as their differences, with counts below 2^32."""
    return pack(np.diff(keys, prepend=np.uint64(0)), *(c.astype(np.uint32) for c in counts))


def unpack_keys(data: bytes, counts: int = 2) -> list[np.ndarray]:
    keys, *rest = unpack(data, np.uint64, *[np.uint32] * counts)
    return [np.cumsum(keys, dtype=np.uint64), *rest]


def _folds(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Training documents without dev, and dev, by id."""
    import zlib

    crc = np.array([-1 if i is None else zlib.crc32(str(i).encode()) for i in ids], np.int64)
    train = (crc < 0) | (crc % FOLDS != HELD_OUT)
    dev = train & (crc >= 0) & (crc % DEV_FOLDS == DEV)
    return train & ~dev, dev


_SENT = "shard int, piece long, words array<binary>, pairs array<binary>"


def _sent(piece: int, ids: list, texts: list, shards: int) -> pa.RecordBatch:
    """A row for each shard that gets n-grams of the piece: SLOTS packed lists of words and of pairs, null where empty."""
    c = Chunk(texts)
    main, dev = _folds(ids)
    counted = list(zip((c.word_keys, c.pair_keys), c.counts(main), c.counts(dev), strict=True))
    del c
    slots = shards * SLOTS
    shift = np.uint64(64 - slots.bit_length() + 1)
    lists = []
    for keys, m, d in counted:
        order = np.argsort(keys)  # those of held-out documents too: they want totals
        keys, m, d = keys[order], m[order], d[order]
        at = np.searchsorted(keys >> shift, np.arange(slots + 1, dtype=np.uint64)) if slots > 1 else [0, len(keys)]
        lists.append([pack_keys(keys[a:b], m[a:b], d[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)])
    mine = [range(s * SLOTS, (s + 1) * SLOTS) for s in range(shards)]
    used = [s for s in range(shards) if any(x[k] for x in lists for k in mine[s])]
    columns = [pa.array([[x[k] for k in mine[s]] for s in used], pa.list_(pa.binary())) for x in lists]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([piece] * len(used), pa.int64()), *columns], ["shard", "piece", "words", "pairs"])


#: totals: for each n-gram of the piece in the shard, in order, 1 + its count if several pieces have it, else 0. dev: n-grams in dev documents with their counts without dev.
_BACK = "piece long, shard int, words array<binary>, pairs array<binary>, dev array<binary>, main_tokens long, tokens long, types long"
_BACK_SCHEMA = pa.schema([("piece", pa.int64()), ("shard", pa.int32()), *((c, pa.list_(pa.binary())) for c in ("words", "pairs", "dev")), *((c, pa.int64()) for c in ("main_tokens", "tokens", "types"))])


def _totals(table: pa.Table) -> pa.Table:
    """A shard's totals, a row for each row that came in, and one with the shard's token and type numbers."""
    main_tokens = tokens = types = 0
    n = table.num_rows
    out: dict[str, list] = {"words": [[] for _ in range(n)], "pairs": [[] for _ in range(n)], "dev": [[] for _ in range(n)]}
    for kind in ("words", "pairs"):
        flat = table.column(kind).combine_chunks().flatten()
        for slot in range(SLOTS):
            has = [i for i in range(n) if flat[i * SLOTS + slot].is_valid]
            lists = [unpack_keys(flat[i * SLOTS + slot].as_py()) for i in has]
            if not lists:
                continue
            unique, back, seen = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True, return_counts=True)
            m = np.bincount(back, np.concatenate([x[1] for x in lists]), len(unique)).astype(np.uint64)
            d = np.bincount(back, np.concatenate([x[2] for x in lists]), len(unique)).astype(np.uint64)
            if kind == "words":
                main_tokens, tokens, types = main_tokens + int(m.sum()), tokens + int((m + d).sum()), types + int((m + d > 0).sum())
            told = np.where(seen > 1, m + d + np.uint64(1), np.uint64(0))
            at = 0
            for i, (keys, _, own_dev) in zip(has, lists, strict=True):
                u = back[at : at + len(keys)]
                at += len(keys)
                out[kind][i].append(pack(told[u]))
                if own_dev.any():
                    v = u[own_dev > 0]
                    out["dev"][i].append(pack(np.diff(unique[v], prepend=np.uint64(0)), m[v]))
    rows = list(zip(table.column("piece").to_pylist(), table.column("shard").to_pylist(), out["words"], out["pairs"], out["dev"], [0] * n, [0] * n, [0] * n, strict=True))
    rows.append((None, None, None, None, None, main_tokens, tokens, types))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BACK_SCHEMA, strict=True)], schema=_BACK_SCHEMA)


def _told(back: pa.Table, kind: str, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Counts of a piece's n-grams: the totals that came back, its own where none did."""
    order = np.argsort(back.column("shard").to_numpy())
    lists = back.column(kind).to_pylist()
    total = np.concatenate([unpack(x, np.uint64)[0] for i in order for x in lists[i]])
    at = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[at] = np.where(total > 0, total.astype(np.int64) - 1, own[at])
    return out


def _dev_counts(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a piece's dev documents, sorted, with their counts without dev."""
    parts = [unpack(x, np.uint64, np.uint64) for xs in back.column("dev").to_pylist() for x in xs]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, m = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), np.concatenate([m for _, m in parts]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], m[order]


def _found(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of keys, 0 where they are not among the known."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


def _terms(c: Chunk, words: np.ndarray, pairs: np.ndarray, docs_in: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: its context's bucket, the bigram and the unigram estimate."""
    context = np.concatenate((words, [docs_in]))[c.previous]  # the begin is as frequent as the end
    bucket = np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)
    return bucket, pairs[c.pair_of] / np.maximum(context, 1), words[c.tokens] / max(n, 1)


_STEPS = 8  # of a factor of two, in the statistics for EM
_ZERO = -(1 << 20)  # the step of an estimate of 0


def step_of(p: np.ndarray, uniform: float) -> np.ndarray:
    """The logarithm of p relative to uniform in steps; negative below it, _ZERO at 0."""
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300) / uniform) * _STEPS), _ZERO).astype(np.int64)


def learn_weights(rows: list[tuple[int, int, int, int]], uniform: float, rounds: int = 100) -> np.ndarray:
    """EM per bucket on (bucket, step of bigram, step of unigram, count). A bucket with fewer than 50 tokens takes the one's below it."""
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    out[0] = [0.0, 0.9, 0.1]
    by = np.array(rows, np.float64).reshape(-1, 4)
    for b in range(BUCKETS):
        x = by[by[:, 0] == b]
        if x[:, 3].sum() < 50:
            if b > 1:
                out[b] = out[b - 1]
            continue
        p = np.column_stack([np.where(x[:, k] == _ZERO, 0, uniform * 2 ** (x[:, k] / _STEPS)) for k in (1, 2)] + [np.full(len(x), uniform)])
        a = out[b].copy()
        for _ in range(rounds):
            mix = p * a
            a = (mix / mix.sum(1, keepdims=True) * x[:, 3:]).sum(0) + 1e-3
            a /= a.sum()
        out[b] = a
    return out


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = PIECE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    rows = C.pieces(docs, doc_id, text, chunk_bytes)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    shards = 1 << (max(SHARDS_A_CORE * cores, -(-size // shard_bytes)) - 1).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield _sent(piece, *C.unpack_texts(data.as_py()), shards)

    back = C.materialize(rows.mapInArrow(send, _SENT).groupBy("shard").applyInArrow(_totals, _BACK), "none")
    main_total, total, types = back.where("piece is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("main_tokens", "tokens", "types"))).first()
    uniform = 1 / (types + 1)

    def dev_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's dev documents, and its numbers of training documents without and with them."""
        for b in batches:
            for piece, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, texts = C.unpack_texts(data.as_py())
                main, dev = _folds(ids)
                k = np.flatnonzero(dev)
                some = C.pack_texts([ids[i] for i in k], [texts[i] for i in k])
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([some], pa.binary()), pa.array([int(main.sum())], pa.int64()), pa.array([len(k)], pa.int64())], ["piece", "data", "main", "dev"])

    held = C.materialize(rows.mapInArrow(dev_only, "piece long, data binary, main long, dev long"), "none")
    # documents (ends) without dev, and all training documents, are the begin's counts
    main_docs, dev_docs = held.agg(F.coalesce(F.sum("main"), F.lit(0)), F.coalesce(F.sum("dev"), F.lit(0))).first()

    def statistics(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _NO_STATS
        c = Chunk(C.unpack_texts(docs.column("data")[0].as_py())[1])
        known = _dev_counts(told)
        bucket, p2, p1 = _terms(c, _found(c.word_keys, *known), _found(c.pair_keys, *known), main_docs, main_total)
        seen, times = np.unique(np.column_stack([bucket, step_of(p2, uniform), step_of(p1, uniform)]), axis=0, return_counts=True)
        return pa.table([*(pa.array(seen[:, k]) for k in range(3)), pa.array(times)], names=["b", "p2", "p1", "n"])

    told = back.where("piece is not null and size(dev) > 0").select("piece", "dev")
    sums = held.where("dev > 0").select("piece", "data").groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(statistics, "b long, p2 long, p1 long, n long")
    weights = learn_weights([tuple(r) for r in sums.groupBy("b", "p2", "p1").agg(F.sum("n")).collect()], uniform)

    def scored(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORED.empty_table()
        ids, texts = C.unpack_texts(docs.column("data")[0].as_py())
        c = Chunk(texts)
        del texts
        main, dev = _folds(ids)
        own_words, own_pairs = c.counts(main | dev)
        words = _told(told, "words", c.word_keys, own_words)
        pairs = _told(told, "pairs", c.pair_keys, own_pairs)
        bucket, p2, p1 = _terms(c, words, pairs, main_docs + dev_docs, total)
        a = weights[bucket]
        p = a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] * uniform
        del a, p2, p1, bucket
        known = words[c.tokens]
        per_doc = lambda x: np.bincount(c.doc, x, len(ids))
        base = per_doc(np.log10((known + 1) / (total + types + 1)))
        cols = [pa.array(ids, pa.int64()), pa.array(~(main | dev)), pa.array(c.sizes), pa.array(per_doc(known > 0).astype(np.int64)), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(per_doc(np.log10(p)))]
        return pa.table(cols, names=_SCORED.names)

    told = back.where("piece is not null").select("piece", "shard", "words", "pairs")
    return rows.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_NO_STATS = pa.schema([(x, pa.int64()) for x in ("b", "p2", "p1", "n")]).empty_table()
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
