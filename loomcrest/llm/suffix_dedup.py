"""Repeated substrings by suffix arrays built by induced sorting.

A string of `length` bytes that starts at two places or more is removed at each of them. Suffixes that could begin such
a string are first brought together, then sorted, shard by shard:

1. Every window of `length` bytes has an anchor, its least hashed gram (the leftmost of equals). Equal windows have
   equal anchors at equal offsets. Neighbouring windows of one anchor form a context, of 268 bytes on average.
2. Each piece of the corpus sends its distinct (anchor, context) hashes to shards by anchor. An anchor seen once ends
   there; the bytes of each different context of the others are fetched once, with the number of its places (1, or 2
   for more). Neighbouring contexts whose anchors have no other context travel as one string, as only they themselves
   can be their equals.
3. A shard's contexts are sorted as suffixes by induced sorting; permuted common prefixes of `length` or more join equal
   windows, and contexts learn which of their windows are repeated. Nothing is removed but by this.
4. What was learnt goes to every piece that holds the context, which marks the bytes of its repeated windows.

An anchor with more than `hot` different contexts (a passage that very many documents share, at its edges) has them cut
into single windows, spread by their content: no group is ever larger than its distinct strings make it, and nothing is
dropped. Contexts are compared by two 64-bit hashes, windows inside a shard by their bytes.

Defined results: a null text is empty; documents shorter than `length` lose nothing; a very long text is a piece of its
own and must fit in a task; overlaps within a document count; repeated rows and repeated ids are documents of their own;
strings never cross documents; ids are read as long; other columns are not looked at, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .sais import common_prefixes, suffix_array

LENGTH, GRAM = 200, 64
CHUNK_BYTES, SLICE = 8 << 20, 1 << 19
SHARD_BYTES = 1 << 20
#: Bytes that are sorted at once, in a processor's own cache (or one anchor's contexts).
SORT_BYTES = 1 << 18
#: Shards of anchors: so many a core, and more only where one would stand for more packed text than so many bytes.
SHARDS_A_CORE, ANCHOR_SHARD_BYTES = 4, 32 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """Random words for bytes, powers of two odd bases and of their inverses."""
    rng = np.random.default_rng(77)
    n = SLICE * 2 + 1
    out = [rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
    for base in (int(_A), int(_B)):
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return tuple(out)


def _pieces(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of about SLICE bytes; a longer document in pieces that overlap by length - 1."""
    held, size = [], 0
    for d, t in enumerate(texts):
        if not t or len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, SLICE):
            part = t[at : at + SLICE + length - 1] if len(t) > SLICE else t
            if held and size + len(part) > SLICE:
                yield held
                held, size = [], 0
            held.append((d, at, part))
            size += len(part)
            if len(t) <= SLICE:
                break
    if held:
        yield held


def contexts(texts: list[bytes | None], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Every context: document, first and last window start in it, anchor hash, context hash."""
    byte_words, *powers = _tables()
    out: list[tuple[np.ndarray, ...]] = []
    for parts in _pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        n = len(data)
        sums = []
        for k in (0, 1):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(byte_words[k][data] * powers[2 * k][:n], out=s[1:])
            sums.append(s)
        at = np.arange(n - gram + 1, dtype=np.uint64)
        h = C.splitmix((sums[0][gram:] - sums[0][: n - gram + 1]) * powers[1][: n - gram + 1])
        value = (h & np.uint64(0xFFFFFFFFFFE00000)) | at  # SLICE * 2 <= 2^21
        span, width = 1, length - gram + 1
        while span * 2 <= width:
            value = np.minimum(value[:-span], value[span:])
            span *= 2
        if span < width:
            value = np.minimum(value[: len(value) - (width - span)], value[width - span :])
        anchor = (value & np.uint64(0x1FFFFF)).astype(np.int64)  # of every window start, those across documents too
        ends = np.cumsum([len(p) for _, _, p in parts])
        begins = ends - [len(p) for _, _, p in parts]
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        first[begins[begins < len(anchor)]] = True
        lo = np.flatnonzero(first)
        which = np.searchsorted(ends, lo, "right")
        hi = np.append(lo[1:], len(anchor)) - 1
        hi = np.minimum(hi, ends[which] - length)
        ok = hi >= lo
        lo, hi, which = lo[ok], hi[ok], which[ok]
        a = anchor[lo]
        fp = h[a]
        both = []
        for k in (0, 1):
            both.append((sums[k][hi + length] - sums[k][lo]) * powers[2 * k + 1][lo])
        shape = ((a - lo) << 32 | (hi - lo)).astype(np.uint64)
        ch = C.splitmix(C.splitmix(both[0] + shape) ^ both[1])
        doc = np.array([d for d, _, _ in parts], np.int64)[which]
        shift = np.array([o for _, o, _ in parts], np.int64)[which] - begins[which]
        out.append((doc, lo + shift, hi + shift, fp, ch))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distinct(fp: np.ndarray, ch: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (fp, ch), sorted, and how often each is there (or the sums of times)."""
    order = np.lexsort((ch, fp))
    f, c = fp[order], ch[order]
    first = np.ones(len(f), bool)
    first[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(f))) if times is None else np.add.reduceat(times[order], starts) if len(f) else times
    return f[starts], c[starts], n


def _shard_of(fp: np.ndarray, shards: int) -> np.ndarray:
    """Anchors are least hashes, so small numbers: they are hashed once more to be spread."""
    return (C.splitmix(fp) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)


def _u8(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_SENT = "shard int, piece long, fps binary, chs binary, times binary"
#: kind 0: windows los..his of contexts are repeated; kind 1: contexts to fetch, `los` is 1 where hot, 2 where an anchor's only one, `his` their number (2: two or more); kind 2: contexts of several places, and who holds them
_BACK = "kind int, shard int, piece long, fps binary, chs binary, los binary, his binary"
_BACK_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("piece", pa.int64()), *((c, pa.binary()) for c in ("fps", "chs", "los", "his"))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The packed arrays of all rows in a row."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _compare(table: pa.Table, hot: int) -> pa.Table:
    """A shard of anchors: which contexts have to be fetched from where, and who holds those of several places."""
    shard, holders = table.column("shard")[0].as_py(), table.column("piece").to_numpy()
    cols = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("fps", np.uint64), ("chs", np.uint64), ("times", np.uint8))]
    sizes = [len(x) for x in cols[0]]
    fp, ch, times = (np.concatenate(x) for x in cols)
    origin = np.repeat(np.arange(len(holders)), sizes)
    if not len(fp):
        return _BACK_ARROW.empty_table()
    order = np.lexsort((origin, ch, fp))
    f, c, n, o = fp[order], ch[order], times[order].astype(np.int64), origin[order]
    new_c = np.ones(len(f), bool)
    new_c[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new_c)
    group = np.cumsum(new_c) - 1
    total = np.add.reduceat(n, starts)
    f1 = f[starts]
    new_f = np.ones(len(f1), bool)
    new_f[1:] = f1[1:] != f1[:-1]
    kinds = np.diff(np.append(np.flatnonzero(new_f), len(f1)))[np.cumsum(new_f) - 1]
    rows: list[tuple] = []

    def send(kind: int, pick: np.ndarray, at: np.ndarray, los: np.ndarray, his: np.ndarray) -> None:
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by])) + 1
        for part in np.split(by, cuts) if len(by) else []:
            k, told = pick[part], (part if len(los) else part[:0])
            rows.append((kind, shard, int(holders[at[part[0]]]), _u8(f[k]), _u8(c[k]), _u8(los[told].astype(np.int32)), _u8(his[told].astype(np.int32))))

    several = np.flatnonzero(total[group] > 1)
    send(2, several, o[several], np.zeros(0), np.zeros(0))
    single_in = np.maximum.reduceat((total == 1).astype(np.int64), np.flatnonzero(new_f))[np.cumsum(new_f) - 1]
    ask = (total > 1) | (kinds > 1) & (single_in > 0)
    pick = starts[ask]
    send(1, pick, o[pick], np.where(kinds[ask] > hot, 1, np.where(kinds[ask] == 1, 2, 0)), np.minimum(total[ask], 2))
    return _table(rows, _BACK_ARROW)


#: Contexts for one shard from one piece, packed: a row has several, their bytes one after another.
_CUT = "part int, piece long, keys binary, fps binary, chs binary, times binary, ats binary, sizes binary, data binary"
_CUT_ARROW = pa.schema([("part", pa.int32()), ("piece", pa.int64()), *((c, pa.binary()) for c in ("keys", "fps", "chs", "times", "ats", "sizes", "data"))])
_PACK_BYTES = 1 << 20


def _find(f: np.ndarray, c: np.ndarray, fps: np.ndarray, chs: np.ndarray) -> np.ndarray:
    """For each (f, c) its place in the table (fps, chs), or -1."""
    if not len(fps):
        return np.full(len(f), -1)
    order = np.lexsort((chs, fps))
    key = fps[order] ^ C.splitmix(chs[order])
    by = np.argsort(key, kind="stable")
    want = f ^ C.splitmix(c)
    at = np.minimum(np.searchsorted(key[by], want), len(by) - 1)
    place = order[by[at]]
    return np.where((fps[place] == f) & (chs[place] == c), place, -1)


def _fetch(docs: pa.Table, asked: pa.Table, length: int, parts: int) -> pa.Table:
    """The bytes of the contexts asked for; hot ones in single windows.

    A row has its string's bytes, and `at`, what is to be added to its windows. Further contexts of a joined string follow
    as rows without bytes, whose `at` is their place in it.
    """
    if not docs.num_rows or not asked.num_rows:
        return _CUT_ARROW.empty_table()
    texts = C.unpack_texts(docs.column("data")[0].as_py())[1]
    fps, chs = (_column(asked, n, np.uint64) for n in ("fps", "chs"))
    how, times = (_column(asked, n, np.int32) for n in ("los", "his"))
    doc, lo, hi, fp, ch = contexts(texts, length)
    place = _find(fp, ch, fps, chs)
    got = np.flatnonzero(place >= 0)
    got = np.sort(got[np.unique(place[got], return_index=True)[1]])  # one occurrence is enough
    piece = docs.column("piece")[0].as_py()
    by: dict[int, list] = {}
    out: list[tuple] = []

    def put(key: int, rows: list[tuple], data: bytes) -> None:
        part = (key * 0x9E3779B97F4A7C15 >> 20) % parts
        held = by.setdefault(part, [0])
        held += [(key, *r, len(data) if not j else 0, data if not j else b"") for j, r in enumerate(rows)]
        held[0] += len(data)
        if held[0] > _PACK_BYTES:
            out.append(_packed(part, piece, by.pop(part)[1:]))

    alone = how[place[got]] == 2
    joins = np.zeros(len(got), bool)  # to the one before
    joins[1:] = alone[1:] & alone[:-1] & (got[1:] == got[:-1] + 1) & (doc[got[1:]] == doc[got[:-1]]) & (lo[got[1:]] == hi[got[:-1]] + 1)
    keys, chs_of = fp.tolist(), ch.tolist()
    i = 0
    while i < len(got):
        k, j = got[i], i + 1
        while j < len(got) and joins[j] and hi[got[j]] - lo[k] < _JOINED_BYTES:
            j += 1
        run = got[i:j]
        data = texts[doc[k]][lo[k] : hi[run[-1]] + length]
        row = lambda k, at: (keys[k], chs_of[k], int(times[place[k]]), int(at))
        if how[place[k]] == 1:
            for w in range(hi[k] - lo[k] + 1):
                window = data[w : w + length]
                put(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little"), [row(k, w)], window)
        else:
            put(keys[k], [row(x, lo[x] - lo[k]) for x in run], data)
        i = j
    out += [_packed(part, piece, held[1:]) for part, held in by.items()]
    return _table(out, _CUT_ARROW)


_JOINED_BYTES = 1 << 16
_PACKED = (np.uint64, np.uint64, np.uint64, np.int32, np.int32, np.int32)


def _packed(part: int, piece: int, rows: list[tuple]) -> tuple:
    cols = list(zip(*rows, strict=True))
    return part, piece, *(_u8(np.array(x, t)) for x, t in zip(cols, _PACKED, strict=False)), b"".join(cols[6])


def repeated_windows(parts: list[bytes], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part (valid UTF-8 bytes or a cut of them) a mask of its windows whose string occurs twice or more, a part counting `times`."""
    hit, begin = _hits(parts, times, length)
    return [hit[b : b + max(0, len(p) + 1 - length)] for b, p in zip(begin, parts, strict=True)]


def _hits(parts: list[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The masks of repeated_windows in a row, a part with a byte behind it, and where each part begins."""
    data = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    symbols = np.concatenate((data.astype(np.int64) + 1, [0]))
    sa = suffix_array(symbols)[1:]
    shared = common_prefixes(data, sa, length)
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)
    valid = np.arange(len(data)) - begin[owner] + length < sizes[owner]
    order = sa[valid[sa]]  # a suffix that is no window has no common prefix of a window's length
    group = np.cumsum(shared[order] < length)
    total = np.bincount(group, times[owner[order]])
    hit = np.zeros(len(data), bool)
    hit[order] = total[group] > 1
    return hit, begin


def _sort_shard(table: pa.Table, length: int, shards: int) -> pa.Table:
    """A shard's contexts, some anchors at a time: which windows are repeated. Rows of kind 0, for a piece where the context has one place, else for its shard of anchors."""
    names = ("keys", "fps", "chs", "times", "ats", "sizes")
    cols = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in zip(names, _PACKED, strict=True)]
    if not cols[0]:
        return _BACK_ARROW.empty_table()
    fp_all = np.concatenate(cols[1])
    piece = np.repeat(table.column("piece").to_numpy(), [len(x) for x in cols[0]])
    shard = _shard_of(fp_all, shards)
    key, fp, ch, times, at, size = (np.concatenate(x) for x in cols)
    data = table.column("data").to_pylist()
    row = np.repeat(np.arange(len(data)), [len(x) for x in cols[0]])
    begin = np.concatenate([np.cumsum(x) - x for x in cols[5]])
    order = np.argsort(key, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(key))
    ends = np.append(0, np.cumsum(size[order]))
    found: list[tuple] = []
    a = 0
    while a < len(cuts) - 1:
        b = a + 1
        while b < len(cuts) - 1 and ends[cuts[b + 1]] - ends[cuts[a]] <= SORT_BYTES:
            b += 1
        pick = order[cuts[a] : cuts[b]]
        a = b
        if len(pick) == 1 and times[pick[0]] == 1:
            continue
        head = size[pick] > 0
        of = np.cumsum(head) - 1  # the string of each context
        hit, start = _hits([data[row[k]][begin[k] : begin[k] + size[k]] for k in pick[head]], times[pick[head]], length)
        # where each context's windows begin; a joined string's mask is dealt to its contexts
        first = start[of] + np.where(head, 0, at[pick])
        new = hit.copy()
        new[1:] &= ~hit[:-1]
        new[first] = hit[first]
        lo = np.flatnonzero(new)
        over = np.append(lo[1:], len(hit))  # a run ends before the next one, or with the mask
        gaps = np.flatnonzero(~hit)
        hi = np.minimum(over, gaps[np.searchsorted(gaps, lo)]) - 1
        own = np.searchsorted(first, lo, "right") - 1
        add = np.where(head, at[pick], 0)[own] - first[own]
        k = pick[own]
        found.append((k, lo + add, hi + add))
    if not found:
        return _BACK_ARROW.empty_table()
    k, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = []
    for several in (False, True):
        mine = np.flatnonzero((times[k] > 1) == several)
        to = (shard if several else piece)[k[mine]]
        by = np.argsort(to, kind="stable")
        for part in np.split(mine[by], np.flatnonzero(np.diff(to[by])) + 1) if len(mine) else []:
            where = (int(shard[k[part[0]]]), None) if several else (None, int(piece[k[part[0]]]))
            rows.append((0, *where, _u8(fp[k[part]]), _u8(ch[k[part]]), _u8(lo[part].astype(np.int32)), _u8(hi[part].astype(np.int32))))
    return _table(rows, _BACK_ARROW)


def _tell(held: pa.Table, found: pa.Table) -> pa.Table:
    """What was found about a shard's contexts of several places, for each piece that holds them. Rows of kind 0."""
    if not held.num_rows or not found.num_rows:
        return _BACK_ARROW.empty_table()
    f, c, lo, hi = (_column(found, n, t) for n, t in (("fps", np.uint64), ("chs", np.uint64), ("los", np.int32), ("his", np.int32)))
    order = np.lexsort((lo, c, f))
    f, c, lo, hi = f[order], c[order], lo[order], hi[order]
    first = np.ones(len(f), bool)
    first[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(f)))
    rows = []
    for piece, fps, chs in zip(*(held.column(n).to_pylist() for n in ("piece", "fps", "chs")), strict=True):
        place = _find(np.frombuffer(fps, np.uint64), np.frombuffer(chs, np.uint64), f[at], c[at])
        place = place[place >= 0]
        k = _ranges(at[place], count[place])
        if len(k):
            rows.append((0, None, piece, _u8(f[k]), _u8(c[k]), _u8(lo[k]), _u8(hi[k])))
    return _table(rows, _BACK_ARROW)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _runs(texts: list[bytes | None], told: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal removed runs of a piece's texts: document, begin, end, in order."""
    none = np.zeros(0, np.int64)
    if not told.num_rows:
        return none, none, none
    fps, chs = (_column(told, n, np.uint64) for n in ("fps", "chs"))
    los, his = (_column(told, n, np.int32) for n in ("los", "his"))
    # equal (fp, ch) with several spans lie together
    order = np.lexsort((los, chs, fps))
    fps, chs, los, his = fps[order], chs[order], los[order], his[order]
    new = np.ones(len(fps), bool)
    new[1:] = (fps[1:] != fps[:-1]) | (chs[1:] != chs[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(fps)))
    doc, lo, _, fp, ch = contexts(texts, length)
    place = _find(fp, ch, fps[at], chs[at])
    k = np.flatnonzero(place >= 0)
    n = count[place[k]]
    which = np.repeat(k, n)
    span = _ranges(at[place[k]], n)
    d, a, b = doc[which], lo[which] + los[span], lo[which] + his[span] + length
    order = np.lexsort((a, d))
    d, a, b = d[order], a[order], b[order]
    if not len(d):
        return none, none, none
    # ends rise with begins, as all windows are of one length
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1])
    first = np.flatnonzero(new)
    return d[first], a[first], np.maximum.reduceat(b, first)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (sizes[0] of them), starts[1], .."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _removed(docs: pa.Table, told: pa.Table, length: int) -> pa.Table:
    if not docs.num_rows:
        return _OUT_ARROW.empty_table()
    ids, texts = C.unpack_texts(docs.column("data")[0].as_py())
    of, begin, end = _runs(texts, told, length)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for d, (i, t) in enumerate(zip(ids, texts, strict=True)):
        t = t or b""
        a, b = begin[first[d] : first[d + 1]].tolist(), end[first[d] : first[d + 1]].tolist()
        kept, at = hashlib.sha256(), 0
        for x, y in zip(a, b, strict=True):
            kept.update(t[at:x])
            at = y
        kept.update(t[at:])
        out.append((i, len(t), sum(b) - sum(a), len(a), kept.hexdigest(), [x for ab in zip(a, b, strict=True) for x in ab]))
    return _table(out, _OUT_ARROW)


def repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, hot: int = 4096, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat: start, end of every removed run, in bytes)."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    rows = C.pieces(docs, doc_id, text, chunk_bytes)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    shards = 1 << (max(SHARDS_A_CORE * cores, -(-size // ANCHOR_SHARD_BYTES)) - 1).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fp, ch, n = _distinct(*contexts(C.unpack_texts(data.as_py())[1], length)[3:])
                to = _shard_of(fp, shards)
                order = np.argsort(to, kind="stable")
                at = np.searchsorted(to[order], np.arange(shards + 1))
                fp, ch, n = fp[order], ch[order], np.minimum(n, 2).astype(np.uint8)[order]
                cut = [(s, piece, _u8(fp[a:b]), _u8(ch[a:b]), _u8(n[a:b])) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cut, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "piece", "fps", "chs", "times"])

    back = C.materialize(rows.mapInArrow(send, _SENT).groupBy("shard").applyInArrow(lambda t: _compare(t, hot), _BACK))
    asked, held = back.where("kind = 1"), back.where("kind = 2")
    several = asked.agg(F.coalesce(F.sum(F.octet_length("fps")), F.lit(0))).first()[0] // 8
    shards_2 = max(1, several * 180 // SHARD_BYTES)  # what a context has on average, most being joined
    cut = rows.groupBy("piece").cogroup(asked.groupBy("piece")).applyInArrow(lambda d, a: _fetch(d, a, length, shards_2), _CUT)
    found = C.materialize(cut.groupBy("part").applyInArrow(lambda t: _sort_shard(t, length, shards), _BACK))
    shared = held.groupBy("shard").cogroup(found.where("shard is not null").groupBy("shard")).applyInArrow(_tell, _BACK)
    told = found.where("piece is not null").unionByName(shared)
    return rows.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(lambda d, t: _removed(d, t, length), _OUT)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
