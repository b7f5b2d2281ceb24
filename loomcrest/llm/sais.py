"""Suffix arrays by induced sorting, and permuted longest common prefixes, on arrays.

The induction scans buckets in order, as the algorithm does, but takes a whole run of buckets at once as long as none of
its suffixes induces into the run itself; a bucket that feeds itself (runs of one symbol) is taken in rounds. Where buckets
are small (names of substrings, in the recursion), runs would be short, and suffixes are taken one by one. Each suffix is
moved once a pass, so the work stays linear.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S (smaller than the next one); the last suffix, the sentinel, is S."""
    n = len(s)
    out = np.zeros(n, bool)
    out[-1] = True
    if n > 1:
        less, differs = s[:-1] < s[1:], s[:-1] != s[1:]
        # a run of equal symbols has the type of its end
        at = np.where(differs, np.arange(n - 1), n)
        ends = np.minimum.accumulate(at[::-1])[::-1]
        known = ends < n
        out[:-1][known] = less[ends[known]]
    return out


def _place(sa: np.ndarray, pointer: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, forward: bool) -> None:
    """Puts suffixes, in order, at their buckets' pointers, which move on."""
    n = len(symbols)
    if n == 1:
        sa[pointer[symbols[0]]] = suffixes[0]
        pointer[symbols[0]] += 1 if forward else -1
        return
    order = symbols.argsort(kind="stable")
    sym = symbols[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sym[1:], sym[:-1], out=new[1:])
    first = new.nonzero()[0]
    counts = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = n - first[-1]
    rank = np.arange(n) - first.repeat(counts)
    at = pointer[sym]
    sa[at + rank if forward else at - rank] = suffixes[order]
    pointer[sym[first]] += counts if forward else -counts


def _induce(s: np.ndarray, is_s: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, forward: bool) -> None:
    """Induces the L-type suffixes from left to right (forward), or the S-type ones from right to left."""
    buckets = len(starts)
    pointer = starts.copy() if forward else ends - 1
    want = not forward
    step = max(1, int(np.sqrt(buckets)))
    b = 0 if forward else buckets - 1
    width = step
    while 0 <= b < buckets:
        last = min(b + width, buckets) - 1 if forward else max(b - width, -1) + 1
        lo, hi = (starts[b], ends[last]) if forward else (starts[last], ends[b])
        held = sa[lo:hi] if forward else sa[lo:hi][::-1]
        held = held[held > 0] - 1
        held = held[is_s[held] == want]
        symbols = s[held]
        inside = symbols <= last if forward else symbols >= last
        if inside.any():
            nearest = int(symbols[inside].min() if forward else symbols[inside].max())
            if nearest != b:  # stop before the bucket that is fed from here
                last = nearest - 1 if forward else nearest + 1
                width = max(1, abs(last - b) + 1)
                lo, hi = (starts[b], ends[last]) if forward else (starts[last], ends[b])
                held = sa[lo:hi] if forward else sa[lo:hi][::-1]
                held = held[held > 0] - 1
                held = held[is_s[held] == want]
                if len(held):
                    _place(sa, pointer, held, s[held], forward)
                b = last + 1 if forward else last - 1
                continue
            # bucket b feeds itself: its filled part in rounds, then what stands at its other end
            done = starts[b] if forward else ends[b] - 1
            while (done < pointer[b]) if forward else (done > pointer[b]):
                part = sa[done : pointer[b]] if forward else sa[pointer[b] + 1 : done + 1][::-1]
                done = int(pointer[b])
                got = part[part > 0] - 1
                got = got[is_s[got] == want]
                if len(got):
                    _place(sa, pointer, got, s[got], forward)
            part = sa[pointer[b] : ends[b]] if forward else sa[starts[b] : pointer[b] + 1][::-1]
            got = part[part > 0] - 1
            got = got[is_s[got] == want]
            if len(got):
                _place(sa, pointer, got, s[got], forward)
            b = b + 1 if forward else b - 1
            continue
        if len(held):
            _place(sa, pointer, held, symbols, forward)
        b = last + 1 if forward else last - 1
        width = min(buckets, width * 2)


#: Buckets of fewer suffixes than so many, on average, are scanned one suffix at a time.
_SMALL_BUCKET = 8


def _induce_singly(s: np.ndarray, is_s: np.ndarray, sa: np.ndarray, pointer: np.ndarray, forward: bool) -> np.ndarray:
    """As _induce, on lists: the scan itself sees what it has put in."""
    before = np.full(len(s) + 1, -1, np.int64)  # of each suffix, the symbol before it where that one is of the type; last what -1 reads
    wanted = ~is_s if forward else is_s
    before[1:-1][wanted[:-1]] = s[:-1][wanted[:-1]]
    before, held, pointer = before.tolist(), sa.tolist(), pointer.tolist()
    if forward:
        for j in held:
            c = before[j]
            if c >= 0:
                at = pointer[c]
                pointer[c] = at + 1
                held[at] = j - 1
    else:
        for i in range(len(held) - 1, -1, -1):
            j = held[i]
            c = before[j]
            if c >= 0:
                at = pointer[c]
                pointer[c] = at - 1
                held[at] = j - 1
    return np.array(held, sa.dtype)


def _sorted_by_induction(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS suffixes given in order within their buckets (ascending)."""
    sa = np.full(len(s), -1, np.int32 if len(s) < 1 << 31 else np.int64)
    pointer = ends - 1
    _place(sa, pointer, lms[::-1], s[lms[::-1]], forward=False)
    singly = len(starts) * _SMALL_BUCKET > len(s)
    if singly:
        sa = _induce_singly(s, is_s, sa, starts, True)
    else:
        _induce(s, is_s, sa, starts, ends, forward=True)
    # the S part is induced anew from the L part
    keep = sa >= 0
    keep[keep] = ~is_s[sa[keep]]
    keep[0] = True  # the sentinel
    sa[~keep] = -1
    if singly:
        sa = _induce_singly(s, is_s, sa, ends - 1, False)
    else:
        _induce(s, is_s, sa, starts, ends, forward=False)
    sa[0] = len(s) - 1
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of s: non-negative integers of which the last is 0 and no other is."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    counts = np.bincount(s)
    if len(counts) and (counts == 0).any():  # symbols become dense, so buckets are
        s = (np.cumsum(counts > 0) - 1)[s]
        counts = counts[counts > 0]
    if len(counts) == n:
        return np.argsort(s)
    if len(counts) <= 1 << 16:
        s = s.astype(np.uint16)  # which the stable sort takes by digits
    ends = np.cumsum(counts)
    starts = ends - counts
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sa = _sorted_by_induction(s, is_s, lms, starts, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]  # LMS substrings in order
    name_of = _names(s, is_s, lms, order)
    names = name_of[lms]
    if len(names) and names.max() + 1 < len(names):
        ranked = lms[suffix_array(names)]
    else:
        ranked = order
    return _sorted_by_induction(s, is_s, ranked, starts, ends)


def _names(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """At each LMS position the rank of its substring (to the next LMS position, included), equal ones alike."""
    n = len(s)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[length[a[live]] > k]
        if not len(live):
            break
        equal = (s[a[live] + k] == s[b[live] + k]) & (is_s[a[live] + k] == is_s[b[live] + k])
        same[live[~equal]] = False
        live = live[equal]
        k += 1
    out = np.zeros(n, np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~same)))
    return out


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, every: int = 32) -> np.ndarray:
    """Permuted common prefixes: at each position the bytes, at most `most`, shared with the suffix before it in sa.

    A position's value is at least the one before it less one, so only every `every`-th is compared from its first byte.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
    sampled = np.arange(0, n, every)
    cap = most + every
    for at, low, high in ((sampled, None, cap), (np.setdiff1d(np.arange(n), sampled, assume_unique=True), out, most)):
        at = at[phi[at] >= 0]
        done = np.zeros(len(at), np.int64) if low is None else np.maximum(low[at - at % every] - at % every, 0)
        live = np.flatnonzero(done < high)
        while len(live):
            i, j = at[live] + done[live], phi[at[live]] + done[live]
            room = n - np.maximum(i, j)
            ok = room > 0
            x = np.zeros(len(live), np.uint64)
            x[ok] = words[i[ok]] ^ words[j[ok]]
            # equal low bytes before the first that differs
            shared = np.where(x == 0, 8, 0)
            some = x != 0
            if some.any():
                low_bit = x[some] & (~x[some] + np.uint64(1))
                shared[some] = (np.log2(low_bit.astype(np.float64)).astype(np.int64)) // 8
            shared = np.minimum(shared, np.maximum(room, 0))
            done[live] += shared
            live = live[(shared == 8) & (done[live] < high)]
        out[at] = np.minimum(done, high)
    return np.minimum(out, most)
