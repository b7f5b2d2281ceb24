"""How much two sequences share: the longest common run, then the same on either side of it, and so on.

Elements that make up more than a hundredth of a second sequence of 200 or more begin no run (they may lengthen one), so
long texts are compared by what is rare in them. Of equally long runs the one that begins first in the first sequence
counts, then first in the second. Scores of similarity are defined by this matching; it works on integer
codes and rows of run lengths.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: From this length on elements of over a hundredth (and one) begin no run.
LONG = 200


class _Second:
    """The second sequence: the places of each element that may begin a run."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        most = len(codes) // 100 + 1 if len(codes) >= LONG else len(codes)
        self.places = {int(codes[p[0]]): p for p in np.split(order, cuts) if 0 < len(p) <= most}
        self.rows = np.zeros((2, len(codes) + 1), np.int32)  # by place + 1: the run that ends there, for the row before and for this one

    def longest(self, a: list[int], a_from: int, a_to: int, b_from: int, b_to: int) -> tuple[int, int, int]:
        """(begin in a, begin in b, length) of the longest run that starts with elements that may begin one."""
        best, last, this = (a_from, b_from, 0), self.rows[0], self.rows[1]
        touched = touched_before = None
        for i in range(a_from, a_to):
            js = self.places.get(a[i])
            if js is not None:
                if b_from or b_to < len(self.codes):
                    js = js[np.searchsorted(js, b_from) : np.searchsorted(js, b_to)]
                runs = last[js] + 1
                this[js + 1] = runs
                if len(runs) and (top := int(runs.max())) > best[2]:
                    j = int(js[runs.argmax()])
                    best = (i - top + 1, j - top + 1, top)
            if touched_before is not None:
                last[touched_before + 1] = 0
            touched, touched_before = None, js
            last, this = this, last
        for row, js in ((last, touched_before), (this, touched)):
            if js is not None:
                row[js + 1] = 0
        return best


class _Pairs:
    """Places of equal elements, diagonal by diagonal: a run is a piece of a diagonal without a gap."""

    def __init__(self, a: np.ndarray, b: np.ndarray, places: dict[int, np.ndarray]):
        none = np.zeros(0, np.int64)
        by = [places.get(x, none) for x in a.tolist()]
        i, j = np.repeat(np.arange(len(a)), [len(p) for p in by]), np.concatenate([*by, none])
        order = np.lexsort((i, j - i))
        self.whole = i[order], j[order]

    @staticmethod
    def cut(pairs: tuple, a_from: int, a_to: int, b_from: int, b_to: int) -> tuple:
        i, j = pairs
        on = (i >= a_from) & (i < a_to) & (j >= b_from) & (j < b_to)
        return i[on], j[on]

    @staticmethod
    def longest(pairs: tuple, a_from: int, b_from: int) -> tuple[int, int, int]:
        i, j = pairs
        if not len(i):
            return a_from, b_from, 0
        start = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1))))
        size = np.diff(np.append(start, len(i)))
        top = start[size == size.max()]
        first = top[np.lexsort((j[top], i[top]))[0]]
        return int(i[first]), int(j[first]), int(size.max())


#: Up to so many pairs of equal elements are held at once; beyond it runs are followed row by row.
PAIRS = 2_000_000


def blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(begin in a, begin in b, length) of the matching's runs, in order."""
    code: dict = {}
    x, y = ([code.setdefault(e, len(code)) for e in s] for s in (a, b))
    if not x or not y:
        return []
    second = _Second(np.array(y))
    few = sum(len(second.places.get(e, ())) for e in x) <= PAIRS
    pairs = _Pairs(np.array(x), second.codes, second.places).whole if few else None
    out, todo = [], [(0, len(x), 0, len(y), pairs)]
    while todo:
        a_from, a_to, b_from, b_to, own = todo.pop()
        if few:
            own = _Pairs.cut(own, a_from, a_to, b_from, b_to)
            i, j, n = _Pairs.longest(own, a_from, b_from)
        else:
            i, j, n = second.longest(x, a_from, a_to, b_from, b_to)
        while i > a_from and j > b_from and x[i - 1] == y[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < a_to and j + n < b_to and x[i + n] == y[j + n]:
            n += 1
        if n:
            out.append((i, j, n))
            if a_from < i and b_from < j:
                todo.append((a_from, i, b_from, j, own))
            if i + n < a_to and j + n < b_to:
                todo.append((i + n, a_to, j + n, b_to, own))
    return sorted(out)


def shared(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """How many elements the matching pairs."""
    return sum(n for *_, n in blocks(a, b))


def changes(a: list[str], b: list[str], around: int = 3) -> list[str]:
    """A unified diff of two lists of lines: hunks of removed and added lines with `around` equal ones at either side; nothing for equal lists."""
    edits, i, j = [], 0, 0  # (from and to in a, from and to in b) of what differs
    for p, q, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < p or j < q:
            edits.append((i, p, j, q))
        i, j = p + n, q + n
    hunks: list[list[tuple]] = []
    for e in edits:
        if hunks and e[0] - hunks[-1][-1][1] <= 2 * around:
            hunks[-1].append(e)
        else:
            hunks.append([e])
    span = lambda begin, end: f"{begin + 1}" if end - begin == 1 else f"{begin + (end > begin)},{end - begin}"
    out = ["--- ", "+++ "] if hunks else []
    for hunk in hunks:
        before, behind = min(around, hunk[0][0]), min(around, len(a) - hunk[-1][1])
        a_at, a_end, b_at, b_end = hunk[0][0] - before, hunk[-1][1] + behind, hunk[0][2] - before, hunk[-1][3] + behind
        out.append(f"@@ -{span(a_at, a_end)} +{span(b_at, b_end)} @@")
        for p, q, r, s in hunk:
            out += [f" {x}" for x in a[a_at:p]] + [f"-{x}" for x in a[p:q]] + [f"+{x}" for x in b[r:s]]
            a_at = q
        out += [f" {x}" for x in a[a_at:a_end]]
    return out


def ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """Twice the shared elements over all; 1 for two empty sequences."""
    size = len(a) + len(b)
    return 2 * shared(a, b) / size if size else 1.0
