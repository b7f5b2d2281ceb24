"""Quality classifier: a generalised additive model with pairwise interactions over statistics of whole texts.

Each feature is cut into bins. Cyclic boosting takes the features in turn, over and over, and adds a small step of a
shallow tree (three leaves) to that feature's lookup table; then the pairs whose best four quadrants explain most of what
is left get tables of their own, boosted in the same way with trees of two levels. The number of rounds is that of least
loss on a fifth of the sample; the tables are then learned from all of it. Scoring looks bins up and adds: no tree is
left. Only the fit looks at labels, on at most `max_labelled` ids (those of least hash, the documented bound).

Defined results: a null or empty text has features of 0 and is scored by them; rows with null or repeated ids are scored
each by its own text; of an id's labels the least counts, of its texts the one of least features; without both classes
every score is the share of good labels, smoothed (none: 0.5); a very long text is read whole, in one task; an empty
table gives no rows; ids that are no whole numbers become null; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import quality_rules as Q

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Of texts, besides the ratios that quality_rules has.
EXTRA = ("stops", "commas", "line_words", "short_words", "long_words", "top_word", "alone", "non_ascii", "same_lines")
NAMES = (*Q.FEATURES, *EXTRA)
_STOPS, _COMMAS = b".!?", b",;:"


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of NAMES a text."""
    stats = {c: v.astype(np.float64) for c, v in Q._chunk_stats(texts).items()}
    n = stats["n_words"]
    safe = stats | {"n_words": np.maximum(n, 1), "word_chars": np.maximum(stats["word_chars"], 1)}
    out = np.zeros((len(texts), len(NAMES)))
    for k, make in enumerate(Q.FEATURES.values()):
        out[:, k] = make(safe) * (n > 0)
    for i, t in enumerate(texts):
        if not (ws := C.words(t)):
            continue
        joined, m = b"".join(ws), len(ws)
        sizes = np.fromiter(map(len, ws), np.int64, m)
        times = np.fromiter(Counter(ws).values(), np.int64)
        lines = [x for x in t.split(b"\n") if x.split()]
        out[i, len(Q.FEATURES) :] = (
            (len(joined) - len(joined.translate(None, _STOPS))) / m,
            (len(joined) - len(joined.translate(None, _COMMAS))) / m,
            m / len(lines),
            (sizes <= 2).mean(),
            (sizes > 12).mean(),
            times.max() / m,
            (times == 1).sum() / m,
            1 - len(joined.decode("utf-8", "replace").encode("ascii", "ignore")) / len(joined),
            1 - len(set(lines)) / len(lines),
        )
    return out


def _leaf(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g / (h + l2)


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, l2: float) -> np.ndarray:
    """A step a bin: the leaf values of a tree of cuts between bins, the best cut first. g, h, n: gradients, curvatures and rows a bin."""
    parts = [(0, len(g))]
    cg, ch, cn = (np.concatenate(([0], np.cumsum(x))) for x in (g, h, n))
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(parts):
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            left, right = (cg[cut] - cg[a], ch[cut] - ch[a]), (cg[b] - cg[cut], ch[b] - ch[cut])
            gain = _gain(*left, l2) + _gain(*right, l2) - _gain(cg[b] - cg[a], ch[b] - ch[a], l2)
            gain[(cn[cut] - cn[a] < least) | (cn[b] - cn[cut] < least)] = -1
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), k, int(cut[j]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], l2)
    return out


def _corner(x: np.ndarray) -> np.ndarray:
    """Sums of all rows before and columns before, with a border of 0."""
    return np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, l2: float) -> tuple[np.ndarray, float]:
    """A step a cell of a tree of two levels, and its gain: a cut of the first feature, then one of the second on either side (or the other way round, whichever gains more)."""
    best, step = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        cg, ch, cn = _corner(a), _corner(b), _corner(c)
        if a.shape[0] < 2 or a.shape[1] < 2:
            continue
        sides = []
        for low in (True, False):  # the rows before a cut, or those from it
            rows = slice(1, -1)
            eg, eh, en = ((x[rows] if low else x[-1] - x[rows]) for x in (cg, ch, cn))
            left, right = (eg[:, 1:-1], eh[:, 1:-1]), (eg[:, -1:] - eg[:, 1:-1], eh[:, -1:] - eh[:, 1:-1])
            gain = _gain(*left, l2) + _gain(*right, l2)
            gain[(en[:, 1:-1] < least) | (en[:, -1:] - en[:, 1:-1] < least)] = -1
            sides.append((gain.max(1), gain.argmax(1) + 1, eg, eh))
        total = np.where((sides[0][0] < 0) | (sides[1][0] < 0), -1, sides[0][0] + sides[1][0]) - _gain(cg[-1, -1], ch[-1, -1], l2)
        k = int(np.argmax(total))
        if total[k] > best + 1e-9:
            best, step = float(total[k]), np.zeros(a.shape)
            for (_, cut, eg, eh), rows in zip(sides, (slice(0, k + 1), slice(k + 1, None)), strict=True):
                at = int(cut[k])
                step[rows, :at] = _leaf(eg[k, at], eh[k, at], l2)
                step[rows, at:] = _leaf(eg[k, -1] - eg[k, at], eh[k, -1] - eh[k, at], l2)
            step = step.T if turned else step
    return step, best


@dataclass
class Model:
    """Cuts and a table a feature; pairs' tables over coarser cuts."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    wide: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray, coarse: bool = False) -> np.ndarray:
        cuts = self.wide if coarse else self.cuts
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1) if cuts else np.zeros((len(x), 0), np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        fine = self.bins(x)
        for k, t in enumerate(self.tables):
            out += t[fine[:, k]]
        if self.pairs:
            coarse = self.bins(x, True)
            for (a, b), t in self.pairs.items():
                out += t[coarse[:, a], coarse[:, b]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _loss(y: np.ndarray, logit: np.ndarray) -> float:
    return float(np.logaddexp(0, logit).mean() - (y * logit).mean()) if len(y) else 0.0


def _boost(model: Model, x: np.ndarray, y: np.ndarray, rounds: int, on: list, rate: float, least: int, l2: float, check: tuple | None) -> int:
    """Cyclic rounds over features or pairs; returns the rounds of least loss on `check` (x, y), or all."""
    paired = bool(on) and isinstance(on[0], tuple)
    tables = model.pairs if paired else model.tables
    own = model.bins(x, paired)
    shapes = {k: tables[k].shape for k in on}
    flat = {k: np.ravel_multi_index((own[:, k[0]], own[:, k[1]]), shapes[k]) if paired else own[:, k] for k in on}
    rows = {k: np.bincount(flat[k], minlength=tables[k].size).reshape(shapes[k]) for k in on}
    logit = model.logits(x)
    best, best_at = np.inf, 0
    if check:
        cb, c_logit = model.bins(check[0], paired), model.logits(check[0])
        best = _loss(check[1], c_logit)
    for r in range(rounds):
        for k in on:
            p = 1 / (1 + np.exp(-logit))
            g, h = (np.bincount(flat[k], v, tables[k].size).reshape(shapes[k]) for v in (y - p, p * (1 - p)))
            step = rate * (pair_tree(g, h, rows[k], least, l2)[0] if paired else shallow_tree(g, h, rows[k], 3, least, l2))
            tables[k] += step
            logit += step.ravel()[flat[k]]
            if check:
                c_logit += step[cb[:, k[0]], cb[:, k[1]]] if paired else step[cb[:, k]]
        if check:
            now = _loss(check[1], c_logit)
            if now < best - 1e-6:
                best, best_at = now, r + 1
            elif r - best_at > 30:
                break
    return best_at if check else rounds


def _learned(x: np.ndarray, y: np.ndarray, rounds: int, pair_rounds: int, pairs: list | None, check: tuple | None, how: dict) -> tuple[Model, int, int, list]:
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = [[np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1], method="lower")) for v in x.T] for n in (how["bins"], how["pair_bins"])]
    model = Model(float(np.log(share / (1 - share))), cuts[0], [np.zeros(len(c) + 1) for c in cuts[0]], cuts[1])
    kw = {k: how[k] for k in ("rate", "least", "l2")}

    def steady(on: list, most: int) -> int:
        """Boosts; where `check` says that fewer rounds are better, starts again with those."""
        kept = [t.copy() for t in model.tables], {k: t.copy() for k, t in model.pairs.items()}
        used = _boost(model, x, y, most, on, check=check, **kw)
        if check:
            model.tables, model.pairs = kept
            _boost(model, x, y, used, on, check=None, **kw)
        return used

    used = steady(list(range(x.shape[1])), rounds)
    if pairs is None:
        coarse, logit = model.bins(x, True), model.logits(x)
        p = 1 / (1 + np.exp(-logit))
        gains = []
        for a, b in combinations(range(x.shape[1]), 2):
            shape = len(model.wide[a]) + 1, len(model.wide[b]) + 1
            at = np.ravel_multi_index((coarse[:, a], coarse[:, b]), shape)
            g, h, n = (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p), None))
            gains.append((pair_tree(g, h, n, how["least"], how["l2"])[1], (a, b)))
        pairs = [k for gain, k in sorted(gains, key=lambda x: (-x[0], x[1]))[: how["max_pairs"]] if gain > 0]
    model.pairs = {(a, b): np.zeros((len(model.wide[a]) + 1, len(model.wide[b]) + 1)) for a, b in pairs}
    pair_used = steady(pairs, pair_rounds) if pairs else 0
    return model, used, pair_used, pairs


def learn(x: np.ndarray, y: np.ndarray, rounds: int = 300, pair_rounds: int = 150, bins: int = 64, pair_bins: int = 12, max_pairs: int = 10, rate: float = 0.1, least: int = 4, l2: float = 1.0) -> Model:
    """The model of a sample; rows come in an order that has nothing to do with labels."""
    how = {"bins": bins, "pair_bins": pair_bins, "max_pairs": max_pairs, "rate": rate, "least": least, "l2": l2}
    y = y.astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))))
    check = np.arange(len(y)) % 5 == 4
    _, used, pair_used, pairs = _learned(x[~check], y[~check], rounds, pair_rounds, None, (x[check], y[check]), how)
    return _learned(x, y, used, pair_used, pairs, None, how)[0]


def _featured(df: DataFrame) -> DataFrame:
    """Rows (i, text) to (i, f: NAMES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text"):
            x = features(C.bytes_column(piece, "text"))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["i", "f"])

    return df.mapInArrow(run, "i long, f array<double>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labelled: int = 20_000, **how) -> Model:
    """Learns from the labelled ids outside the held-out fold, at most max_labelled of them, those of least hash."""
    few = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & (C.fold_of("i", FOLDS) != HELD_OUT))
    few = few.groupBy("i").agg(F.min("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    some = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("text")).join(F.broadcast(few.select("i")), "i", "left_semi")
    one = _featured(some).groupBy("i").agg(F.min("f").alias("f"))
    rows = one.join(F.broadcast(few), "i").select("i", F.xxhash64("i").alias("h"), "f", "y").toPandas().sort_values(["h", "i"], kind="stable")
    return learn(np.stack(rows.f) if len(rows) else np.zeros((0, len(NAMES))), rows.y.to_numpy() > 0, **how)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score of every row of docs. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.scores(features(C.bytes_column(piece, "text"))))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def op12_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", (C.fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
