"""Toxicity by weak supervision.

Voters are words and word stems of a lexicon mined from labelled training rows, and patterns (shouting, exclamations,
marks in a row, two and three lexicon words at once). A generative label model
learns by expectation-maximisation how often each voter fires in either class, and how strongly voters fire together
beyond that: voters correlated within a class share one vote. A linear classifier is then fitted to the model's
posterior labels. Only mining sees the labels, and only those of training folds.

The fit uses at most `max_labelled` labelled rows, those of least hash (the documented bound); word counts of the
sample are summed in Spark, and the driver gets every word and stem of enough support and precision and one small row a
sampled document: the numbers of the voters that fire there. Nothing is held for each pair of voters. Scoring is one
pass over all texts without a shuffle.

Defined results: null and empty texts fire no voter and get the score of none; repeated rows score alike; without
labels of both classes every score is the share of toxic labels (0 without any). Ids are read as long; an id's rows count
once in the fit; a very long text is scored whole, in one task; other columns are not looked at, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

FOLDS, HELD_OUT = 3, 1
#: Stems are the first so many bytes of a word; b"4abcd" is a stem as a voter, b"=word" a word.
STEMS = (4, 5, 6, 7)
PATTERNS = ("two_words", "three_words", "two_stems", "shouting", "exclaims", "mark_runs")
_UPPER = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _seen(text: bytes) -> set[bytes]:
    """The different words in lower case, without ASCII marks at their ends."""
    return {w.strip(_MARKS) for w in text.decode("utf-8", "replace").lower().encode().split()}


def _marks(text: bytes | None) -> set[bytes]:
    """The different words of a text, lower-cased, and their stems, as voters are named."""
    seen = _seen(text) if text else set()
    out = {b"=" + w for w in seen}
    for k in STEMS:
        head = b"%d" % k
        out |= {head + w[:k] for w in seen if len(w) > k}
    return out


@dataclass
class Voters:
    """Lexicon words and stems by number; behind them the patterns."""

    lexicon: dict[bytes, int]

    def __post_init__(self):
        self.words = {m[1:] for m in self.lexicon if m[:1] == b"="}
        self.stems = {k: {m[1:] for m in self.lexicon if m[:1] == b"%d" % k} for k in STEMS}

    @property
    def size(self) -> int:
        return len(self.lexicon) + len(PATTERNS)

    def votes(self, text: bytes | None) -> list[int]:
        """Numbers of the voters that fire for toxic; the others abstain."""
        if not text:
            return []
        seen = _seen(text)
        words, stemmed, out = self.words & seen, 0, []
        for k in STEMS:
            if self.stems[k]:
                found = {w for w in seen if w[:k] in self.stems[k] and len(w) > k}
                stemmed = max(stemmed, len(found))
                out += {self.lexicon[b"%d" % k + w[:k]] for w in found}
        out += [self.lexicon[b"=" + w] for w in words]
        upper = len(text) - len(text.translate(None, _UPPER))
        fired = (len(words) > 1, len(words) > 2, stemmed > 1, upper * 2 > len(text), text.count(b"!") * 20 > len(seen) + 19, b"!!!" in text or b"???" in text)
        return sorted(out) + [len(self.lexicon) + i for i, f in enumerate(fired) if f]


@dataclass
class Votes:
    """Which voters fire for which row, as lists: voters `at`, row after row, each row's `size` of them."""

    at: np.ndarray
    size: np.ndarray
    voters: int

    @classmethod
    def of(cls, lists: list, voters: int) -> Votes:
        return cls(np.concatenate([np.asarray(v, np.int64) for v in lists] or [np.zeros(0, np.int64)]), np.array([len(v) for v in lists], np.int64), voters)

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.size)), self.size)

    def times(self, w: np.ndarray) -> np.ndarray:
        """A number a row: the sum of its voters' weights."""
        return np.bincount(self.row, w[self.at], len(self.size))

    def summed(self, by_row: np.ndarray) -> np.ndarray:
        """A number a voter: the sum over the rows where it fires."""
        return np.bincount(self.at, by_row[self.row], self.voters)


def correlated_with(votes: Votes, post: np.ndarray, on: np.ndarray, least: float) -> np.ndarray:
    """For each voter how many voters, itself included, have a residual correlation above `least` with it under the present classes.

    A voter's residual in a row is its vote less what the row's classes let expect, which has rank two: so a pair's sum of
    products follows from how often both fire and from sums a voter. Pairs that never fire together have none above 0 and
    are not looked at; one voter's pairs are held at a time.
    """
    n, m = len(votes.size), votes.voters
    clean, toxic = votes.summed(1 - post), votes.summed(post)
    s00, s01, s11 = float(((1 - post) ** 2).sum()), float((post * (1 - post)).sum()), float((post**2).sum())

    def products(i: int, j: np.ndarray, both: np.ndarray) -> np.ndarray:
        cross = on[0][j] * clean[i] + on[1][j] * toxic[i] + on[0][i] * clean[j] + on[1][i] * toxic[j]
        return both - cross + on[0][i] * on[0][j] * s00 + (on[0][i] * on[1][j] + on[1][i] * on[0][j]) * s01 + on[1][i] * on[1][j] * s11

    fires = np.bincount(votes.at, minlength=m)
    own = np.array([products(i, np.array([i]), fires[i : i + 1])[0] for i in range(m)]) if m else np.zeros(0)
    scale = np.sqrt(np.maximum(own, 0) / n) + 1e-9
    first = np.concatenate(([0], np.cumsum(votes.size)))
    order = np.argsort(votes.at, kind="stable")
    rows_of, ends = votes.row[order], np.concatenate(([0], np.cumsum(fires)))
    out = np.ones(m)
    for i in range(m):
        rows = rows_of[ends[i] : ends[i + 1]]
        if not len(rows):
            continue
        sizes = votes.size[rows]
        places = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[rows], sizes)
        j, both = np.unique(votes.at[places], return_counts=True)
        corr = products(i, j, both) / n / scale[i] / scale[j]
        out[i] = max(1, int((corr > least).sum()))
    return out


def label_model(votes: Votes, prior: float, rounds: int = 50, correlated: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """EM for P(voter fires | class); returns the posterior of class 1 of each row and each voter's weight.

    A voter's weight is one over the number of voters that it is correlated with inside the classes, itself included.
    """
    n, m = len(votes.size), votes.voters
    post = np.where(votes.size >= 2, 0.95, np.where(votes.size == 1, 0.3, 0.02))
    weight = np.ones(m)
    for k in range(rounds):
        fired = np.stack([votes.summed(1 - post), votes.summed(post)])
        on = (fired + 0.1) / np.array([[(1 - post).sum() + 1], [post.sum() + 1]])
        if k in (5, 20):
            weight = 1 / correlated_with(votes, post, on, correlated)
        odds = np.maximum(weight * (np.log(on[1]) - np.log(on[0])), 0)  # voters vote for toxic or abstain
        none = weight * np.log((1 - on[1]) / (1 - on[0]))  # what abstaining says, jointly bounded
        logit = np.log(prior / (1 - prior)) + votes.times(odds) + np.maximum(none.sum() - votes.times(none), -4)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            post = new
            break
        post = new
    return post, weight


def _solved(product, right: np.ndarray, scale: np.ndarray, most: int = 1000) -> np.ndarray:
    """x with product(x) = right, by conjugate gradients with a diagonal preconditioner."""
    x = np.zeros_like(right)
    r = right.copy()
    z = r / scale
    p, rz = z.copy(), float(r @ z)
    for _ in range(most):
        if np.abs(r).max(initial=0) < 1e-10:
            break
        q = product(p)
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        z = r / scale
        rz, before = float(r @ z), rz
        p = z + (rz / before) * p
    return x


def fit_linear(votes: Votes, y: np.ndarray, l2: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, each solved without a matrix; the last weight is the intercept, free of the penalty."""
    m = votes.voters
    w, penalty = np.zeros(m + 1), np.append(np.full(m, l2), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(votes.times(w[:-1]) + w[-1], -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        g = penalty * w + np.append(votes.summed(p - y), (p - y).sum())

        def product(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            hx = h * (votes.times(x[:-1]) + x[-1])
            return penalty * x + np.append(votes.summed(hx), hx.sum())

        step = _solved(product, g, penalty + np.append(votes.summed(h), h.sum()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray  # a weight a voter, then the intercept

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-min(30, max(-30, self.weights[-1] + self.weights[self.voters.votes(t)].sum())))) for t in texts], float)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = 20_000, least_support: int = 4, stem_support: int = 3, least_precision: float = 0.9) -> Model:
    few = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & (C.fold_of("i", FOLDS) != HELD_OUT))
    few = few.orderBy(F.xxhash64("i"), "i", "y").limit(max_labelled).groupBy("i").agg(F.max("y").alias("y"))
    some = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(few), "i").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "i")
    one = some.groupBy("i").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))  # of an id's rows that of least hash
    sample = C.materialize(one.select("i", "t.text", "y"))
    n = sample.groupBy("y").count().collect()
    n = {r.y > 0: r["count"] for r in n}
    if len(n) < 2:
        return Model(Voters({}), np.array([0.0] * len(PATTERNS) + [30.0 if True in n else -30.0]))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text"):
            by: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
            for y, t in zip(piece.column(0).to_pylist(), C.bytes_column(piece, "text"), strict=True):
                for w in _marks(t):
                    by[w][y > 0] += 1
            if by:
                clean, toxic = zip(*by.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.binary()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["w", "clean", "toxic"])

    table = sample.select("y", "text").mapInArrow(counts, "w binary, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon = table.where(f"toxic >= if(w >= binary('=') and w < binary('>'), {least_support}, {stem_support}) and toxic >= {least_precision} * (toxic + clean)").orderBy(F.desc("toxic"), "w").collect()
    voters = Voters({bytes(r.w): k for k, r in enumerate(lexicon)})

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([voters.votes(t) for t in C.bytes_column(piece, "text")], pa.list_(pa.int32()))], ["i", "v"])

    rows = sample.select("i", "text").mapInArrow(votes, "i long, v array<int>").toPandas().sort_values("i", kind="stable")
    x = Votes.of(list(rows.v), voters.size)
    post, _ = label_model(x, n[True] / (n[True] + n[False]))
    return Model(voters, fit_linear(x, post))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.scores(C.bytes_column(piece, "text")))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", (C.fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
