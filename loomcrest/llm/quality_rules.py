"""Quality rules as learned decision lists.

Sequential covering over per-document statistics: each rule is a conjunction of thresholds, grown on two thirds of
the labelled sample by information gain and pruned on the rest; the ordered list becomes one Spark conditional
expression. Only the driver-side fit looks at labels, on at most `max_labelled` rows (those of least hash).

Defined results: a null or empty text has no words, fails the base rule and is not kept; rows with null ids or
repeated ids are judged each by its own text; without labels the list is empty and only the base rule rejects; a very
long text is counted whole, in one task; ids of any type and extra columns pass through, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_marks", "n_digits")
#: Ratios are what rules test; counts alone would measure length.
FEATURES = {
    "symbol_ratio": lambda c: c["n_symbols"] / c["n_words"],
    "repeat_ratio": lambda c: c["n_repeat_words"] / c["n_words"],
    "dup_lines": lambda c: c["n_dup_lines"] * 1.0,
    "distinct_ratio": lambda c: c["n_distinct_words"] / c["n_words"],
    "upper_ratio": lambda c: c["n_upper"] / c["word_chars"],
    "mark_ratio": lambda c: c["n_marks"] / c["n_words"],
    "digit_ratio": lambda c: c["n_digits"] / c["word_chars"],
    "mean_word": lambda c: c["word_chars"] / c["n_words"],
    "n_words": lambda c: c["n_words"] * 1.0,
}
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_STATS = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])


def repeated_words(ids: np.ndarray, sizes: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document, the words that lie in a window of `width` words which the document has twice or more. Exact: windows get ranks by doubling."""
    n = len(ids)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if n < width:
        return np.zeros(len(sizes), np.int64)
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    rank, span = ids.astype(np.int64), 1
    while span < width:
        key = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        rank, span = np.unique(key, return_inverse=True)[1], span * 2
    whole = doc[: len(rank)] == doc[width - 1 :]
    start = np.flatnonzero(whole)
    key = doc[start] * (int(rank.max()) + 1) + rank[start]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = start[times[back] > 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(sizes)).astype(np.int64)


def _chunk_stats(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    split = [C.words(t) for t in texts]
    ids, sizes, _ = C.word_ids(split)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    out["n_words"], out["n_repeat_words"] = sizes, repeated_words(ids, sizes)
    for i, (t, ws) in enumerate(zip(texts, split, strict=True)):
        if not ws:
            continue
        joined = b"".join(ws)
        out["word_chars"][i] = len(joined) if joined.isascii() else len(joined.decode())
        out["n_symbols"][i] = len(joined) - len(joined.translate(None, SYMBOLS))
        out["n_upper"][i] = len(joined) - len(joined.translate(None, _UPPER))
        out["n_marks"][i] = joined.count(b"!") + joined.count(b"?")
        out["n_digits"][i] = len(joined) - len(joined.translate(None, _DIGIT))
        out["n_distinct_words"][i] = len(set(ws))
        lines = t.split(b"\n")
        if len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen and line.split():
                    out["n_dup_lines"][i] += 1
                seen.add(line)
    return out


def with_stats(docs: DataFrame, text: str = "text", name: str | None = None) -> tuple[DataFrame, str]:
    """docs with a struct of counts (COUNTS) appended, and that column's name. One pass, no shuffle."""
    name = name or C.fresh(docs, "quality_stats")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([pa.field(c, pa.int64(), False) for c in COUNTS])
        for batch in batches:
            parts = []
            for piece in C.slices([batch.select([place]).rename_columns(["text"])], "text"):
                got = _chunk_stats(C.bytes_column(piece, "text"))
                parts.append(pa.StructArray.from_arrays([pa.array(got[c]) for c in COUNTS], fields=list(kind)))
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(parts)], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, _STATS, False)])
    return docs.mapInArrow(run, schema), name


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) that decides `keep`."""

    tests: tuple[tuple[str, str, float], ...]
    keep: bool

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.tests:
            out &= x[f] > t if op == ">" else x[f] <= t
        return out

    def column(self, counts: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, t in self.tests:
            v = FEATURES[f](counts)
            out = out & ((v > t) if op == ">" else (v <= t))
        return out


def _grow(x: dict, bad: np.ndarray, grid: dict, most: int) -> list[tuple[str, str, float]]:
    """Adds the test of best information gain until no good row is covered."""
    tests: list[tuple[str, str, float]] = []
    live = np.ones(len(bad), bool)
    while len(tests) < most:
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for f, cuts in grid.items():
            v = x[f][live]
            b = bad[live]
            order = np.argsort(v, kind="stable")
            v, cum = v[order], np.concatenate(([0], np.cumsum(b[order])))
            at = np.searchsorted(v, cuts, "right")
            for op, p, n in (("<=", cum[at], at - cum[at]), (">", p0 - cum[at], n0 - (at - cum[at]))):
                ok = p > 0
                gain = np.where(ok, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (f, op, float(cuts[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule((best[1],), False).mask(x)
    return tests


def learn(x: dict[str, np.ndarray], good: np.ndarray, max_rules: int = 12, max_tests: int = 3, min_cover: int = 5, min_precision: float = 0.9, cuts: int = 64) -> list[Rule]:
    """An ordered list of rejecting rules by sequential covering; empty without both classes.

    The list has max_rules rules of max_tests tests at most: that is its size, not a bound on what it reads. A rule stays only if, pruned, it covers min_cover bad rows and is right on min_precision of what it covers in the
    pruning third (when that covers anything) and in the whole sample.
    """
    bad = ~good.astype(bool)
    if not bad.any() or bad.all():
        return []
    grid = {f: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[:-1])) for f, v in x.items()}
    grid = {f: np.unique(np.concatenate((g, np.quantile(x[f][bad], np.linspace(0, 1, cuts + 1))))) for f, g in grid.items()}
    hold = (np.arange(len(bad)) % 3) == 2
    live, rules = np.ones(len(bad), bool), []
    right = lambda m, part: (int((m & bad & part).sum()), int((m & part).sum()))
    for _ in range(max_rules):
        part = live & ~hold
        tests = _grow({f: v[part] for f, v in x.items()}, bad[part], grid, max_tests)
        if not tests:
            break
        options = [tests[: k + 1] for k in range(len(tests))]

        def value(ts: list, part: np.ndarray) -> float:
            p, n = right(Rule(tuple(ts), False).mask(x), part)
            return (2 * p - n) / n if n else -1.0

        chosen = max(options, key=lambda ts: (value(ts, live & hold), -len(ts)))
        if value(chosen, live & hold) < 2 * min_precision - 1:
            chosen = tests
        rule = Rule(tuple(chosen), False)
        p, n = right(rule.mask(x), live)
        hp, hn = right(rule.mask(x), live & hold)
        if p < min_cover or p < min_precision * n or (hn and hp < min_precision * hn):
            break
        rules.append(rule)
        live &= ~rule.mask(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labelled: int = 20_000) -> list[Rule]:
    """Learns from at most max_labelled labelled ids, those of least hash (the documented bound); of an id's rows that with the least counts."""
    few = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null").orderBy(F.xxhash64("i"), "i", "y").limit(max_labelled)
    few = few.groupBy("i").agg(F.min("y").alias("y"))
    some = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(few), "i")
    stats, name = with_stats(some)
    rows = stats.groupBy("i").agg(F.first("y").alias("y"), F.min(name).alias(name)).select(F.xxhash64("i").alias("h"), "i", "y", f"{name}.*").toPandas()
    rows = rows[rows.n_words >= MIN_WORDS].sort_values(["h", "i", *COUNTS], kind="stable")
    if not len(rows):
        return []
    c = {k: rows[k].to_numpy(float) for k in COUNTS}
    return learn({f: make(c) for f, make in FEATURES.items()}, rows.y.to_numpy() > 0)


def base_failed(stats: str) -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)


def verdict(rules: list[Rule], stats: str) -> Column:
    """The list as an ordered conditional: base rule, then each rule, else keep."""
    counts = {c: F.col(f"{stats}.{c}").cast("double") for c in COUNTS}
    out = F.when(base_failed(stats), False)
    for r in rules:
        out = out.when(r.column(counts), F.lit(r.keep))
    return out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> tuple[DataFrame, str, list[Rule]]:
    """docs with a struct column (its name is returned) of the counts, base_failed and kept; and the rules."""
    rules = fit(docs, labels, text, doc_id, **how)
    stats, name = with_stats(docs, text)
    return stats.withColumn(name, F.struct(f"{name}.*", base_failed(name).alias("base_failed"), verdict(rules, name).alias("kept"))), name, rules


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out, s, _ = quality_rules(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", *(F.col(f"{s}.{c}").alias(c) for c in (*COUNTS[:5], "base_failed", "kept", *COUNTS[5:])))
