"""Similarities and evaluation metrics. Sequence matching and BLEU run as pandas UDFs on paired rows only."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .matching import LONG, changes, ratio
from .text import strip_comments


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k); 0 where n < k, 1 where all are correct."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(n - c - i, F.lit(0)).cast("double") / (n - i))
    return F.when(n < k, 0.0).when(c >= n, 1.0).otherwise(1 - miss)


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def bleu(reference: list[str], candidate: list[str], epsilon: float = 0.1) -> float:
    """Sentence BLEU-4 of token lists; zero counts are smoothed by epsilon."""
    if not candidate or not reference:
        return 0.0
    if len(candidate) > 3 and candidate == reference:
        return 1.0  # every count is met
    if set(candidate).isdisjoint(reference):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        have = Counter(tuple(candidate[i : i + n]) for i in range(len(candidate) - n + 1))
        want = Counter(tuple(reference[i : i + n]) for i in range(len(reference) - n + 1))
        hit, all_ = sum((have & want).values()), max(1, sum(have.values()))
        if n == 1 and not hit:
            return 0.0
        total += math.log((hit or epsilon) / all_) / 4
    short = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return short * math.exp(total)


def edit_ratio(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.0
    if len(a) < LONG and a == b:
        return 1.0  # one run; in longer lists frequent elements begin none
    return 0.0 if set(a).isdisjoint(b) else ratio(a, b)


def visible(text: str) -> str:
    """Lines stripped, blank ones dropped."""
    return "\n".join(x for x in (line.strip() for line in (text or "").splitlines()) if x)


def text_ratio(a: str, b: str) -> float:
    a, b = visible(a), visible(b)
    return 1.0 if not a and not b else ratio(a, b) if a and b else 0.0


@F.pandas_udf(DoubleType())
def _bleu(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bleu((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_ratio((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _text(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([text_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _ops(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(list(x), list(y)) if x is not None and y is not None and len(x) and len(y) else None for x, y in zip(a, b, strict=True)], dtype="Float64").astype(float)


def bleu_score(reference: Column, candidate: Column) -> Column:
    return _bleu(strip_comments(reference), strip_comments(candidate))


def edit_similarity(reference: Column, candidate: Column) -> Column:
    """Sequence-matcher ratio of comment-free tokens; 0 where either is empty."""
    return _edit(strip_comments(reference), strip_comments(candidate))


def text_similarity(a: Column, b: Column) -> Column:
    return _text(a, b)


def operation_similarity(a: Column, b: Column) -> Column:
    """Ratio of operation-name lists; null unless both have some."""
    return _ops(a, b)


def unified_diff(a: str, b: str) -> str:
    """What changes from a to b, as hunks of lines; the empty text for equal ones."""
    return "\n".join(changes((a or "").splitlines(), (b or "").splitlines()))


@F.pandas_udf(StringType())
def _diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified_diff(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def diff(a: Column, b: Column) -> Column:
    """unified_diff as a Column."""
    return _diff(a, b)


def cost(compiled: Column, issues: Column, too_similar: Column, penalty: float = 1.0, passed: Column | None = None) -> Column:
    """5 where it does not compile, the issues (at least 1) where a tool fails, else 0; plus a penalty for too similar candidates. Without `passed` a tool fails where there are issues."""
    fails = issues > 0 if passed is None else ~passed
    return F.when(~compiled, 5.0).when(fails, F.greatest(F.lit(1), issues).cast("double")).otherwise(0.0) + F.when(too_similar, penalty).otherwise(0.0)


def reward(compiled: Column, passed: Column, cosine: Column, char_ratio: Column, divergence: Column, weights: tuple[float, ...] = (0.8, 0.3, 0.2), full: float = 1.0, partial: float = 0.1, beta: float = 0.02) -> Column:
    """weights: of compiling, of the functions' closeness, of their difference in characters; `full` where the tools pass as well, `partial` where it only compiles; less beta times the divergence a token."""
    w_stmt, w_embed, w_edit = weights
    verified = F.when(compiled & passed, full).when(compiled, partial).otherwise(0.0)
    return w_stmt * compiled.cast("double") + w_embed * cosine - w_edit * (1 - char_ratio) + verified - beta * divergence


def success(compiled: Column, passed: Column) -> Column:
    return (compiled & passed).cast("int")


def correct(compiles: Column, clean: Column, original_similarity: Column, most_similar: float, change: Column, most_change: float) -> Column:
    """The parallel evaluator's rule: builds, passes the tools, differs from the original, and changes little."""
    return F.coalesce(compiles & clean & (original_similarity < most_similar) & change.isNotNull() & (change <= most_change), F.lit(False))
