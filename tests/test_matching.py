"""Sequence matching against the standard library's definition of the scores."""

import difflib
import random

import pytest

from loomcrest.functions import matching, similarity


def pairs():
    g = random.Random(1)
    for k in range(600):
        letters = ("ab", "abcdefghij klmn", [chr(97 + i) for i in range(120)])[k % 3]
        a = g.choices(letters, k=g.choice((0, 1, 5, 30, 150, 260, 400)))
        b = g.choices(letters, k=g.choice((0, 3, 40, 220, 300))) if k % 4 else [c for c in a if g.random() < 0.9] + ["x"] * g.randrange(3)
        yield a, b


@pytest.mark.parametrize("held", [matching.PAIRS, 0])
def test_ratios(monkeypatch, held):
    monkeypatch.setattr(matching, "PAIRS", held)
    for a, b in pairs():
        assert matching.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_diffs():
    for a, b in pairs():
        got = matching.changes(a, b)
        assert got == list(difflib.unified_diff(a, b, lineterm=""))
    assert matching.changes([], ["a"]) == ["--- ", "+++ ", "@@ -0,0 +1 @@", "+a"] and similarity.unified_diff("a\nb", "a\nb") == ""
