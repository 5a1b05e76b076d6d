"""Likeness of texts against difflib's own ratio, with blocks found by difflib and by hashes."""

import difflib
import random

import pytest

from quillwork.functions import likeness
from quillwork.operators import quality


def changed(rng, text, letters, share):
    """The text with letters left out, put in and put anew, and sometimes its halves swapped."""
    out = "".join(rng.choice(("", rng.choice(letters), c + rng.choice(letters))) if rng.random() < share else c for c in text)
    cut = rng.randrange(len(out) + 1)
    return out[cut:] + out[:cut] if rng.random() < 0.3 else out


@pytest.mark.parametrize("small", [0, 40_000])
def test_as_difflib(monkeypatch, small):
    monkeypatch.setattr(likeness, "SMALL", small)
    rng = random.Random(small)
    for _ in range(500):
        letters = rng.choice(("ab", "abc", "abcdefghij ", "ğüşiöç\U0001f600ab"))
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        b = changed(rng, a, letters, rng.random() * 0.6)
        match = difflib.SequenceMatcher(None, a, b, autojunk=False)
        for least in (0.5, 0.85, match.ratio()):
            assert likeness.alike(a, b, least) == (match.ratio() >= least)
        if a and b:
            found, block = likeness.longest_block(a, b), match.find_longest_match(0, len(a), 0, len(b))
            assert found == tuple(block) or found[2] == block.size == 0


def test_long_paragraphs_are_settled_without_difflib(spark, monkeypatch):
    """difflib takes the product of the lengths; 40 000 letters said twice, and 40 000 that share nothing in order."""
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda: " ".join(rng.choice(words) for _ in range(7000))
    a, b = text(), text()
    with monkeypatch.context() as m:
        m.setattr(difflib, "SequenceMatcher", None)
        assert likeness.alike(a, a + " yine", 0.85) and not likeness.alike(a, b, 0.85)
        assert likeness.alike(a, a[:9000] + "x" + a[9000:30_000] + a[30_010:], 0.85)
    rows = [(1, 1, 0, a, a), (1, 1, 1, b, a + " yine"), (1, 1, 2, b + " x", b)]
    got = quality.repeated_paragraphs(spark.createDataFrame(rows, "book long, chapter_no long, para long, en string, tr string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1)]
