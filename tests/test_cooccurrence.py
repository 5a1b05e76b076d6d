"""Pairs that meet in places against all pairs, with places that make none."""

import random
from itertools import combinations

import pytest

from quillwork.operators.graph import missing_links


@pytest.mark.parametrize(("at_least", "heavy"), [(1, 0), (2, 0), (2, 3), (3, 0), (3, 5), (4, 2), (2, 500)])
def test_all_pairs(spark, at_least, heavy):
    rng = random.Random(at_least * 10 + heavy)
    rows = {(rng.choice("xy"), rng.choice(["big", "large", "p1", "p2", "p3", "p4", "p5"]), f"n{rng.randrange(14):02}") for _ in range(90)}
    rows |= {(book, "big", f"n{i:02}") for i in range(14) for book in "xy"}
    edges = [("x", "n03", "n01"), ("y", "n00", "n13")]
    found = missing_links(spark.createDataFrame([*rows, *rows], "book string, place string, node string"), spark.createDataFrame(edges, "book string, src string, dst string"), at_least, heavy)
    tied = {(b, *sorted(e)) for b, *e in edges}
    together = {}
    for book, place in {r[:2] for r in rows}:
        for a, b in combinations(sorted(n for k, p, n in rows if (k, p) == (book, place)), 2):
            together[book, a, b] = together.get((book, a, b), 0) + 1
    assert {(r.book, r.a, r.b): r.places for r in found.collect()} == {k: n for k, n in together.items() if n >= at_least and k not in tied}


def test_a_very_large_place(spark):
    """A hundred thousand entities of one place, few of which meet elsewhere: their pairs there are never made."""
    everyone = spark.range(100_000).selectExpr("'x' AS book", "'fair' AS place", "CAST(id AS STRING) AS node")
    twos = spark.range(100_000).selectExpr("'x' AS book", "concat('room ', floor(id / 2)) AS place", "CAST(id AS STRING) AS node")
    found = missing_links(everyone.unionByName(twos), spark.createDataFrame([], "book string, src string, dst string"))
    assert found.count() == 50_000 and {r.places for r in found.select("places").distinct().collect()} == {2}
