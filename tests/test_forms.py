"""Dictionaries larger than one index: every text is read once for its book, whatever the number of terms."""

import random

import pytest

from pyspark.sql import functions as F

from quillwork.functions import forms
from quillwork.operators import matching


@pytest.mark.parametrize("chars", [10**9, 200])
def test_dealt_as_one_index(spark, monkeypatch, chars):
    monkeypatch.setattr(forms, "SLICE_CHARS", chars)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    name = lambda: " ".join(rng.choice(words).title() for _ in range(rng.choice([1, 1, 2])))
    terms = sorted({(rng.choice(["a", "a", "a", "b", "c", None]), name()) for _ in range(120)} | {("only terms", "Abc")}, key=repr)
    table = spark.createDataFrame([(b, s, s[::-1]) for b, s in terms], "book string, source string, target string")
    texts = [(rng.choice(["a", "a", "b", "c", None, "only texts"]), i, rng.choice([None, " ".join(rng.choice((name(), rng.choice(words))) + rng.choice(["", "s", ".", "-"]) for _ in range(30))])) for i in range(200)]
    units = spark.createDataFrame(texts, "book string, id int, text string").repartition(3)
    whole = forms.uses(units, "text", table).collect()
    dealt = forms.uses(units, "text", forms.Dictionary(table, 20))
    assert len(whole) > 100 and dealt.columns == list(whole[0].asDict())
    assert sorted(map(repr, map(tuple, dealt.collect()))) == sorted(map(repr, map(tuple, whole)))


def test_texts_are_read_once(spark):
    table = spark.createDataFrame([(f"b{i % 4}", f"Name{i}", "x") for i in range(40)], "book string, source string, target string")
    units = spark.createDataFrame([("b1", "Name1 and Name5 and Name2")], "book string, text string")
    dealt = forms.uses(units, "text", forms.Dictionary(table, 10))
    assert sorted(r.source for r in dealt.collect()) == ["Name1", "Name5"]
    assert dealt._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one pass, not one for each ten terms


def test_marked_by_place(spark):
    """Targets twice over, none, and further ones; no name is looked up in an array, which took the square of a text's terms."""
    found = [("A", "kapı"), ("B", "ev"), ("C", "kapı"), ("D", None), ("E", "yol")]
    rows = spark.createDataFrame([(1, "Kapılar ve yollar", found, ["ev", "yol", "kapı", "yol"]), (2, None, found[:2], []), (3, "Ev", [], ["ev"])], "id int, tr string, found array<struct<source string, target string>>, w array<string>")
    out = matching.marked(rows.select("id", "tr", "found", F.col("w").alias("was")), "tr", was=F.col("was"))
    assert "array_contains" not in out._jdf.queryExecution().toString()
    got = {r.id: ([x.stands for x in r.found], sorted(r.was)) for r in out.collect()}
    assert got == {1: ([True, False, True, False, True], ["kapı", "yol"]), 2: ([False, False], []), 3: ([], ["ev"])}


def test_deviations_with_a_dealt_dictionary(spark, data, monkeypatch):
    """The dictionary's tables stand in one plan several times, beside the terms they come from."""
    key = lambda: sorted(map(tuple, matching.QUERIES["target_deviations"](spark, data).collect()))
    whole = key()
    monkeypatch.setattr(forms.Dictionary.__init__, "__defaults__", (200,))
    assert whole and key() == whole
