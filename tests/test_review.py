"""Review, upkeep and sense operators by hand, and the endings engine against all sequences."""

import pytest
from pyspark.sql import functions as F

from quillwork.functions import forms, turkish
from quillwork.functions import text as T
from quillwork.operators import matching, review, senses, upkeep, wording


def test_gate_reasons(spark):
    terms = spark.createDataFrame([("b", "Silver Gate", "Silver Gate", "place"), ("b", "Gate", "Kapı", "place"), ("b", "Door", "kapı", "place"), ("b", "Red Queen", "Kızıl Kraliçe'nin", "person"), ("b", "Seven", "Yediler", "group"), ("b", "Five Plagues", "Beş Bela", "group"), ("b", "Chiffonier", "Dolap", "x"), ("b", "Chiffonnier", "Gardırop", "x"), ("b", "Well", "the Kuyu", "x")], "book string, source string, target string, kind string")
    found = {r.source: r.reasons for r in review.gate(terms, spark.createDataFrame([("b", "DOLAP")], "book string, target string"), spark.createDataFrame([("b", "group", "keep")], "book string, kind string, rule string")).collect()}
    assert found == {"Silver Gate": "part_conflict", "Gate": "collision", "Door": "collision", "Red Queen": "case_ending", "Seven": "number,policy", "Five Plagues": "plural_form,policy", "Chiffonier": "forbidden,near_spelling", "Chiffonnier": "near_spelling", "Well": "english_word"}


def test_gate_of_nothing(spark):
    none = spark.createDataFrame([], "book string, source string, target string, kind string")
    assert review.gate(none, spark.createDataFrame([], "book string, target string"), spark.createDataFrame([], "book string, kind string, rule string")).count() == 0


def test_case_profile(spark):
    text = "The seven came. Seven left; then Seven rose\nand seven, seven, seven, seven fell. \"Seven\""
    chapters = spark.createDataFrame([("b", text), ("b", None)], "book string, source_text string")
    r = review.case_profile(chapters, spark.createDataFrame([("b", "Seven"), ("b", "Two Words")], "book string, source string")).collect()
    assert [(x.source, x.lower_uses, x.upper_mid, x.ordinary) for x in r] == [("Seven", 5, 1, True)]


def test_same_being(spark):
    chapters = spark.createDataFrame([("b", 4, "Mara, the Weaver, came. Weaver also known as Mara. Mara was the Weaver."), ("b", 2, "Mara. Weaver")], "book string, chapter_no int, source_text string")
    r = review.same_being(chapters, spark.createDataFrame([("b", "Mara"), ("b", "Weaver")], "book string, source string")).collect()
    assert [tuple(x) for x in r] == [("b", "Mara", "Weaver", 3, 4)]


def test_evidence(spark):
    chapters = spark.createDataFrame([("u", "Mara  knows\nWeaver well. If Mara knows Weaver, fine.")], "url string, source_text string")
    rows = [(1, "Mara", "knows", "Weaver", "mara knows weaver well", 0.9), (2, "Mara", "eats", "Weaver", "x", 0.9), (3, "Mara", "knows", "Weaver", None, 0.9), (4, "Mara", "knows", "Weaver", "Mara hates Weaver", 0.9), (5, "Nox", "knows", "Weaver", "Mara knows Weaver", 0.9), (6, "Mara", "knows", "Weaver", "Mara knows Weaver", 0.1), (7, "Mara", "knows", "Weaver", "If Mara knows Weaver", 0.9)]
    p = spark.createDataFrame([(i, "u", s, r, o, q, c) for i, s, r, o, q, c in rows], "id int, url string, subject string, relation string, object string, quote string, confidence double")
    found = {r.id: r.reason for r in review.evidence_verdicts(p, chapters, ("knows",)).collect()}
    assert found == {1: None, 2: "unknown relation", 3: "no evidence", 4: "not verbatim", 5: "subject absent", 6: "low confidence", 7: "supposed"}


def test_retraction(spark):
    rows = [(1, 1, "d1", "m", "success"), (2, 2, "d2", "n", "refused"), (3, 3, "d2", "n", "refused")]
    calls = spark.createDataFrame([(i, t, d, 7, "k", m, o) for i, t, d, m, o in rows], "id int, ts int, day string, chapter int, api_key string, model string, outcome string")
    assert sorted(map(tuple, upkeep.counters(calls).collect())) == [("d1", "m", 0, 1, 1), ("d2", "n", 0, 1, 1)]


def test_ordered_intake(spark):
    batches = spark.createDataFrame([("a", n) for n in (1, 2, 3, 4, 6, 7, None)], "book string, number int")
    r = upkeep.ordered_intake(batches, spark.createDataFrame([("a", 2)], "book string, head int")).collect()
    assert {x.state: (x.numbers, x.first, x.last) for x in r} == {"repeated": (2, 1, 2), "applied": (2, 3, 4), "gap": (2, 6, 7)}


def test_restored(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "url string, digest string")
    r = upkeep.restored(rows(("a", "new"), ("b", "new")), rows(("a", "old"), ("a", "older")), rows(("a", "old"), ("b", "gone")))
    assert sorted(map(tuple, r.collect())) == [("a", "new", "archive"), ("a", "old", "current"), ("a", "older", "archive"), ("b", "new", "current")]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("She summoned Warden.", ["second"]), ("a Warden came", ["base"]), ("a friendly local Warden", ["base"]), ("sent one to Warden", ["second"]), ("the Warden", ["unclear"]), ("Wardens fell", ["base"]), ("Warden Tyris", ["base"]),
        ("Warden. The end", ["second"]), ("Warden... Warden Tyris?", ["base", "base"]), ("every Master, and Warden", ["base"]), ("Stone Warden", []), ("rank of Warden", ["base"]), ("", []),
    ],
)
def test_senses(spark, text, kinds):
    sense = senses.Sense("Warden", "Bekçi", "Warden", 5, ("Stone",), ("rank",), ("Master",))
    df = spark.createDataFrame([(text,)], "t string")
    split = forms.once(df, _w=F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), _g=F.split("t", r"[\p{L}\p{N}_]+", -1))
    assert split.select(senses.kinds_of_use(sense, F.lit(9)).alias("k")).first().k == kinds


def test_sense_faults(spark):
    sense = senses.Sense("Warden", "Bekçi", "Warden", 5)
    rows = [(9, "She summoned Warden.", "Warden'i çağırdı."), (9, "She summoned Warden.", "Bekçiyi çağırdı."), (9, "a Warden", "bir Warden"), (9, "the Warden", "o"), (2, "She summoned Warden.", "Bekçiyi çağırdı."), (None, "She summoned Warden.", None), (9, None, "x")]
    paras = spark.createDataFrame([(1, c, i, e, t) for i, (c, e, t) in enumerate(rows)], "book long, chapter_no long, para long, en string, tr string")
    got = {r.para: (r.sense, r.expected) for r in senses.sense_faults(paras, [sense]).collect()}
    assert got == {1: ("second", "Warden"), 2: ("base", "Bekçi"), 5: ("second", "Warden")}


def test_address_form(spark):
    texts = ["Sen geldin mi?", "Siz geldiniz", "kadın oyun", "Seni bekleyin", "", None]
    r = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", senses.address_form(F.col("t")).alias("f")).orderBy("i").collect()
    assert [x.f for x in r] == ["sen", "siz", None, "both", None, None]


def test_message_claims(spark):
    found = spark.createDataFrame([("u", "b", i, k, v) for i, (k, v) in enumerate([("Rank", "One"), ("Name", "[Mara]"), ("Rank", "[Two], [Three]"), ("Other", "x")])], "url string, book string, line long, key string, value string")
    r = senses.message_claims(found, spark.createDataFrame([("rank", "has_rank")], "key string, relation string")).collect()
    assert sorted(map(tuple, r), key=str) == sorted([("b", "u", None, "has_rank", "One"), ("b", "u", "Mara", "has_rank", "Two"), ("b", "u", "Mara", "has_rank", "Three")], key=str)


def test_endings_against_all_sequences():
    for stem in ("kitap", "kapı", "renk", "göz"):
        forms = {}
        for s in turkish.sequences():
            forms.setdefault(turkish.build(stem, s), set()).add(s)
        for form in sorted(forms)[::37]:
            assert set(turkish.parse(stem, form)) == forms[form]


@pytest.mark.parametrize(("stem", "endings", "form"), [("kitap", ("lIk",), "kitaplık"), ("kitap", ("lIk", "(s)I"), "kitaplığı"), ("göz", ("lIk", "CI"), None), ("göz", ("CI",), "gözcü"), ("kitap", ("CI",), "kitapçı"), ("asker", ("(y)DI",), "askerdi"), ("kapı", ("(y)DI",), "kapıydı"), ("tuz", ("sIz", "lAr"), "tuzsuzlar"), ("kral", ("DIr",), "kraldır")])
def test_endings(stem, endings, form):
    if form:
        assert turkish.build(stem, endings) == form and endings in turkish.parse(stem, form)


def test_refill():
    old, new = ["kılıç", "kara kılıç"], ["kapı", "kılıç"]
    shape, uses = matching.template("Kılıçlar ve kara kılıç.", old)
    assert [u[0] for u in uses] == [0, 1] and matching.refill(shape, uses, old, old)[0] == "Kılıçlar ve kara kılıç."
    text, moved, left = matching.refill(*matching.template("Kılıçlar geldi.", old), old, new)
    assert (text, moved, left) == ("Kapılar geldi.", 1, 0)


def test_attributions(spark):
    rows = [(1, "b", "Then Mirza met Weaver.", "Sonra Mirza geldi."), (2, "b", "The Captain ran.", "O sırada Kaptan koştu."), (3, "b", "Captain and Master ran.", "ve Kaptan koştu."), (4, "b", "Captain ran.", "Kaptan koştu."), (5, "b", None, None)]
    paras = spark.createDataFrame(rows, "id int, book string, en string, tr string")
    r = wording.attributions(paras, spark.createDataFrame([("b", "Weaver", "Dokumacı")], "book string, source string, target string")).collect()
    assert sorted(map(tuple, r)) == [(1, "Mirza", "="), (2, "Captain", "Kaptan")]


def test_claim_reasons(spark):
    rows = [("b", c, "tie", "x", r, "y") for c, r in ((1, "ally"), (2, "ally"), (3, "foe"), (4, "foe"))] + [("b", c, "common", "z", None, None) for c in (1, 2, 3)] + [("b", c, "name", "q", None, "x") for c in (1, 2)]
    claims = spark.createDataFrame(rows, "book string, chapter int, kind string, subject string, relation string, object string")
    r = wording.claim_reasons(claims, "ally", "foe").collect()
    assert sorted(tuple(x)[1:4] for x in r if x.other) == [("q", "alias", "x"), ("x", "clash", "y"), ("y", "clash", "x")] and [x.node for x in r if not x.other] == ["z"]


def test_text_functions(spark):
    rows = [("[[1]] a [[2]]\nb", 2), ("[[2]] b [[1]] a", 2), ("[[1]] a", 2), ("[[1]] [[2]] b", 2), ("", 1), (None, 1), ("a. b! c", 0)]
    r = spark.createDataFrame(rows, "t string, n int").select(T.marked_parts(F.col("t"), F.col("n")).alias("m"), T.tail_words(F.col("t"), 2).alias("w"), T.last_sentences(F.col("t"), 2).alias("s"), T.slug(F.col("t"), "p").alias("g")).collect()
    assert [x.m for x in r] == [["a", "b"], ["a", "b"], None, None, None, None, None]
    assert (r[6].w, r[6].s, r[6].g, r[5].w, r[4].g) == ("b! c", "b! c", "p-a-b-c", "", None)
    heads = spark.createDataFrame([("Mask of the Weaver",), ("Red Gate",), ("",)], "t string").select(T.head_word(F.col("t")).alias("h")).collect()
    assert [x.h for x in heads] == ["Mask", "Gate", ""]


def test_foreign_words(spark):
    paras = spark.createDataFrame([("b", 1, 0, "a слово", "слово ок é"), ("b", 1, 1, None, "ok")], "book string, chapter_no int, para int, en string, tr string")
    assert [x.words for x in wording.foreign_words(paras).collect()] == ["ок"]


def test_risen_and_forecast(spark):
    ranks = lambda *r: spark.createDataFrame(list(r), "book string, subject string, rank string, chapter int")
    r = upkeep.risen(ranks(("b", "x", "low", 5), ("b", "y", "high", 5)), ranks(("b", "x", "high", 4), ("b", "x", "mid", 6), ("b", "x", "mid", 7), ("b", "x", "odd", 9), ("b", "y", "low", 9)), ("low", "mid", "high"))
    assert [tuple(x) for x in r.collect()] == [("b", "x", "mid", 6, "low")]
    calls = spark.createDataFrame([("m", "2024-01-01", 60, 10), ("m", "2024-01-20", 50, 20), ("n", "2024-01-01", 1, 1)], "model string, day string, tokens_in int, tokens_out int").withColumn("day", F.col("day").cast("date"))
    assert {x.model: (x.used, x.recent, x.days, x.lasts) for x in upkeep.burn_forecast(calls, 240, 11).collect()} == {"m": (140, 70, 10.0, False), "n": (2, 0, None, True)}
    assert upkeep.burn_forecast(calls.limit(0), 1, 1).count() == 0
