"""Cases by hand: rules, boundaries, nulls, ties, and the properties the merges promise."""

import random

from pyspark.sql import functions as F

from quillwork.functions import numbers, text
from quillwork.operators import chapters, glossary, graph, ledger, quality, reading
from quillwork.plans.components import components


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_folds(spark):
    assert one(spark, text.fold_term, " Silver-Crow’s Den ") == "silvercrowsden"
    assert one(spark, text.turkish_lower, "IĞDIR İL") == "ığdır il"
    assert one(spark, text.search_fold, "IŞIK") == "işik"
    assert one(spark, text.plain_letters, "ÇÖĞÜŞ Iı") == "cogus ii"
    assert one(spark, text.normalise_source, "“Merwis's!”") == "Merwis"
    names = spark.createDataFrame([("p10",), ("p9",), ("p1",)], "x string").orderBy(text.natural_key(F.col("x")))
    assert [r.x for r in names.collect()] == ["p1", "p9", "p10"]


def test_numbers():
    assert numbers.values("three million and 25 of 1,250.5", False) == [3e6, 25, 1250.5]
    assert numbers.values("3 milyon, 1.250,5 ve yirmi beş bin", True) == [3e6, 1250.5, 25000]
    assert numbers.values("two hundred and fifty thousand", False) == [250000]
    assert numbers.missing("He paid 3,000 coins to 25 men", "25 adama 3.000 sikke verdi") == []
    assert numbers.missing("forty two ships", "gemiler") == [42]
    assert numbers.missing("", "") == []
    gone = numbers.missing
    assert gone("a thousand swords", "binlerce kılıç") == [] and gone("Thousands of swords", "bin kılıç") == [] and gone("thousands of swords", "yüzlerce kılıç") == [1000]
    assert gone("He met Nine Herons and the Thirty Kings", "onu gördü") == [] and gone("Thirty kings came", "krallar geldi") == [30]
    assert gone("sixty seventy million stones", "taşlar") == [] and numbers.values("altmış yetmiş milyon", True) == []
    assert numbers.values("yirmisi kaldı, üç yüz kırka çıktı, 3 milyonluk taş ve beş'i", True) == [20, 340, 3e6, 5]
    assert numbers.values("two three four ships", False) == [2, 3, 4] and numbers.values("two thousand, five hundred men; ten, a hundred", False) == [2500, 10, 100]
    assert numbers.values("version 1.2.3 of 12,34", False) == [] and gone("130 million souls", "130 milyon can") == [] and gone("2.5 million", "2,5 milyon") == []


def sessions(spark, rows):
    return spark.createDataFrame([(i, "b", "free", *r, i) for i, r in enumerate(rows)], "session long, book string, mode string, chars int, words int, active_ms long, client_valid boolean, ts long").withColumn("day", F.current_date())


def test_session_validity(spark):
    ok = [(1500, 300, 60000, True), (1499, 300, 60000, True), (2000, 300, 59999, True), (30000, 300, 60000, True), (2000, 300, 60000, False), (2000, 300, 60000, None)]
    assert [r.session for r in reading.free_sessions(sessions(spark, ok)).collect()] == [0]


def test_outliers_above_twice_the_median_go(spark):
    speeds = [1500, 2000, 1600, 4900]
    found = reading.speed_median(reading.free_sessions(sessions(spark, [(s, 100, 60000, True) for s in speeds])), ["book"]).first()
    assert (found.cpm, found.sessions) == (1600.0, 3)


def edges(spark, rows):
    return spark.createDataFrame(rows, "book string, src string, relation string, dst string, learned_at int, evidence string, origin string, status string, confidence double")


def test_edge_merge_is_commutative_and_idempotent(spark):
    rows = [("b", "x", "r", "y", 9, "e9", "model", "rejected", 0.4), ("b", "x", "r", "y", 4, "e4", "model", "approved", 0.9), ("b", "x", "r", "y", 4, "e3", "system", "approved", 0.2), ("b", "y", "ally", "x", None, "n", "model", "approved", 0.1), ("b", "x", "ally", "y", 7, "s", "manual", "rejected", 0.3)]
    expect = None
    for _ in range(3):
        random.shuffle(rows)
        got = sorted(map(tuple, graph.merge_edges(edges(spark, rows), ("ally",)).drop("seen").collect()))
        expect = expect or got
        assert got == expect
    assert ("b", "x", "r", "y", 4, "e3", "system", 0.9, "approved") in expect
    assert ("b", "x", "ally", "y", 7, "s", "manual", 0.3, "rejected") in expect
    again = edges(spark, [(b, s, r, d, at, e, o, st, c) for b, s, r, d, at, e, o, c, st in expect])
    assert sorted(map(tuple, graph.merge_edges(again, ("ally",)).drop("seen").collect())) == expect


def test_asof_views_are_monotone(spark):
    rows = edges(spark, [("b", "x", "r", d, at, "e", "model", "approved", 0.5) for d, at in (("p", 1), ("q", 5), ("z", None))])
    nodes = spark.createDataFrame([(n, n.upper()) for n in "xpqz"], "node string, name string")
    seen = [graph.two_ended(rows, nodes, n).count() for n in (0, 1, 5, 99)]
    assert seen == [0, 1, 2, 2]


def test_closing_and_change_points(spark):
    closed = graph.closings(edges(spark, [("b", "x", "lives", d, at, "e", "m", "approved", 1.0) for d, at in (("p", 1), ("q", 5))])).orderBy("since").collect()
    assert [(r.dst, r.until) for r in closed] == [("p", 5), ("q", None)]
    values = spark.createDataFrame([("b", "n", "k", v, i, i) for i, v in enumerate(["A", "A", None, None, "A"])], "book string, node string, key string, value string, learned_at int, seq int")
    assert [r.learned_at for r in graph.changes(values).orderBy("seq").collect()] == [0, 2, 4]


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("z", "z"), *[(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]], "u string, v string")
    found = {r.node: r.component for r in components(e).collect()}
    assert found["c"] == "a" and found["y"] == "x" and found["z"] == "z" and found["n040"] == "n000"
    assert components(e.limit(0)).count() == 0


def test_near_terms(spark):
    terms = spark.createDataFrame([("b", x) for x in ("Merwis", "Merwiss", "Mervis", "Cat", "Cats", "Rat")], "book string, source string")
    assert {(r.a, r.b) for r in glossary.near_terms(terms).collect()} == {("Mervis", "Merwis"), ("Cat", "Rat")}


def test_imports(spark):
    mine = spark.createDataFrame([("b", "x", "old", "mine"), ("b", "y", "y1", None)], "book string, source string, target string, note string")
    theirs = spark.createDataFrame([("b", "x", "new", None, True), ("b", "z", "z1", "n", True), ("b", "y", "y2", None, False)], "book string, source string, target string, note string, has_note boolean")
    got = {r.source: (r.target, r.note) for r in glossary.imported(mine, theirs, True).collect()}
    assert got == {"x": ("new", None), "y": ("y2", None), "z": ("z1", "n")}
    got = {r.source: (r.target, r.note) for r in glossary.imported(mine, theirs, False).collect()}
    assert got == {"x": ("old", "mine"), "y": ("y1", None), "z": ("z1", "n")}


def test_upsert_keeps_quality_only_for_equal_texts(spark):
    schema = "url string, source_text string, translation string, model string, prev_url string, quality double, created_at double"
    old = spark.createDataFrame([("a", "s", None, "m", "p", 0.5, 1.0), ("b", "s", "t", "m", None, 0.6, 1.0), ("c", "s", "t", "m", "p", 0.7, 1.0)], schema)
    new = spark.createDataFrame([("a", "s", None, None, None), ("b", "s", "u", "n", "q"), ("d", "s", "t", "n", None)], "url string, source_text string, translation string, model string, prev_url string")
    got = {r.url: r for r in chapters.upsert(old, new).collect()}
    assert (got["a"].model, got["a"].prev_url, got["a"].quality) == ("m", "p", 0.5)
    assert (got["b"].translation, got["b"].model, got["b"].quality) == ("u", "n", None)
    assert got["c"].quality == 0.7 and got["d"].quality is None
    again = chapters.upsert(chapters.upsert(old, new).withColumn("created_at", F.lit(1.0)), new)
    assert {r.url: r.translation for r in again.collect()} == {u: r.translation for u, r in got.items()}


def test_unaligned_pairs_are_not_measured(spark):
    pairs = spark.createDataFrame([(1, 1, "a\nb", "x\ny"), (1, 2, "a\nb", "x"), (1, 3, None, "x")], "book long, chapter_no long, source_text string, translation string")
    assert [(r.chapter_no, r.para, r.en, r.tr) for r in chapters.paragraphs(pairs).orderBy("para").collect()] == [(1, 0, "a", "x"), (1, 1, "b", "y")]
    ratios = {r.chapter_no: r.ratio for r in quality.length_ratios(pairs).collect()}
    assert ratios[3] is None and ratios[1] == 1.0


def test_stems_and_drift(spark):
    stems = spark.createDataFrame([(["göl", "gölge", "karan", "gölgem", "gölgeler"],)], "f array<string>")
    assert [stems.select(quality.stem_of(F.col("f"), F.lit(i)).alias("s")).first().s for i in range(5)] == ["göl", "gölge", "karan", "gölge", "gölge"]
    rows = [("b", c, "Shadow", f) for c, f in ((1, "gölge"), (2, "gölgeler"), (3, "gölge"), (4, "karaltı"), (5, "karaltılar"), (6, "karaltı"))]
    found = quality.drift(spark.createDataFrame(rows, "book string, chapter_no int, source string, form string")).collect()
    assert [(r.main, r.runner_up, r.n, r.n_runner_up) for r in found] == [("gölge", "karaltı", 6, 3)]


def test_ranks_from_the_last_on(spark):
    """Against a plain loop, in linear time: Spark works a frame that ends with its group out anew for every row."""
    rows = [("b", f"n{i % 3}", None if i % 11 == 0 else i * 7 % 40, i, None if i % 13 == 0 else i * 5 % 17) for i in range(200)]
    found = ledger.monotone_ranks(spark.createDataFrame(rows, "book string, node string, chapter int, id int, step int"))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    place = lambda r: (-1 if r[2] is None else r[2], r[3])
    later = lambda r: [x[4] for x in rows if x[1] == r[1] and place(x) > place(r) and x[4] is not None]
    keep = [r for r in rows if not later(r) or (r[4] is not None and min(later(r)) >= r[4])]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, keep))


def test_ledger_precedence(spark):
    records = spark.createDataFrame([(1, "b", "k", "sys", "system", 9, False), (2, "b", "k", "man", "manual", 3, False), (3, "b", "gone", "v", "system", 1, False), (4, "b", "gone", "v", "manual", 2, True)], "id long, book string, key string, value string, origin string, first_chapter int, deleted boolean")
    assert [(r.key, r.value) for r in ledger.current_view(records, 99).collect()] == [("k", "man")]
    assert [(r.key, r.value) for r in ledger.current_view(records, 1).collect()] == [("gone", "v")]


def test_address_boundary(spark):
    rows = [(i, "b", i, "s", "o", "sen" if i % 5 else "siz") for i in range(1, 6)]
    claims = spark.createDataFrame(rows, "id long, book string, chapter int, subject string, object string, form string")
    got = ledger.address_table(claims).first()
    assert (got.n, got.form, got.stable) == (5, "sen", True)


def test_proposals(spark):
    from quillwork.operators import governance

    bodies = ['{"new_edges": [{"subject": "a", "relation": "r", "object": "b", "evidence": "e"}]}', '{"new_edges": [{"subject": " ", "relation": "r", "object": "b"}], "odd": 1}', '{"reviews": [{"category": "c", "note": "n", "importance": "huge"}], "new_aliases": {}}', "nonsense", None, "{}"]
    got = {r.id: r.errors for r in governance.proposal_errors(spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).collect()}
    assert got[0] == [] and got[5] == [] and got[3] == got[4] == ["no object"]
    assert got[1] == ["unknown section odd", "new_edges.subject missing in 1", "new_edges.evidence missing in 1"]
    assert got[2] == ["new_aliases is no list", "reviews.importance unknown in 1"]


def test_fill_and_resolve(spark):
    from quillwork.operators import governance

    mine = spark.createDataFrame([("b", 1, None), ("b", 2, "x")], "book string, id int, note string")
    theirs = spark.createDataFrame([("b", 1, "n"), ("b", 2, "m"), ("b", 3, "k")], "book string, id int, note string")
    assert {(r.id, r.note) for r in governance.fill_only(mine, theirs, ["book", "id"], ["note"]).collect()} == {(1, "n"), (2, "x")}
    nodes = spark.createDataFrame([("b", "Dağ Evi", "n1"), ("b", "Tolan", "n2")], "book string, name string, node string")
    spellings = spark.createDataFrame([("b", "Tolgan", "n2")], "book string, spelling string, node string")
    names = spark.createDataFrame([("b", x) for x in ("dağ-evi", "TOLGAN", "dagevi", "who")], "book string, name string")
    assert {r.name: (r.node, r.step) for r in governance.resolve(names, nodes, spellings).collect()} == {"dağ-evi": ("n1", 0), "TOLGAN": ("n2", 1), "dagevi": ("n1", 2), "who": (None, None)}


def test_no_paragraph_is_cut(spark):
    early, long_tail = "One.\nHe paid 42 coins to them.\nAnd 77 more to others.", "Bir.\nO öder 42.\nSon.\nЖук"
    pairs = spark.createDataFrame([(1, 1, early, "Bir."), (1, 2, "One.", long_tail), (1, 3, early, None)], "book long, chapter_no long, source_text string, translation string")
    paras = quality.aligned(pairs)
    assert sorted((r.chapter_no, r.para, r.en, r.tr) for r in paras.collect())[:3] == [(1, 0, "One.", "Bir."), (1, 1, "He paid 42 coins to them.", ""), (1, 2, "And 77 more to others.", "")]
    cards = {r.chapter_no: (r.paragraphs, r.short, r.tr_chars, r.en_chars, r.alarm) for r in quality.scorecard(paras).collect()}
    assert cards == {1: (3, 2, 4, 51, True), 2: (4, 0, 21, 4, False), 3: (3, 3, 0, 51, True)}
    assert sorted((r.chapter_no, r.para, r.missing) for r in quality.number_mismatches(paras).collect()) == [(c, p, v) for c in (1, 3) for p, v in ((1, "42"), (2, "77"))]
    assert [(r.chapter_no, r.para) for r in quality.foreign_letters(paras).where("letters LIKE '%Ж%'").collect()] == [(2, 3)]


def test_queries_read_both_sides_to_the_end(spark, data):
    from quillwork import catalog
    from quillwork.sources.tables import role

    want = role(spark, data, "pairs").selectExpr("sum(length(source_text) - size(split(source_text, '\n')) + 1) en", "sum(length(translation) - size(split(translation, '\n')) + 1) tr").first()
    got = catalog.QUERIES["scorecard"](spark, data).groupBy().sum("en_chars", "tr_chars").first()
    assert tuple(got) == tuple(want)
    numbered = quality._numbered(spark, data)
    assert numbered.count() == quality.aligned(role(spark, data, "pairs")).count() and catalog.QUERIES["number_mismatch"](spark, data).count() == quality.number_mismatches(numbered).count() > 0


def test_whole_queries_see_every_chapter(spark, data):
    from quillwork import catalog
    from quillwork.sources.tables import role

    ran = lambda name: catalog.QUERIES[name](spark, data)
    edges, claims, chapters_ = (role(spark, data, x).toPandas() for x in ("edges", "claims", "chapters"))
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x in edges.itertuples():
        a, b = sorted((top(f"{x.book}/{x.src}"), top(f"{x.book}/{x.dst}")))
        up[b] = a
    sizes = {}
    for x in list(up):
        sizes[top(x)] = sizes.get(top(x), 0) + 1
    assert {r.component: r.members for r in ran("case_components").collect()} == sizes
    assert sorted(r.members for r in ran("alias_groups").collect()) == sorted(n for n in sizes.values() for _ in range(n))
    models, firm = set(), {}
    for x in edges.itertuples():
        pair = (x.book, *sorted((x.src, x.dst)))
        models.add((*pair, x.relation)) if x.origin == "model" else firm.setdefault(pair, set()).add(x.relation)
    conflicts = {m for m in models if m[:3] in firm and m[3] not in firm[m[:3]]}
    assert {tuple(r)[:4] for r in ran("origin_conflicts").collect()} == conflicts
    assert ran("node_clusters").count() == len({(x.book, n) for x in claims.itertuples() for n in (x.subject, x.object)})
    assert ran("chapter_headers").count() == sum(x.doc_id % 9 == 0 or x.lang == "en" for x in chapters_.itertuples())


def test_alias_chains_and_search(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("s", "s")], "alias string, canonical string")
    assert {r.alias: r.canonical for r in chapters.resolved(aliases).collect()} == {"a": "e", "b": "e", "c": "e", "d": "e", "x": "y"}
    ring = spark.createDataFrame([("p", "q"), ("q", "p")], "alias string, canonical string")
    assert chapters.resolved(ring).count() == 2
    told = spark.createDataFrame([("u", "x" * 100 + " IŞIK ve ışık"), ("v", "isik"), ("w", None)], "url string, translation string")
    got = {r.url: (r.hits, r.context, r.cut) for r in chapters.search(told, "Işık", 5, 3).collect()}
    assert got == {"u": (2, "xx IŞIK ve", False)} or got["u"] == (2, "xx IŞIK ve", False)


def test_rules_and_decisions(spark):
    edges = spark.createDataFrame([("b", "x", "owns", "y"), ("b", "x", "leads", "z"), ("b", "q", "owns", "z"), ("b", "z", "eats", "w")], "book string, src string, relation string, dst string")
    got = {r.node: r.cluster for r in graph.clusters(edges, [("chief", ("owns", "leads")), ("owner", ("owns",))]).collect()}
    assert got == {"x": "chief", "y": "chief", "z": "chief", "q": "owner"}
    claims = spark.createDataFrame([(i, "b", i, "s", "o", "hocam" if i < 5 else "siz") for i in range(1, 6)], "id long, book string, chapter int, subject string, object string, form string")
    decided = spark.createDataFrame([("b", "s", "o", "sen"), ("b", "s", "p", "siz")], "book string, subject string, object string, form string")
    assert [tuple(r) for r in ledger.address_table(claims).collect()] == [("b", "s", "o", 5, "hocam", True)]
    assert sorted(map(tuple, ledger.address_table(claims, decided=decided).collect())) == [("b", "s", "o", 5, "sen", True), ("b", "s", "p", 0, "siz", True)]


def test_gate_reads_its_table_once(spark, data):
    """Ten rules on one staged table: no scan of the documents is left in the plan."""
    from quillwork.operators import review

    plan = review.QUERIES["gate_reasons"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan


def test_any_value_refutes(spark):
    rng = random.Random(6)
    rows = [("b", f"n{rng.randrange(25)}", "rank", rng.choice(["page", "squire", "knight", "F", "O", "", None]), rng.randrange(12), i, rng.random() < 0.4) for i in range(500)]
    found = graph.refuted(spark.createDataFrame(rows, "book string, node string, key string, value string, learned_at int, seq int, confirmed boolean"))
    want = set()
    for b, n, k, v, at, seq, sure in rows:
        later = [y[4] for y in rows if y[1] == n and (y[4], y[5]) > (at, seq) and y[6] and None not in (y[3], v) and y[3] != v]
        if later and not sure:
            want.add((b, n, k, v, at, seq, min(later)))
    assert len(want) > 50 and {tuple(r) for r in found.collect()} == want


def test_memory_examples_per_target_chapter(spark):
    import math

    rng = random.Random(11)
    words = ["silver", "crow", "night", "tower", "river", "stone", "lord"]
    line = lambda: rng.choice(["", '"']) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    texts = [(b, c, [line() for _ in range(5)]) for b in (1, 2) for c in range(1, 9)]
    pairs = spark.createDataFrame([(b, c, "\n".join(t), "\n".join("x" for _ in (t if c != 4 else t[1:]))) for b, c, t in texts], "book long, chapter_no long, source_text string, translation string")
    bag = lambda x: {w for w in x.replace('"', "").split() if len(w) > 3}
    want = []
    for b, target, own in texts:
        keys = bag(" ".join(own))
        pool = [(c, i, x) for bb, c, t in texts for i, x in enumerate(t) if bb == b and c < target and c != 4 and bag(x)]
        weight = {w: math.log(1 + len(pool) / (1 + sum(w in bag(x) for _, _, x in pool))) for w in keys}
        for pick in range(3):
            score = lambda y: sum(weight[w] for w in sorted(bag(y[2]) & keys)) * (1.2 if y[2][0] == '"' else 1.0)
            best = max(pool, key=lambda y: (score(y), y[0], -y[1]), default=None)
            if not best or score(best) <= 0:
                break
            want.append((b, target, pick, best[0], best[1]))
            pool.remove(best)
            for w in bag(best[2]) & keys:
                weight[w] *= 0.3
    assert len(want) > 30 and sorted(tuple(r) for r in quality.memory_examples(pairs, k=3).collect()) == sorted(want)
