"""Ordered extraction against a plain loop over each book's lines, in one block and in many."""

import random
import re

import pytest

from quillwork.operators import records

RULES = records.RULES


def items(value):
    listed = [re.sub(r"\.+$", "", x.strip()) for x in re.findall(r"\[([^\[\]]+)\]", value)]
    plain = re.sub(r"\.+$", "", value.strip())
    return listed or ([] if plain in ("", "—", "-") else [re.sub(r"\.+$", "", plain)])


def plain(chapters):
    """(book, chapter_no, url, text) rows -> (book, url, subject, relation, object), with what is known carried from chapter to chapter."""
    out = []
    for book in {c[0] for c in chapters}:
        known, seen, waiting = {}, set(), None

        def sight(shown):
            nonlocal waiting
            for relation, name in shown:
                if relation in RULES.grown:
                    if waiting and name.lower() not in seen and name.lower() != waiting[1].lower():
                        out.append((book, url, waiting[1], "became", name))
                        waiting = None
                    seen.add(name.lower())

        for _, no, url, text in sorted((c for c in chapters if c[0] == book), key=lambda c: (c[1] or 0, c[2])):
            reader, block, since, over = RULES.main, None, 0, False
            for line in (x.strip(" ") for x in text.split("\n")):
                if not line:
                    continue
                shown = []
                m = re.match(records.LINE, line)
                key, value = (m[1], m[2]) if m else (None, "")
                mark = re.match(RULES.evolving, line)
                if mark:
                    waiting = (no, mark[1])
                for pattern, relation in RULES.awards:
                    for got in re.findall(pattern, line):
                        out.append((book, url, RULES.main, relation, got))
                        shown.append((relation, got))
                if key is None:
                    sight(shown)
                    since += 1
                    continue
                named = (items(value) or [None])[0]
                if key in RULES.subjects and not re.match("[\"“”'‘’]", value):
                    reader = RULES.main if named is None or named in (RULES.main, *RULES.names) else named
                    block, since, over = ("state", reader), 0, False
                    continue
                if key in RULES.owned and named is not None:
                    out.append((book, url, reader, RULES.owned[key], named))
                    shown.append((RULES.owned[key], named))
                    block, since, over = (key, named), 0, False
                else:
                    kind = block and block[0]
                    knows = (kind, key) in RULES.relations or (kind, key) in RULES.counters
                    over = over or (knows and since > records.REACH)
                    inside = knows and not over and not (key in RULES.shared and since > 0)
                    thing = block[1] if block and kind != "state" and since <= records.REACH and not over else None
                    if knows:
                        since = 0
                    about = block if inside else ("state", reader) if ("state", key) in RULES.relations and "[" in value else None
                    if about and (about[0], key) in RULES.relations:
                        for x in items(value):
                            out.append((book, url, about[1], RULES.relations[about[0], key], x))
                            shown.append((RULES.relations[about[0], key], x))
                    counter = re.match(records.COUNTER, value)
                    if counter and key in {k for _, k in RULES.counters}:
                        own = known.setdefault(key, {})
                        limit = int(counter[2])
                        owner = block[1] if inside and (kind, key) in RULES.counters else own.get(limit)
                        if owner is None:
                            mine = [q for q, o in own.items() if o == RULES.main]
                            owner = RULES.main if mine and limit > max(mine) else thing if mine and limit < max(mine) else None
                        if owner is not None:
                            own[limit] = owner
                            out.append((book, url, owner, "counts", f"{key} {int(counter[1])}/{limit}"))
                sight(shown)
            if waiting and no is not None and waiting[0] is not None and no - waiting[0] > records.WAIT:
                waiting = None
    return sorted(out)


def random_book(seed, book, chapters):
    rng = random.Random(seed)
    pick = [
        lambda: "He went on.", lambda: "He went on.", lambda: f"Name: [{rng.choice(['Ash', 'Ashen', 'Bo', 'Cy'])}]", lambda: "Name: \"Hello\"", lambda: f"Shade: [Shade {rng.randrange(30)}]",
        lambda: f"Shards: [{rng.randrange(99)}/{rng.choice([200, 300, 400, 1000, 2000, 3000, 4000])}]", lambda: f"Shards: [{rng.randrange(99)}/{rng.choice([200, 1000, 5000])}]", lambda: f"[Shade {rng.randrange(30)} is evolving.]",
        lambda: "Traits: [Calm], [Swift].", lambda: "Traits: calm", lambda: "Blade: [Dawn]", lambda: "Blade Rank: Ancient.", lambda: "Charge: [3/9]", lambda: f"[You have received a Shade: Dusk {rng.randrange(40)}.]", lambda: "Rank: [Low]", lambda: "", lambda: "Rank: —",
        lambda: "\n".join(["He walked."] * 13),
    ]
    out = []
    for k in range(chapters):
        no = rng.choice([None, k, k, k, k + 70 * (k // 10)])
        out.append((book, no, f"{book}:{k:04}", "\n".join(rng.choice(pick)() for _ in range(rng.randrange(0, 14)))))
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("book", "url", "subject", "relation", "object").collect())


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("blocks", [1, 2, 7, 23])
def test_plain_loop(spark, many_tasks, blocks):
    rows = random_book(1, "hot", 120) + random_book(2, "a", 12) + random_book(3, "b", 5)
    df = spark.createDataFrame(rows, "book string, chapter_no int, url string, source_text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
    try:
        assert found(records.ordered_records(df.repartition(3), RULES)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_on_tables(spark, data):
    told = records._told(spark, data)
    rows = [tuple(r) for r in told.select("book", "chapter_no", "url", "source_text").collect()]
    mine = found(records.QUERIES["ordered_records"](spark, data))
    assert mine == plain(rows)
    assert {r for _, _, _, r, _ in mine} == {"owns_shade", "owns_blade", "rank", "trait", "counts", "became"}
    known = {"ash", "ancient", "dawn", "swift", "reader1", "shade2"}
    fold = lambda x: re.sub(r"[\s\-_'’.·]+", "", x.strip()).lower()
    missing = {}
    for book, _, subject, relation, thing in mine:
        for name in (subject,) if relation == "counts" else (subject, thing):
            if fold(name) not in known:
                missing[book, name] = missing.get((book, name), 0) + 1
    assert {(r.book, r.name): r.records for r in records.QUERIES["unresolved_names"](spark, data).collect()} == missing


def test_changes_keep_what_matters():
    rng = random.Random(5)
    for _ in range(300):
        make = lambda n: [(rng.choice([1, 2, 3, 4, 5]) * 100, rng.choice([None, None, "Ash", "x"]), rng.choice([None, "t"])) for _ in range(n)]
        first, second = make(rng.randrange(8)), make(rng.randrange(14))
        whole, short = {}, {}
        for e in first:
            records.owner_of(*e, "Ash", whole)
            records.owner_of(*e, "Ash", short)
        for e in second:
            records.owner_of(*e, "Ash", whole)
        for e in records.changes(iter(second)):
            records.owner_of(*e, "Ash", short)
        assert whole == short


def test_no_chapters(spark):
    empty = spark.createDataFrame([], "book string, chapter_no int, url string, source_text string")
    assert records.ordered_records(empty, RULES).collect() == []
