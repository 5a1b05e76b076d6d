"""Records that a book's messages tell, read in order: who owns what, what rank it has, how far a counter stands and what turned into what.

A chapter's lines are read by rules that are data: keys that open a block, the keys each block knows, and the relation each stands for.
Windows over a chapter's lines find the block of a line. Three things reach across chapters. A counter line outside any block belongs to whom that
key and limit last belonged to, and a mark of something evolving waits for the first name not seen before. Both are states along the whole
book, and neither is followed by one task: blocks of the book's lines are reduced to what can change the state, these are chained in order,
and each block is then read again from the state at its start; the waiting mark is the last one before a line, carried across blocks.
The third, which names are known, is the place where each was first seen."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.components import reliable
from ..plans.ordered import carried, ordered
from ..sources.tables import role, table

# The shape of a record line and of a counter, paragraphs of narration after which a block is over, and chapters that an evolution waits.
LINE = r"^([A-Z][A-Za-z ]{1,30}):\s*(.+?)\s*$"
COUNTER = r"^\[?\s*([0-9]+)\s*/\s*([0-9]+)\s*\]?\.?$"
REACH, WAIT = 12, 60


@dataclass(frozen=True)
class Rules:
    """What a book's lines mean. `subjects`: keys whose value is whom the following lines tell of. `owned`: keys that open a block about
    something of theirs, with the relation of owner and thing. `relations` and `counters`: what a block knows, by its key (`state` for
    a subject's); keys of `shared` are counters of more than one kind of block and belong to none after narration. `awards`: patterns of
    a line whose group the main character receives. `evolving`: the pattern of a mark; what a relation of `grown` names can end it."""

    main: str
    names: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ("Name", "Master")
    owned: dict[str, str] = field(default_factory=dict)
    relations: dict[tuple[str, str], str] = field(default_factory=dict)
    counters: tuple[tuple[str, str], ...] = ()
    shared: tuple[str, ...] = ()
    awards: tuple[tuple[str, str], ...] = ()
    evolving: str = r"^\[(?:\.\.\.)?(?:The )?([A-Z][^\]]*?) is evolving\.{0,3}\]$"
    grown: tuple[str, ...] = ()


def _items(value: Column) -> Column:
    """The bracketed items of a value; a value without brackets is one item, a dash none."""
    listed = F.regexp_extract_all(value, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    plain = F.regexp_replace(F.trim(value), r"\.+$", "")
    every = F.when(F.size(listed) > 0, listed).when(plain.isin("", "—", "-"), F.array().cast("array<string>")).otherwise(F.array(plain))
    return F.transform(every, lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))


def _among(rules: tuple | dict, block: Column, key: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(f"{b}\t{k}") for b, k in rules]).cast("array<string>"), F.concat_ws("\t", block, key))


def told_lines(chapters: DataFrame, rules: Rules) -> DataFrame:
    """(book, chapter_no, url, at, text, key, value, kind, owner, reader, thing): the lines of each chapter that are not blank. `kind` and `owner`
    are the block a line stands in and whom it is about, null outside; `reader` whose records are being read; `thing` what the block
    before was about. A block goes on over narration while its own keys come back within REACH paragraphs."""
    lines = chapters.where("source_text is not null").select("book", "chapter_no", "url", F.posexplode(F.split("source_text", "\n")).alias("at", "raw")).withColumn("text", F.trim("raw")).where("text <> ''")
    parts = lines.select("book", "chapter_no", "url", "at", "text", F.nullif(F.regexp_extract("text", LINE, 1), F.lit("")).alias("key"), F.regexp_extract("text", LINE, 2).alias("value"))
    named = F.get(_items(F.col("value")), F.lit(0))
    said = F.regexp_like("value", F.lit("^[\"“”'‘’]"))
    who = F.when(named.isin(rules.main, *rules.names), rules.main).otherwise(named)
    begins = F.when(F.col("key").isin(*rules.subjects) & ~said, F.struct(F.lit("state").alias("kind"), F.coalesce(who, F.lit(rules.main)).alias("of"), F.col("at").alias("start")))
    begins = begins.when(F.col("key").isin(*rules.owned) & named.isNotNull(), F.struct(F.col("key").alias("kind"), named.alias("of"), F.col("at").alias("start")))
    along = Window.partitionBy("url").orderBy("at")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    subject = F.when(F.col("key").isin(*rules.subjects) & ~said, F.coalesce(who, F.lit(rules.main)))
    placed = parts.withColumn("_begins", begins).select("*", F.last("_begins", True).over(upto).alias("_open"), F.count(F.when(F.col("key").isNull(), 1)).over(upto).alias("_told"), F.coalesce(F.last(subject, True).over(upto), F.lit(rules.main)).alias("reader"))
    kind = F.col("_open.kind")
    knows = F.col("_begins").isNotNull() | _among(rules.relations, kind, F.col("key")) | (_among(rules.counters, kind, F.col("key")))
    counts = F.when(F.coalesce(knows, F.lit(False)), F.col("_told"))
    within = Window.partitionBy("url", "_open.start").orderBy("at")
    since = placed.withColumn("_since", F.col("_told") - F.last(counts, True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ended = F.max(F.coalesce(counts.isNotNull() & (F.col("_since") > REACH), F.lit(False)).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)) == 1
    apart = F.coalesce(F.col("key").isin(*rules.shared) & (F.col("_since") > 0), F.lit(False))
    inside = F.col("_open").isNotNull() & counts.isNotNull() & ~ended & ~apart
    thing = F.when(kind != "state", F.col("_open.of"))
    return since.select("book", "chapter_no", "url", "at", "text", "key", "value", F.when(inside, kind).alias("kind"), F.when(inside, F.col("_open.of")).alias("owner"), "reader", F.when((F.col("_since") <= REACH) & ~ended, thing).alias("thing"))


def owner_of(limit: int, owner: str | None, thing: str | None, main: str, known: dict[int, str]) -> str | None:
    """The owner of a counter, which `known` remembers by its limit. Outside of a block it is whose that limit last was; a limit above all of the
    main character's is theirs, one below is the thing's whose block was just read; others are nobody's."""
    if owner is None:
        owner = known.get(limit)
    if owner is None:
        own = [q for q, who in known.items() if who == main]
        owner = main if own and limit > max(own) else thing if own and limit < max(own) else None
    if owner is not None:
        known[limit] = owner
    return owner


def changes(events: Iterator[tuple]) -> Iterator[tuple]:
    """Of events that end in (limit, owner, thing) those that can change a state, whatever it was before: a block's counter whose owner is
    not the one last told, and the first of each kind of counter outside of blocks since then, as all alike come out alike until a
    block tells another owner."""
    told, tried = {}, set()
    for event in events:
        limit, owner, thing = event[-3:]
        if owner is not None and told.get(limit) != owner:
            told[limit] = owner
            tried.clear()
            yield event
        elif owner is None and limit not in told and (limit, thing) not in tried:
            tried.add((limit, thing))
            yield event


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for b in batches:
        yield from b.itertuples(index=False, name=None)


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    while held := list(islice(rows, size)):
        yield pd.DataFrame(held, columns=columns)


def settled(counters: DataFrame, main: str) -> DataFrame:
    """counters(book, key, chapter_no, url, at, n, limit, owner, thing) -> the same rows with the owner of those that have none, as far as the
    book tells it by then. Sorted blocks of a book's counters are reduced to their changes; these are chained in order, which gives
    each block the state at its start; the blocks are then read from there. No task holds more than the limits of a key."""
    dealt = ordered(counters, ["book", "key"], [F.coalesce("chapter_no", F.lit(0)), "url", "at"])
    events = dealt.select("book", "key", F.col("_block").alias("block"), F.col("_at").alias("spot"), "limit", "owner", "thing")
    names, schema = events.columns, events.schema

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = groupby(_rows(batches), key=lambda r: r[:2])
        return _frames((e for _, own in groups for e in changes(own)), names)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def states() -> Iterator[tuple]:
            for (book, key), own in groupby(_rows(batches), key=lambda r: r[:2]):
                known: dict[int, str] = {}
                for block, rows in groupby(own, key=lambda r: r[2]):
                    yield from [(book, key, block, -1, limit, owner, None) for limit, owner in known.items()]
                    for r in rows:
                        owner_of(*r[-3:], main, known)

        return _frames(states(), names)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def owners() -> Iterator[tuple]:
            for _, rows in groupby(_rows(batches), key=lambda r: r[:3]):
                known: dict[int, str] = {}
                for r in rows:
                    owner = owner_of(*r[-3:], main, known)
                    if r[3] >= 0 and r[5] is None and owner is not None:
                        yield r[3], owner

        return _frames(owners(), ["_at", "_found"])

    chain = events.mapInPandas(reduced, schema)
    # a block without changes of its own starts as the one before it ended: every block of the key is in the chain
    blocks = events.groupBy("book", "key", "block").agg(F.min("spot").alias("spot"))
    starts = chain.unionByName(blocks.join(events, ["book", "key", "block", "spot"]).select(*names)).dropDuplicates(["book", "key", "spot"]).repartition("book", "key").sortWithinPartitions("book", "key", "spot")
    again = events.unionByName(starts.mapInPandas(entries, schema)).repartition("book", "key", "block").sortWithinPartitions("book", "key", "block", "spot")
    found = again.mapInPandas(read, "_at long, _found string")
    return dealt.join(found, "_at", "left").select(*[F.coalesce("owner", "_found").alias("owner") if c == "owner" else F.col(c) for c in counters.columns])


def evolutions(book_lines: DataFrame, sightings: DataFrame, marks: DataFrame) -> DataFrame:
    """marks(book, chapter_no, url, at, name) and sightings(book, chapter_no, url, at, seq, name) -> (book, chapter_no, url, name, became): the first
    name after a mark that its book had not shown before and that is not the mark's own, unless another mark or more than WAIT chapters came
    between. book_lines(book, chapter_no, url): all chapters, as only a chapter that was read lets a mark lapse."""
    no = F.coalesce("chapter_no", F.lit(0))
    rows = marks.select("book", "chapter_no", "url", "at", F.lit(-1).alias("seq"), "name", F.lit(True).alias("mark")).unionByName(sightings.select("book", "chapter_no", "url", "at", "seq", "name", F.lit(False).alias("mark")))
    folded = T.search_fold(F.col("name"))
    dealt = ordered(rows.withColumn("fold", folded), ["book"], [no, "url", "at", "seq"])
    marked = F.when(F.col("mark"), F.struct("_at", "chapter_no", "name", "fold"))
    seen = carried(dealt, ["book"], before={"waiting": marked}).where("not mark")
    firsts = seen.groupBy("book", "fold").agg(F.min("_at").alias("_at"))
    fresh = seen.join(firsts, ["book", "fold", "_at"], "left_semi").where("waiting is not null and waiting.fold <> fold")
    previous = carried(ordered(book_lines.select("book", "chapter_no", "url"), ["book"], [no, "url"]), ["book"], before={"_previous": F.col("chapter_no")}).select("url", "_previous")
    lapsed = F.coalesce(F.col("_previous") - F.col("waiting.chapter_no") > WAIT, F.lit(False))
    live = fresh.join(previous, "url").where(~lapsed)
    return live.groupBy("book", F.col("waiting._at").alias("_mark")).agg(F.min_by(F.struct("chapter_no", "url", F.col("waiting.name").alias("name"), F.col("name").alias("became")), "_at").alias("x")).select("book", "x.*")


def ordered_records(chapters: DataFrame, rules: Rules) -> DataFrame:
    """(book, chapter_no, url, at, subject, relation, object): all that the lines tell, in books of any length. Counters are `counts` relations
    of `key n/limit`; what evolved has the relation `became` at the chapter that shows the new name."""
    lines = reliable(told_lines(chapters, rules))
    key = F.col("key")
    head = ["book", "chapter_no", "url", "at"]
    opened = F.create_map(*[x for k, r in rules.owned.items() for x in (F.lit(k), F.lit(r))]) if rules.owned else F.create_map().cast("map<string,string>")
    knows = F.create_map(*[x for (b, k), r in rules.relations.items() for x in (F.lit(f"{b}\t{k}"), F.lit(r))]) if rules.relations else F.create_map().cast("map<string,string>")
    owns = lines.where(key.isin(*rules.owned)).select(*head, F.col("reader").alias("subject"), opened[key].alias("relation"), F.get(_items(F.col("value")), F.lit(0)).alias("object"), F.lit(0).alias("seq"))
    bare = F.col("kind").isNull() & _among(rules.relations, F.lit("state"), key) & F.contains("value", F.lit("["))
    block, about = F.when(bare, "state").otherwise(F.col("kind")), F.when(bare, F.col("reader")).otherwise(F.col("owner"))
    stated = lines.where("key is not null").select(*head, about.alias("subject"), knows[F.concat_ws("\t", block, key)].alias("relation"), F.posexplode(_items(F.col("value"))).alias("seq", "object")).where("subject is not null and relation is not null")
    given = None
    for pattern, relation in rules.awards:
        got = lines.select(*head, F.lit(rules.main).alias("subject"), F.lit(relation).alias("relation"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("object")).withColumn("seq", F.lit(0))
        given = got if given is None else given.unionByName(got)
    facts = owns.where("object is not null").unionByName(stated.select(*owns.columns))
    facts = reliable(facts if given is None else facts.unionByName(given))
    counted = sorted({k for _, k in rules.counters})
    numbers = lines.where(key.isin(*counted)).withColumn("_n", F.regexp_extract("value", COUNTER, 1)).where("_n <> ''")
    mine = F.when(F.col("kind").isNotNull() & _among(rules.counters, F.col("kind"), key), F.col("owner"))
    counters = numbers.select(*head, "key", F.col("_n").try_cast("bigint").alias("n"), F.regexp_extract("value", COUNTER, 2).try_cast("bigint").alias("limit"), mine.alias("owner"), "thing").where("n is not null and limit is not null")
    owned = settled(counters, rules.main).where("owner is not null").select(*head, F.col("owner").alias("subject"), F.lit("counts").alias("relation"), F.concat("key", F.lit(" "), "n", F.lit("/"), "limit").alias("object"))
    marks = lines.select(*head, F.nullif(F.regexp_extract("text", rules.evolving, 1), F.lit("")).alias("name")).where("name is not null")
    sightings = facts.where(F.col("relation").isin(*rules.grown)).select(*head, "seq", F.col("object").alias("name"))
    became = evolutions(chapters.where("source_text is not null"), sightings, marks).select("book", "chapter_no", "url", F.lit(-1).alias("at"), F.col("name").alias("subject"), F.lit("became").alias("relation"), F.col("became").alias("object"))
    return facts.drop("seq").unionByName(owned).unionByName(became)


def unresolved(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(book, name, records): names that the records tell of and nodes(book, name) do not know under the fold of terms, with how many records name
    them. Counters name their subject alone."""
    ends = records.select("book", F.explode(F.when(F.col("relation") == "counts", F.array("subject")).otherwise(F.array("subject", "object"))).alias("name")).where("trim(name) <> ''")
    known = nodes.select("book", T.fold_term(F.col("name")).alias("_fold")).distinct()
    return ends.withColumn("_fold", T.fold_term(F.col("name"))).join(known, ["book", "_fold"], "left_anti").groupBy("book", "name").agg(F.count("*").alias("records"))


#: The rules of the queries.
RULES = Rules(
    main="Ash", names=("Ashen",), owned={"Blade": "owns_blade", "Shade": "owns_shade"},
    relations={("state", "Rank"): "rank", ("state", "Traits"): "trait", ("Blade", "Blade Rank"): "rank", ("Shade", "Shade Rank"): "rank"},
    counters=(("state", "Shards"), ("Shade", "Shards"), ("Blade", "Charge")), shared=("Shards",), awards=((r"\[You have received a Shade: ([^\]]+?)\.?\]", "owns_shade"),), grown=("owns_shade",),
)


def _told(s, d):
    """Chapters with records at their end: who is read, what they own, counters inside and outside of blocks, marks of evolution."""
    k = F.col("doc_id")
    lines = F.concat_ws(
        "\n", "source_text", F.when(k % 3 == 0, F.concat(F.lit("Name: ["), F.when(k % 6 == 0, "Ashen").otherwise(F.concat(F.lit("Reader "), k % 4)), F.lit("]"))), F.when(k % 3 == 0, F.concat(F.lit("Shards: ["), k % 50, F.lit("/"), 1000 * (1 + F.floor(k / 400)), F.lit("]"))),
        F.when(k % 5 == 0, F.lit("The runes shone on.")), F.when(k % 4 == 1, F.concat(F.lit("Shade: [Shade "), F.floor(k / 37), F.lit("]"))), F.when(k % 8 == 1, F.concat(F.lit("Shards: ["), k % 90, F.lit("/"), 200 + 100 * (k % 3), F.lit("]"))),
        F.when(k % 7 == 2, F.lit("He looked up.")), F.when(k % 2 == 1, F.concat(F.lit("Shards: ["), k % 70, F.lit("/"), F.when(k % 5 == 3, 200 + 100 * (k % 4)).otherwise(1000 * (1 + k % 3)), F.lit("]"))), F.when(k % 11 == 4, F.concat(F.lit("[Shade "), F.floor(k / 41), F.lit(" is evolving.]"))),
        F.when(k % 9 == 5, F.concat(F.lit("Traits: [Calm "), k % 3, F.lit("], [Swift]."))), F.when(k % 13 == 6, F.concat(F.lit("[You have received a Shade: Dusk "), F.floor(k / 50), F.lit(".]"))), F.when(k % 10 == 7, F.lit("Blade: [Dawn]\nBlade Rank: Ancient\nCharge: [3/9]")),
    )
    return role(s, d, "chapters").where("source_text is not null").withColumn("source_text", lines)


def _nodes(s, d):
    books = table(s, d, "documents").select(F.col("source").alias("book")).distinct()
    return books.select("book", F.explode(F.array(*map(F.lit, ("Ash", "ancient", "Dawn", "Swift", "Reader 1", "Shade 2")))).alias("name"))


QUERIES = {
    "ordered_records": lambda s, d: ordered_records(_told(s, d), RULES),
    "unresolved_names": lambda s, d: unresolved(ordered_records(_told(s, d), RULES), _nodes(s, d)),
}
ORACLE: dict[str, str] = {}
