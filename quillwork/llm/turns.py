"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then pairs of user and
assistant turns.

Windows flag each turn's fault; a conversation's turns are collected in order, and one fold carries four (cost, audit) structs, the
cheapest way to stand at the start, after a system turn, after a user turn and after an assistant turn. All ways to one place after
as many turns differ in their letters before their ends (letters decide costs, so equal costs rule out that one audit starts the
other), so the least struct now stays least whatever follows, and `least` settles both cost and ties.

A conversation of more than `CHUNK` turns is dealt out over the cluster: range partitions of its turns are folded chunk by chunk from
each of the four places, which gives a chunk as four rows of four structs; these are chained in order, and each chunk then applies
its own part of the chain's edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table
from .secrets import _bound
from .simhash import BROADCAST_IDS

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
#: Turns that one fold takes; a power of two.
CHUNK = 512
PLACES = ("start", "s", "u", "a")
_FAR = 1 << 50
_SPACE = r"[^\x20\x09-\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a checksum of id and turn plants: a turn is dropped, emptied, loses its ends of
    sentences, stands twice or turns into the user's. Null roles and texts are one space, as are null ids and turns in the checksum."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    kept = conversations.where(kind != 0)
    return kept.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_n")).drop("_n")


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(way: Column, cost: Column | int, letter: str | Column) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _places(start: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(start.alias("start"), s.alias("s"), u.alias("u"), a.alias("a"))


def _inserted(at: Column) -> Column:
    """The same places where turns may have been inserted: a user turn anywhere but after one, and an assistant turn after that."""
    u = F.least(at["u"], *[_then(at[p], INSERT, "I") for p in ("start", "s", "a")])
    return _bound(u, lambda user: _places(at["start"], at["s"], user, F.least(at["a"], _then(user, INSERT, "I"))))


def _turned(at: Column, turn: Column) -> Column:
    """The places after one more turn: deleted, or, where it is neither blank nor a duplicate, kept or given another role."""
    may = ~turn["fault"].isin("blank", "duplicate")
    more = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def taken(ways: Column, role: str) -> Column:
        own = turn["initial"] == role
        return F.when(may, _then(ways, F.when(own, KEEP).otherwise(REROLE) + more, F.when(own, "K").otherwise("R")))

    gone = {p: _then(at[p], DELETE, "D") for p in PLACES}
    s = F.when(may & (turn["initial"] == "s"), _then(at["start"], more + KEEP, "K"))
    return _places(gone["start"], F.least(gone["s"], s), F.least(gone["u"], taken(F.least(at["start"], at["s"], at["a"]), "u")), F.least(gone["a"], taken(at["u"], "a")))


def _fold(turns: Column, entry: str = "start") -> Column:
    """The four ways through sorted turn structs from one place."""
    first = _places(*[_way(F.lit(0 if p == entry else _FAR), F.lit("")) for p in PLACES])
    return F.aggregate(turns, _inserted(first), lambda at, turn: _bound(_turned(at, turn), _inserted))


def _applied(turns: Column, audit: Column, entry: Column) -> Column:
    """array<struct<role, text>>: the turns after the edits; what an inserted or reroled turn becomes follows from the one before."""
    first = F.struct(F.lit(0).alias("at"), entry.alias("last"), F.array().cast("array<struct<role:string,text:string>>").alias("out"))

    def step(acc: Column, letter: Column) -> Column:
        turn = F.get(turns, acc["at"])
        role = F.when(letter == "K", turn["role"]).when(acc["last"] == "u", "assistant").otherwise("user")
        text = F.when(letter == "I", "").otherwise(turn["text"])
        put = F.struct(
            (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"),
            F.when(letter == "D", acc["last"]).otherwise(F.substring(role, 1, 1)).alias("last"),
            F.when(letter == "D", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(role.alias("role"), text.alias("text"))))).alias("out"),
        )
        return put

    return F.aggregate(F.regexp_extract_all(audit, F.lit("."), F.lit(0)), first, step)["out"]


def _fault(seen: Column) -> Column:
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(~F.col("text").rlike(_SPACE), "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def _turn() -> Column:
    """A turn as it is sorted: by number, nulls first; turns of one number by role and text."""
    return F.struct("turn", "role", "text", "nth", F.substring("role", 1, 1).alias("initial"), "fault")


def _count(fault: str) -> Column:
    return F.size(F.filter("turns", lambda x: x["fault"] == fault)).cast("long").alias(fault)


def _illegal(turns: Column) -> Column:
    return F.size(F.filter(turns, lambda x, i: (i > 0) & ~F.concat(F.get(turns, i - 1)["initial"], x["initial"]).isin(*LEGAL))).cast("long")


def _short(rows: DataFrame) -> DataFrame:
    """One shuffle by conversation serves the window, the collecting and the fold."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    flagged = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same)).withColumn("fault", _fault(F.col("nth") > 1))
    told = flagged.groupBy("conv_id").agg(F.sort_array(F.collect_list(_turn())).alias("turns"))
    numbers = F.array_distinct(F.filter(F.transform("turns", lambda x: x["turn"]), lambda n: n.isNotNull()))
    gaps = F.when(F.size("numbers") == 0, 0).otherwise(F.array_max("numbers") - F.array_min("numbers") + 1 - F.size("numbers")).cast("long")
    solved = told.withColumn("numbers", numbers).withColumn("ways", F.inline(F.array(F.struct(_fold(F.col("turns")).alias("ways")))))
    best = F.least("ways.start", "ways.a")
    return solved.select(
        "conv_id", gaps.alias("gaps"), _count("blank"), _count("duplicate"), _count("truncated"), _illegal(F.col("turns")).alias("illegal"),
        best["cost"].alias("cost"), best["audit"].alias("audit"), _applied(F.col("turns"), best["audit"], F.lit("")).alias("repaired"),
    )


def _chained(parts: Column) -> Column:
    """Four ways over a conversation's chunks in order; `path` holds the place at which each chunk was entered."""
    first = F.array(*[F.struct(F.lit(0 if k == 0 else _FAR).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path")) for k in range(4)])

    def link(acc: Column, part: Column) -> Column:
        on = lambda i, j: F.struct((acc[i]["cost"] + part["ways"][i][PLACES[j]]["cost"]).alias("cost"), F.concat(acc[i]["audit"], part["ways"][i][PLACES[j]]["audit"]).alias("audit"), F.concat(acc[i]["path"], F.lit(str(i))).alias("path"))
        return F.array(*[F.least(*[on(i, j) for i in range(4)]) for j in range(4)])

    return F.aggregate(parts, first, link)


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """Turns dealt out by ranges of (conversation, turn, role, text); places in a sorted partition number the chunks."""
    keyed = rows.withColumn("key", F.to_json(F.struct("conv_id"))).withColumn("_head", F.substring("text", 1, 64))
    dealt = keyed.repartitionByRange("key", F.asc_nulls_first("turn"), "role", "_head").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text").drop("_head")
    ordered = stage(dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("same", F.md5(F.col("text").cast("binary"))), "turns")
    firsts = ordered.groupBy("key", "role", "same").agg(F.min("id").alias("first"))
    flagged = ordered.join(firsts, ["key", "role", "same"]).withColumn("fault", _fault(F.col("id") > F.col("first"))).withColumn("nth", F.lit(0))
    parts = flagged.groupBy("key", F.floor(F.col("id") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("id", _turn().alias("x")))).alias("sorted"), F.first("conv_id").alias("conv_id"))
    parts = parts.withColumn("turns", F.transform("sorted", lambda p: p["x"])).drop("sorted")
    folded = F.array(*[_fold(F.col("turns"), p) for p in PLACES])
    parts = stage(parts.select("key", "conv_id", "chunk", "turns", folded.alias("ways"), _count("blank"), _count("duplicate"), _count("truncated"), _illegal(F.col("turns")).alias("illegal")), "turn-chunks")
    ends = parts.select("*", F.get("turns", F.lit(0))["initial"].alias("head"), F.element_at("turns", -1)["initial"].alias("tail"))
    told = ends.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("illegal").alias("within"),
        F.sort_array(F.collect_list(F.struct("chunk", "ways", F.col("head").alias("initial"), "tail"))).alias("chunks"),
    )
    seams = F.size(F.filter("chunks", lambda x, i: (i > 0) & ~F.concat(F.get("chunks", i - 1)["tail"], x["initial"]).isin(*LEGAL)))
    ends_at = lambda k: F.struct(F.col("chained")[k]["cost"].alias("cost"), F.col("chained")[k]["audit"].alias("audit"), F.concat(F.col("chained")[k]["path"], F.lit(str(k))).alias("path"))
    solved = told.withColumn("chained", _chained(F.col("chunks"))).withColumn("best", F.least(ends_at(0), ends_at(3)))
    solved = stage(solved.select("key", "conv_id", "blank", "duplicate", "truncated", (F.col("within") + seams).alias("illegal"), "best", F.transform("chunks", lambda x: x["chunk"]).alias("chunks")), "turn-chains")
    taken = solved.select("key", F.posexplode("chunks").alias("n", "chunk"), F.col("best.path").alias("path"))
    place = lambda at: F.substring(F.col("path"), at, F.lit(1)).cast("int")
    edits = parts.join(taken, ["key", "chunk"]).withColumn("entry", place(F.col("n") + 1)).withColumn("exit", place(F.col("n") + 2))
    way = F.get("ways", F.col("entry"))
    audit = F.get(F.array(*[way[p]["audit"] for p in PLACES]), F.col("exit"))
    entry = F.get(F.array(F.lit(""), *map(F.lit, PLACES[1:])), F.col("entry"))
    pieces = edits.select("key", "chunk", _applied(F.col("turns"), audit, entry).alias("out"))
    repaired = pieces.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "out"))), lambda x: x["out"])).alias("repaired"))
    numbers = ordered.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    return solved.join(numbers, "key").join(repaired, "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "repaired")


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired array<struct<role, text>>), a row per conversation.

    Null roles and texts are one space; null turns come first; turns of one number go by role and then text; a null id is a
    conversation of its own; repeated rows are duplicates; an empty table gives no rows; other columns are ignored. Texts of any
    length stay whole. A conversation's repaired turns are one value and must fit a row, as the caller wants it; all work before
    that is done on `chunk` turns at a time."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    many = stage(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(F.to_json(F.struct("conv_id")).alias("_key")), "long-conversations")
    n = many.count()
    if not n:
        return _short(rows)
    many, key = F.broadcast(many) if n <= BROADCAST_IDS else many, F.to_json(F.struct("conv_id"))
    on = key == F.col("_key")
    return _short(rows.join(many, on, "left_anti")).unionByName(_long(rows.join(many, on, "left_semi"), chunk))


def digest(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """The contract's columns for every id, also where no row of it was left."""
    written = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    found = repaired.select(F.col("conv_id").alias("_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(written, 256).alias("repaired_sha256"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = ids.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return digest(repair(damage(conversations)), conversations)


def oracle() -> str:
    """The same in DuckDB: a checksum folded over the key's bytes, the four ways by list_reduce, the edits by another."""
    crc = "list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda d, j: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END, xor(c, b)), 4294967295)"
    then = lambda way, cost, letter: f"{{'c': {way}.c + {cost}, 't': concat({way}.t, {letter})}}"
    inserted = lambda p: f"list_transform([least({p}.u, {then(p + '.z', 3, chr(39) + 'I' + chr(39))}, {then(p + '.s', 3, chr(39) + 'I' + chr(39))}, {then(p + '.a', 3, chr(39) + 'I' + chr(39))})], lambda w: {{'z': {p}.z, 's': {p}.s, 'u': w, 'a': least({p}.a, {then('w', 3, chr(39) + 'I' + chr(39))})}})[1]"
    gone = lambda p: then(f"q.{p}", 4, "'D'")
    more = "(CASE WHEN x.fault = 'truncated' THEN 3 ELSE 0 END)"
    taken = lambda way, role: f"CASE WHEN x.fault IN ('blank', 'duplicate') THEN NULL ELSE list_transform([{way}], lambda v: {then('v', f'(CASE WHEN x.i = {role} THEN 0 ELSE 3 END) + {more}', f'CASE WHEN x.i = {role} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')})[1] END"
    turned = f"{{'z': {gone('z')}, 's': least({gone('s')}, CASE WHEN x.fault IN ('blank', 'duplicate') OR x.i <> 's' THEN NULL ELSE {then('q.z', more, chr(39) + 'K' + chr(39))} END), 'u': least({gone('u')}, {taken('least(q.z, q.s, q.a)', chr(39) + 'u' + chr(39))}), 'a': least({gone('a')}, {taken('q.u', chr(39) + 'a' + chr(39))})}}"
    far = f"{{'c': CAST({_FAR} AS BIGINT), 't': ''}}"
    first = f"{{'z': {{'c': CAST(0 AS BIGINT), 't': ''}}, 's': {far}, 'u': {{'c': CAST(3 AS BIGINT), 't': 'I'}}, 'a': {{'c': CAST(6 AS BIGINT), 't': 'II'}}}}"
    fold = f"list_reduce(turns, lambda q, x: list_transform([{turned}], lambda p: {inserted('p')})[1], {first})"
    role = "CASE WHEN l = 'K' THEN turns[q.n].role WHEN q.last = 'u' THEN 'assistant' ELSE 'user' END"
    edits = f"list_reduce(string_split(audit, ''), lambda q, l: {{'n': q.n + CASE WHEN l = 'I' THEN 0 ELSE 1 END, 'last': CASE WHEN l = 'D' THEN q.last ELSE substr({role}, 1, 1) END, 'o': CASE WHEN l = 'D' THEN q.o ELSE list_append(q.o, concat({role}, ':', CASE WHEN l = 'I' THEN '' ELSE turns[q.n].text END)) END}}, {{'n': 1, 'last': '', 'o': CAST([] AS VARCHAR[])}})"
    return rf"""WITH keyed AS (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
        marked AS (SELECT conv_id, turn, xor({crc}, 4294967295) % 20 AS kind, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM keyed),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS n FROM marked WHERE kind <> 0),
        nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged),
        faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM nth),
        told AS (SELECT conv_id, list({{'role': role, 'text': text, 'i': substr(role, 1, 1), 'fault': fault}} ORDER BY turn NULLS FIRST, role, text, seen) AS turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM faults GROUP BY conv_id),
        solved AS (SELECT *, {fold} AS ways FROM told),
        best AS (SELECT *, least(ways.z, ways.a).c AS cost, least(ways.z, ways.a).t AS audit FROM solved),
        done AS (SELECT *, len(list_filter(range(2, len(turns) + 1), lambda i: concat(turns[i - 1].i, turns[i].i) NOT IN ('su', 'ua', 'au'))) AS illegal, CASE WHEN audit = '' THEN '' ELSE array_to_string({edits}.o, chr(10)) END AS written FROM best)
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
            CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(written, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""
