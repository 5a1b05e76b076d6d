"""Views over jobs, the ledger and the graph: counts, metrics, histories as a reader may know them, aliases, senses, evidence."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.containment import holding
from ..plans.components import reliable
from ..plans.ordered import numbered
from ..sources.tables import duck, role, shared, sql_role
from .ledger import address_table

#: Seconds that a job belongs to its worker.
LEASE = 1200
#: Leases that one zone of a key's times is long: at whole seconds it has some 77 000 times at most.
ZONE_LEASES = 64
#: Fixed order of priorities.
PRIORITIES = ("critical", "high", "medium", "low")
LEAST_LOWER = 0.3


def job_states(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("book", "state").agg(F.count("*").alias("jobs"))


def in_flight(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Attempts per book whose outcome is not known."""
    return attempts.where("state = 'flying'").join(jobs.select(F.col("id").alias("job"), "book"), "job").groupBy("book").agg(F.count("*").alias("attempts"), F.countDistinct("job").alias("jobs"))


def leased(requests: DataFrame, lease: int = LEASE) -> DataFrame:
    """requests(work, worker, at seconds, content) -> (key, worker, at, granted): work is known by its content, and a request gets it
    if nobody has it or the lease that the last grant gave has run out; of requests of one time the first worker's. Grants follow each other by
    more than a lease, so the next one is the first request after the lease of the one before. A request without a time is granted and holds nothing.

    A key's times are cut into zones of ZONE_LEASES leases. What a zone makes of the grant before it depends on the first time after that grant's
    lease alone, so each zone tells its last grant for every such time, the zones of a key are chained by these, and
    then every zone is walked from the grant it begins with. No task holds more than a zone's times or a key's zones."""
    keyed = requests.select(F.sha2(F.to_json(F.struct("work", "content")), 256).alias("key"), "worker", "at")
    zone = F.col("at") - F.pmod("at", F.lit(ZONE_LEASES * max(lease, 1)))
    times = reliable(keyed.where("at is not null").groupBy("key", zone.alias("zone")).agg(F.sort_array(F.collect_set("at")).alias("t")))

    def lasting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [last_grants(t, lease) for t in b.t]
            yield pd.DataFrame({"key": b.key, "zone": b.zone, "first": [x for x, _ in told], "last": [y for _, y in told]})

    def chained(zones: pd.DataFrame) -> pd.DataFrame:
        zones, held, before = zones.sort_values("zone"), None, []
        for first, last in zip(zones["first"], zones["last"], strict=True):
            before.append(held)
            at = 0 if held is None else bisect_right(first, held + lease)
            held = last[at] if at < len(first) else held
        return pd.DataFrame({"key": zones.key, "zone": zones.zone, "held": pd.array(before, "Int64")})

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(key, at) for key, t, held in zip(b.key, b.t, b.held, strict=True) for at in grants(t, None if pd.isna(held) else int(held), lease)]
            yield pd.DataFrame(found, columns=["key", "at"])

    begun = times.mapInPandas(lasting, "key string, zone long, first array<long>, last array<long>").groupBy("key").applyInPandas(chained, "key string, zone long, held long")
    granted = times.join(begun, ["key", "zone"]).mapInPandas(walked, "key string, at long").withColumn("_granted", F.lit(True))
    rows = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("key", "at").orderBy("worker"))).join(granted, ["key", "at"], "left")
    return rows.select("key", "worker", "at", (F.col("at").isNull() | ((F.col("_n") == 1) & F.col("_granted").isNotNull())).alias("granted"))


def grants(times: Sequence[int], held: int | None, lease: int) -> Iterator[int]:
    """The granted of distinct rising times, after a grant at `held`."""
    at = 0 if held is None else bisect_right(times, held + lease)
    while at < len(times):
        yield int(times[at])
        at = bisect_right(times, times[at] + lease)


def last_grants(times: Sequence[int], lease: int) -> tuple[list[int], list[int]]:
    """(first, last): if the first grant among these times is later than the entry of `first` before and not later than this one, the last grant
    is this entry of `last`. A grant before them has its lease run out by a lease after the first time."""
    last, times = [], [int(t) for t in times]
    after = np.searchsorted(times, np.array(times) + lease, side="right").tolist()
    for at in range(len(times) - 1, -1, -1):
        last.append(times[at] if after[at] == len(times) else last[len(times) - 1 - after[at]])
    last.reverse()
    asked = range(min(after[0] + 1, len(times)))
    ends = [k for k in asked if k == len(asked) - 1 or last[k] != last[k + 1]]
    return [times[k] for k in ends], [last[k] for k in ends]


def ledger_metrics(runs: DataFrame, prices: DataFrame, forms: DataFrame) -> DataFrame:
    """Per book: completed chapters, tokens, cost and cost per completed chapter (unpriced models cost nothing), mean seconds of
    completed runs that have any, and the share of later forms that break a stable form of address. forms(book, chapter, id, subject,
    object, form, late)."""
    done = F.col("state") == "completed"
    spent = F.coalesce((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6, F.lit(0.0))
    per = runs.join(prices, "model", "left").groupBy("book").agg(F.countDistinct(F.when(done, F.col("chapter"))).alias("completed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.bround(F.sum(spent), 4).alias("cost"), F.bround(F.avg(F.when(done & (F.col("seconds") > 0), F.col("seconds"))), 1).alias("mean_seconds"))
    firm = address_table(forms.where("not late")).where("stable").select("book", "subject", "object", F.col("form").alias("expected"))
    held = forms.where("late").join(firm, ["book", "subject", "object"]).groupBy("book").agg(F.bround(F.avg((F.col("form") != F.col("expected")).cast("double")), 3).alias("deviation_rate"))
    each = F.when(F.col("completed") > 0, F.bround(F.col("cost") / F.col("completed"), 5))
    return per.withColumn("cost_per_chapter", each).join(held, "book", "left")


def value_history(values: DataFrame, as_of: int) -> DataFrame:
    """Every value a reader at a chapter may know of, with its status as far as that reader knows: one that was refuted later still stands."""
    status = F.when(F.col("refuted_at") <= as_of, "disproven").when(F.col("confirmed"), "confirmed").otherwise("believed")
    return values.where(F.col("learned_at") <= as_of).select("book", "node", "key", "value", "learned_at", "seq", status.alias("status"))


def flat_fields(history: DataFrame, as_of: int | None, lists: tuple[str, ...]) -> DataFrame:
    """history(book, record, field, entries array<struct<value, chapter>>) -> (book, record, field, value): the last value a reader may
    know, and of list fields all of them, comma-joined; an unknown chapter is known from the start."""
    known = F.filter("entries", lambda e: F.coalesce(e["chapter"], F.lit(0)) <= as_of) if as_of is not None else F.col("entries")
    seen = history.select("book", "record", "field", known.alias("k")).where(F.size("k") > 0)
    every = F.array_join(F.transform("k", lambda e: e["value"]), ",")
    return seen.select("book", "record", "field", F.when(F.col("field").isin(*lists), every).otherwise(F.element_at("k", -1)["value"]).alias("value"))


def aliases_of(edges: DataFrame, nodes: DataFrame, as_of: int, relations: tuple[str, ...]) -> DataFrame:
    """(book, src, names): the other names a node has by a chapter, from alias edges that are not rejected; unknown learning times
    count as known."""
    tied = edges.where(F.col("relation").isin(*relations) & (F.col("status") != "rejected") & (F.coalesce("learned_at", F.lit(0)) <= as_of))
    named = tied.join(nodes.select(F.col("node").alias("dst"), "name"), "dst")
    return named.groupBy("book", "src").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def named_senses(senses: DataFrame, terms: DataFrame) -> DataFrame:
    """Further senses that are names, with the term's source."""
    return senses.where("is_name").join(terms.select("book", "node", "source"), ["book", "node"]).select("book", "node", "source", "sense", "target", "first_chapter")


def evidence_samples(mentions: DataFrame, hint: str, cap: int = 5) -> DataFrame:
    """Per entity `cap` sentences at most: those with a hint first, the earliest of each kind, returned in order."""
    order = Window.partitionBy("book", "node").orderBy(F.when(F.col("sentence").rlike(hint), 0).otherwise(1), "chapter", "id")
    return mentions.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).select("book", "node", "chapter", "id", F.col("sentence").rlike(hint).alias("hinted"))


def stratified_slices(chapters: DataFrame, seed: int, parts: int, total: int) -> DataFrame:
    """(book, part, chapter_no, start, text): of each book `parts` slices of chapters at equal distances, shifted by a keyed digest, and
    within a chapter of `total` / `parts` characters from a keyed place on, edges snapped to line ends. Digests instead of a random
    generator make the slices repeatable wherever they are cut."""
    size = max(500, total // parts)
    told = chapters.where("source_text is not null and chapter_no is not null").select("book", "chapter_no", "url", "source_text")
    counts = told.groupBy("book").agg(F.count("*").alias("n"))
    place = reliable(numbered(told.select("book", "chapter_no", "url"), ["book"], ["chapter_no", "url"], "_r").join(counts, "book").select("book", "chapter_no", "url", (F.col("_r") - 1).alias("at"), "n"))
    draw = lambda *what: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *what), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    books = place.select("book", "n").distinct().select("book", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(parts), F.col("n")).cast("int") - 1)).alias("part"))
    asked = books.select("book", "part", F.least(F.col("n") - 1, F.floor((F.col("part") + draw(F.col("book"), F.col("part").cast("string"))) * F.col("n") / parts)).cast("int").alias("at"))
    chosen = asked.join(place, ["book", "at"]).select("book", "part", "url").join(told, ["book", "url"])
    n = F.length("source_text")
    start = F.floor(draw(F.lit("start"), F.col("url")) * F.greatest(F.lit(1), n - size)).cast("int")
    head = F.when(n <= size, 0).otherwise(F.length(F.regexp_extract(F.substring(F.col("source_text"), F.lit(1), start), r"(?s)^(.*\n)?", 0)))
    cut = chosen.withColumn("_start", start).withColumn("start", head)
    tail = F.regexp_extract(F.expr(f"substring(source_text, _start + {size} + 1)"), r"^[^\n]*", 0)
    text = F.when(n <= size, F.col("source_text")).otherwise(F.expr(f"substring(source_text, start + 1, _start + {size} - start)"))
    return cut.select("book", F.col("part").cast("long").alias("part"), "chapter_no", F.col("start").cast("long").alias("start"), F.concat(text, F.when(n <= size, F.lit("")).otherwise(tail)).alias("text"))


def accepted_items(items: DataFrame, paragraphs: DataFrame, kinds: tuple[str, ...], longest: int = 200) -> DataFrame:
    """items(id, url, kind, source, target, quote) -> (id, reason): null where an item is accepted. The quote stands word for word in
    one paragraph and holds the source; a term is offered once (the first by id), and a person keeps its name."""
    said = items.join(paragraphs.select("url", "paragraph"), "url", "left").groupBy("id", "url", "kind", "source", "target", "quote").agg(F.max(F.coalesce(F.contains("paragraph", "quote"), F.lit(False)).cast("int")).alias("_there"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True)) | (F.length(c) > longest)
    proven = (F.col("_there") == 1) & (F.trim("quote") != "") & ~blank("source") & ~blank("target") & F.col("kind").isin(*kinds) & F.coalesce(F.contains("quote", "source"), F.lit(False))
    first = Window.partitionBy("url", T.fold_term(F.col("source")), "_proven").orderBy("id")
    ranked = said.withColumn("_proven", F.coalesce(proven, F.lit(False))).withColumn("_r", F.row_number().over(first))
    reason = F.when(~F.col("_proven"), "no evidence").when(F.col("_r") > 1, "offered before").when((F.col("kind") == "person") & (F.col("source") != F.col("target")), "renamed person")
    return ranked.select("id", reason.alias("reason"))


def lower_share(claims: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, name, lower, upper, share, doubtful): how often a claimed one-word name is written small in the chapters that claim it;
    from three tenths on it is doubtful as a name. Words of the chapters meet the names on (book, chapter, word)."""
    words = chapters.where("source_text is not null and chapter_no is not null").select("book", F.col("chapter_no").alias("chapter"), F.explode(F.regexp_extract_all("source_text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    counted = words.groupBy("book", "chapter", F.lower("w").alias("key")).agg(F.count(F.when(F.substring("w", 1, 1) == F.lower(F.substring("w", 1, 1)), 1)).alias("lower"), F.count("*").alias("n"))
    names = claims.select("book", "chapter", "name", F.lower("name").alias("key")).distinct()
    per = names.join(counted, ["book", "chapter", "key"]).groupBy("book", "name").agg(F.sum("lower").alias("lower"), (F.sum("n") - F.sum("lower")).alias("upper"))
    share = F.col("lower") / (F.col("lower") + F.col("upper"))
    return per.select("book", "name", "lower", "upper", F.round(share, 6).alias("share"), (share >= LEAST_LOWER).alias("doubtful"))


def run_means(runs: DataFrame) -> DataFrame:
    """Means of a setting's runs."""
    return runs.groupBy("setting").agg(F.count("*").alias("runs"), F.round(F.avg("tokens"), 6).alias("tokens"), F.round(F.avg("ratio"), 6).alias("ratio"), F.round(F.avg("seconds"), 6).alias("seconds"))


def person_summary(edges: DataFrame, addresses: DataFrame, items: DataFrame) -> DataFrame:
    """(book, node, edges, stable, mixed, items) of all that any of the three knows: edges at either end, address pairs as speaker."""
    ends = edges.select("book", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("book", "node").agg(F.count("*").alias("edges"))
    pairs = addresses.groupBy("book", F.col("subject").alias("node")).agg(F.count(F.when(F.col("stable"), 1)).alias("stable"), F.count(F.when(~F.col("stable"), 1)).alias("mixed"))
    owned = items.groupBy("book", F.col("owner").alias("node")).agg(F.countDistinct("item").alias("items"))
    return reduce(lambda a, b: a.join(b, ["book", "node"], "full_outer"), (ends, pairs, owned)).na.fill(0, ["edges", "stable", "mixed", "items"])


def by_priority(lines: DataFrame) -> DataFrame:
    """Lines with their rank in the order of PRIORITIES (others last), then by name without regard to ASCII case, then by id."""
    step = F.coalesce(*[F.when(F.col("priority") == p, i) for i, p in enumerate(PRIORITIES)], F.lit(len(PRIORITIES)))
    plain = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return numbered(lines.select("book", "id", "priority", "name"), ["book"], [step, plain, "id"], "rank")


def profile_evidence(proposals: DataFrame, samples: DataFrame, least: int = 2) -> DataFrame:
    """proposals(id, book, field, value, quote) -> (id, chapter, uses, accepted): the first sample chapter that holds the quote word for
    word, and in how many samples the value stands; accepted with both, the value inside the quote. Quotes and values go to the samples
    as an index; what comes back is counted by string before proposals are met again."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = reliable(proposals.select("id", "book", "value", "quote", squeezed("quote").alias("_quote")))
    needles = asked.select("book", F.col("_quote").alias("needle")).unionByName(asked.select("book", F.col("value").alias("needle")))
    found = holding(samples.select("book", "chapter_no", squeezed("text").alias("text")), "text", needles)
    per = reliable(found.groupBy("book", "needle").agg(F.min("chapter_no").alias("chapter"), F.count("*").alias("uses")))
    quoted = per.select("book", F.col("needle").alias("_quote"), "chapter")
    used = per.select("book", F.col("needle").alias("value"), "uses")
    blank = samples.groupBy("book").agg(F.count("text").alias("_all"))  # an empty value stands in every sample
    out = asked.join(quoted, ["book", "_quote"], "left").join(used, ["book", "value"], "left").join(blank, "book", "left")
    uses = F.coalesce(F.when(F.col("value") == "", F.col("_all")).otherwise(F.col("uses")), F.lit(0))
    return out.select("id", "chapter", uses.alias("uses"), (F.col("chapter").isNotNull() & (uses >= least) & F.coalesce(F.contains("quote", "value"), F.lit(False))).alias("accepted"))


# Inputs of the queries, in SQL that both engines read.
_ATTEMPTS = "(SELECT id * 10 AS id, id AS job, CASE WHEN id % 3 = 0 THEN 'flying' ELSE 'landed' END AS state FROM {jobs} UNION ALL SELECT id * 10 + 1, id, 'flying' FROM {jobs} WHERE id % 9 = 0)"
_RUNS = "(SELECT concat('b', chapter % 3) AS book, CAST(id % 50 AS INT) AS chapter, model, CASE outcome WHEN 'success' THEN 'completed' ELSE 'failed' END AS state, tokens_in, tokens_out, CAST(duration_ms AS DOUBLE) / 1000 AS seconds FROM {calls})"
_FORMS = "(SELECT book, chapter, id, subject, object, CASE WHEN id % 10 > 1 THEN 'sen' ELSE form END AS form, chapter > 30 AS late FROM {claims})"
_HISTORY = "(SELECT *, seq % 4 = 0 AS confirmed, CASE WHEN seq % 5 = 0 THEN learned_at + 6 END AS refuted_at FROM {node_values})"
_FIELDS = "(SELECT book, node AS record, key AS field, value, CASE WHEN seq % 13 = 0 THEN NULL ELSE learned_at END AS chapter, seq FROM {node_values})"
_SENSES = "(SELECT book, concat(book, '#', source) AS node, length(source) % 3 AS sense, concat(target, 'e') AS target, length(source) % 2 = 0 AS is_name, first_chapter FROM {terms})"
_NODES = "(SELECT book, concat(book, '#', source) AS node, source FROM {terms})"
_MENTIONS = "(SELECT book, object AS node, chapter, id, CASE WHEN id % 7 = 0 THEN concat('became ', evidence) ELSE evidence END AS sentence FROM {claims})"
_ITEMS = "(SELECT doc_id AS id, url, CASE doc_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'place' ELSE 'odd' END AS kind, substring(source_text, 3, 6) AS source, CASE WHEN doc_id % 2 = 0 THEN substring(source_text, 3, 6) ELSE 'hedef' END AS target, CASE WHEN doc_id % 5 = 0 THEN concat('x', substring(source_text, 1, 30)) ELSE substring(source_text, 1, 12) END AS quote FROM {chapters} UNION ALL SELECT doc_id + 1000000, url, 'place', substring(source_text, 3, 6), 'hedef', substring(source_text, 1, 12) FROM {chapters} WHERE doc_id % 4 = 0)"
_NAMED = "(SELECT book, chapter_no AS chapter, regexp_extract(source_text, '[A-Z][a-z]{{3,}}', 0) AS name FROM {chapters} WHERE chapter_no IS NOT NULL)"
_SETTINGS = "(SELECT stage AS setting, tokens_in AS tokens, CAST(tokens_out AS DOUBLE) / (tokens_in + 1) AS ratio, CAST(duration_ms AS DOUBLE) / 1000 AS seconds FROM {calls})"
_LINES = "(SELECT book, id, CASE id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'odd' END AS priority, CASE WHEN id % 2 = 0 THEN upper(object) ELSE object END AS name FROM {claims})"
_OFFERED = "(SELECT doc_id AS id, book, 'voice' AS field, regexp_extract(source_text, '[A-Za-z]{{5,}}', 0) AS value, CASE WHEN doc_id % 4 = 0 THEN concat(substring(source_text, 1, 40), '!?') ELSE substring(source_text, 1, 60) END AS quote FROM {chapters} WHERE source_text IS NOT NULL)"
_SAMPLES = "(SELECT book, chapter_no, source_text AS text FROM {chapters} WHERE source_text IS NOT NULL)"
_HINT = "became|born|died"


def _prices(s):
    return s.createDataFrame([("model-click", 0.5, 2.0), ("model-view", 1.0, 4.0)], "model string, price_in double, price_out double")


def _requests(s, d):
    return role(s, d, "events_log").select((F.col("slug") % 7).alias("work"), F.concat(F.lit("w"), F.col("event_id") % 5).alias("worker"), F.unix_timestamp("ts").alias("at"), (F.col("slug") % 3).alias("content"))


def _fields(s, d):
    entries = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("chapter", F.lit(0)).alias("k"), "seq", "value", "chapter"))), lambda e: F.struct(e["value"].alias("value"), e["chapter"].alias("chapter")))
    return shared(s, d, _FIELDS).groupBy("book", "record", "field").agg(entries.alias("entries"))


def _alias_nodes(s, d):
    return role(s, d, "edges").select(F.col("dst").alias("node")).distinct().withColumn("name", F.upper("node"))


def _chapter_paragraphs(s, d):
    return role(s, d, "chapters").where("source_text is not null").select("url", F.explode(F.split("source_text", "\n")).alias("paragraph"))


QUERIES = {
    "job_states": lambda s, d: job_states(role(s, d, "jobs")),
    "jobs_in_flight": lambda s, d: in_flight(shared(s, d, _ATTEMPTS), role(s, d, "jobs")),
    "leased_jobs": lambda s, d: leased(_requests(s, d)),
    "ledger_metrics": lambda s, d: ledger_metrics(shared(s, d, _RUNS), _prices(s), shared(s, d, _FORMS)),
    "value_history": lambda s, d: value_history(shared(s, d, _HISTORY), 100),
    "flat_fields": lambda s, d: flat_fields(_fields(s, d), 100, ("1-URGENT", "2-HIGH")),
    "alias_names": lambda s, d: aliases_of(role(s, d, "edges"), _alias_nodes(s, d), 90, ("rel_A", "rel_R")),
    "named_senses": lambda s, d: named_senses(shared(s, d, _SENSES), shared(s, d, _NODES)),
    "evidence_samples": lambda s, d: evidence_samples(shared(s, d, _MENTIONS), _HINT),
    "stratified_slices": lambda s, d: stratified_slices(role(s, d, "chapters"), 42, 6, 3600),
    "accepted_items": lambda s, d: accepted_items(shared(s, d, _ITEMS), _chapter_paragraphs(s, d), ("person", "place")),
    "lower_case_share": lambda s, d: lower_share(shared(s, d, _NAMED), role(s, d, "chapters")),
    "run_means": lambda s, d: run_means(shared(s, d, _SETTINGS)),
    "person_summary": lambda s, d: person_summary(role(s, d, "edges"), address_table(role(s, d, "claims")), role(s, d, "claims").select("book", F.col("subject").alias("owner"), F.col("object").alias("item"))),
    "priority_order": lambda s, d: by_priority(shared(s, d, _LINES)),
    "profile_evidence": lambda s, d: profile_evidence(shared(s, d, _OFFERED), shared(s, d, _SAMPLES)),
}
_E, _CL, _CH = sql_role("edges"), sql_role("claims"), sql_role("chapters")
_SQ = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_TABLE = lambda src: f"(SELECT book, subject, object, CAST(sum(k) AS BIGINT) AS n, arg_min(form, (-k, form)) AS form, sum(k) >= 3 AND max(k) >= 0.8 * sum(k) AS stable FROM (SELECT book, subject, object, form, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY book, subject, object ORDER BY chapter DESC, id DESC) AS r FROM {src}) a WHERE r <= 15 GROUP BY ALL) b GROUP BY book, subject, object)"
_FOLD = "lower(regexp_replace(trim(source), '[\\s\\-_''’.·]+', '', 'g'))"
_DRAW = lambda *what: f"(CAST(concat('0x', substring(sha256(concat_ws(':', '42', {', '.join(what)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
ORACLE = {
    "job_states": f"SELECT book, state, count(*) AS jobs FROM {sql_role('jobs')} j GROUP BY ALL",
    "jobs_in_flight": f"SELECT book, count(*) AS attempts, count(DISTINCT job) AS jobs FROM {duck(_ATTEMPTS)} a JOIN {sql_role('jobs')} j ON j.id = a.job WHERE a.state = 'flying' GROUP BY book",
    "ledger_metrics": f"""WITH r AS (SELECT * FROM {duck(_RUNS)} r), p(model, price_in, price_out) AS (VALUES ('model-click', 0.5::DOUBLE, 2.0::DOUBLE), ('model-view', 1.0, 4.0)), f AS (SELECT * FROM {duck(_FORMS)} f), t AS (SELECT * FROM {_TABLE('(SELECT * FROM f WHERE NOT late) q')} x WHERE stable),
h AS (SELECT f.book, round_even(avg(CASE WHEN f.form <> t.form THEN 1.0::DOUBLE ELSE 0.0 END), 3) AS deviation_rate FROM f JOIN t ON f.book = t.book AND f.subject = t.subject AND f.object = t.object WHERE late GROUP BY f.book),
m AS (SELECT book, count(DISTINCT CASE WHEN state = 'completed' THEN chapter END) AS completed, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round_even(sum(coalesce((tokens_in * price_in + tokens_out * price_out) / 1e6, 0)), 4) AS cost, round_even(avg(CASE WHEN state = 'completed' AND seconds > 0 THEN seconds END), 1) AS mean_seconds FROM r LEFT JOIN p ON p.model = r.model GROUP BY book)
SELECT m.*, CASE WHEN completed > 0 THEN round_even(cost / completed, 5) END AS cost_per_chapter, deviation_rate FROM m LEFT JOIN h ON h.book = m.book""",
    "value_history": f"SELECT book, node, key, value, learned_at, seq, CASE WHEN refuted_at <= 100 THEN 'disproven' WHEN confirmed THEN 'confirmed' ELSE 'believed' END AS status FROM {duck(_HISTORY)} h WHERE learned_at <= 100",
    "flat_fields": f"SELECT book, record, field, CASE WHEN field IN ('1-URGENT', '2-HIGH') THEN string_agg(value, ',' ORDER BY coalesce(chapter, 0), seq) ELSE arg_max(value, (coalesce(chapter, 0), seq)) END AS value FROM {duck(_FIELDS)} f WHERE coalesce(chapter, 0) <= 100 GROUP BY book, record, field",
    "alias_names": f"SELECT book, src, string_agg(DISTINCT upper(dst), ',' ORDER BY upper(dst)) AS names FROM {_E} e WHERE relation IN ('rel_A', 'rel_R') AND status <> 'rejected' AND coalesce(learned_at, 0) <= 90 GROUP BY book, src",
    "named_senses": f"SELECT s.book, s.node, t.source, s.sense, s.target, s.first_chapter FROM {duck(_SENSES)} s JOIN {duck(_NODES)} t ON t.book = s.book AND t.node = s.node WHERE is_name",
    "evidence_samples": f"SELECT book, node, chapter, id, hinted FROM (SELECT *, regexp_matches(sentence, '{_HINT}') AS hinted, row_number() OVER (PARTITION BY book, node ORDER BY CASE WHEN regexp_matches(sentence, '{_HINT}') THEN 0 ELSE 1 END, chapter, id) AS r FROM {duck(_MENTIONS)} m) q WHERE r <= 5",
    "stratified_slices": f"""WITH t AS (SELECT book, chapter_no, url, source_text, row_number() OVER (PARTITION BY book ORDER BY chapter_no, url) - 1 AS pos, count(*) OVER (PARTITION BY book) AS n FROM {_CH} c WHERE source_text IS NOT NULL AND chapter_no IS NOT NULL), b AS (SELECT DISTINCT book, n FROM t), p AS (SELECT book, n, unnest(range(least(6, n))) AS part FROM b),
a AS (SELECT book, part, CAST(least(n - 1, floor((part + {_DRAW('book', 'part::VARCHAR')}) * n / 6)) AS BIGINT) AS pos FROM p), g AS (SELECT a.book, a.part, t.chapter_no, t.source_text AS x, length(t.source_text) AS n, CAST(floor({_DRAW("'start'", 't.url')} * greatest(1, length(t.source_text) - 600)) AS BIGINT) AS s FROM a JOIN t ON t.book = a.book AND t.pos = a.pos),
h AS (SELECT *, CASE WHEN n <= 600 THEN 0 ELSE length(regexp_extract(substring(x, 1, s), '(?s)^(.*\\n)?', 0)) END AS start FROM g)
SELECT book, part, chapter_no, start, CASE WHEN n <= 600 THEN x ELSE substring(x, start + 1, s + 600 - start) || regexp_extract(substring(x, s + 601), '^[^\\n]*', 0) END AS text FROM h""",
    "accepted_items": f"""WITH i AS (SELECT * FROM {duck(_ITEMS)} i), p AS (SELECT url, unnest(string_split(source_text, chr(10))) AS paragraph FROM {_CH} c WHERE source_text IS NOT NULL), j AS (SELECT i.*, coalesce(trim(quote) <> '' AND trim(source) <> '' AND trim(target) <> '' AND length(source) <= 200 AND kind IN ('person', 'place') AND contains(quote, source) AND EXISTS (SELECT 1 FROM p WHERE p.url = i.url AND contains(p.paragraph, i.quote)), false) AS proven FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY url, {_FOLD}, proven ORDER BY id) AS r FROM j) SELECT id, CASE WHEN NOT proven THEN 'no evidence' WHEN r > 1 THEN 'offered before' WHEN kind = 'person' AND source <> target THEN 'renamed person' END AS reason FROM k""",
    "lower_case_share": f"""WITH w AS (SELECT book, chapter_no AS chapter, unnest(regexp_extract_all(source_text, '[\\p{{L}}\\p{{N}}]+')) AS w FROM {_CH} c WHERE source_text IS NOT NULL AND chapter_no IS NOT NULL), c AS (SELECT book, chapter, lower(w) AS key, count(CASE WHEN left(w, 1) = lower(left(w, 1)) THEN 1 END) AS lo, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT DISTINCT book, chapter, name, lower(name) AS key FROM {duck(_NAMED)} q),
s AS (SELECT m.book, m.name, CAST(sum(lo) AS BIGINT) AS lower, CAST(sum(n) - sum(lo) AS BIGINT) AS upper FROM m JOIN c ON c.book = m.book AND c.chapter = m.chapter AND c.key = m.key GROUP BY ALL) SELECT *, round("lower" / ("lower" + "upper"), 6) AS share, "lower" / ("lower" + "upper") >= 0.3::DOUBLE AS doubtful FROM s""",
    "run_means": f"SELECT setting, count(*) AS runs, round(avg(tokens), 6) AS tokens, round(avg(ratio), 6) AS ratio, round(avg(seconds), 6) AS seconds FROM {duck(_SETTINGS)} r GROUP BY setting",
    "person_summary": f"""WITH e AS (SELECT book, node, count(*) AS edges FROM (SELECT book, unnest(list_distinct([src, dst])) AS node FROM {_E} e) q GROUP BY ALL), a AS (SELECT book, subject AS node, count(CASE WHEN stable THEN 1 END) AS stable, count(CASE WHEN NOT stable THEN 1 END) AS mixed FROM {_TABLE(_CL + ' y')} t GROUP BY ALL), i AS (SELECT book, subject AS node, count(DISTINCT object) AS items FROM {_CL} c GROUP BY ALL)
SELECT book, node, coalesce(edges, 0) AS edges, coalesce(stable, 0) AS stable, coalesce(mixed, 0) AS mixed, coalesce(items, 0) AS items FROM e FULL JOIN a USING (book, node) FULL JOIN i USING (book, node)""",
    "priority_order": f"SELECT book, id, priority, name, row_number() OVER (PARTITION BY book ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id) AS rank FROM {duck(_LINES)} l",
    "profile_evidence": f"SELECT o.id, min(CASE WHEN contains({_SQ('s.text')}, {_SQ('o.quote')}) AND length({_SQ('o.quote')}) > 0 THEN s.chapter_no END) AS chapter, count(CASE WHEN contains({_SQ('s.text')}, o.value) THEN 1 END) AS uses, min(CASE WHEN contains({_SQ('s.text')}, {_SQ('o.quote')}) AND length({_SQ('o.quote')}) > 0 THEN s.chapter_no END) IS NOT NULL AND count(CASE WHEN contains({_SQ('s.text')}, o.value) THEN 1 END) >= 2 AND contains(any_value(o.quote), any_value(o.value)) AS accepted FROM {duck(_OFFERED)} o LEFT JOIN {duck(_SAMPLES)} s ON s.book = o.book GROUP BY o.id",
}
