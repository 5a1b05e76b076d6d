"""Upkeep of the store: number fixes, counters with retractions, ordered intake, signatures, restores, precedence, daily reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import role, sql_role

URL_NUMBER, TITLE_NUMBER = r"(?i)chapter-([0-9]+)", r"(?i)chapter\s+([0-9]+)"


def number_fixes(chapters: DataFrame) -> DataFrame:
    """Chapters whose url and title name one number and whose stored number is another; without both witnesses nothing is judged."""
    by_url, by_title = F.regexp_extract("url", URL_NUMBER, 1), F.regexp_extract("title", TITLE_NUMBER, 1)
    told = chapters.select("book", "url", "chapter_no", F.when(by_url != "", by_url.cast("int")).alias("u"), F.when(by_title != "", by_title.cast("int")).alias("t"))
    return told.where((F.col("u") == F.col("t")) & ~F.col("chapter_no").eqNullSafe(F.col("u"))).select("book", "url", "chapter_no", F.col("u").alias("number"))


def counters(calls: DataFrame) -> DataFrame:
    """Successes, errors and refusals per day and model. A refusal right after a success of the same chapter and key takes the
    success back: the success is one less and the error and refusal one more, never below zero. Retractions are signed rows, so
    the sums stay associative."""
    by = Window.partitionBy("chapter", "api_key").orderBy("ts", "id")
    turned = (F.col("outcome") == "refused") & (F.lag("outcome").over(by) == "success")
    back_day, back_model = F.lag("day").over(by), F.lag("model").over(by)
    seen = calls.select("day", "model", "outcome", F.coalesce(turned, F.lit(False)).alias("turned"), back_day.alias("_d"), back_model.alias("_m"))
    n = lambda test: F.when(test, 1).otherwise(0)
    ahead = seen.select("day", "model", n(F.col("outcome") == "success").alias("s"), n(F.col("outcome").isin("error", "quota") | ((F.col("outcome") == "refused") & ~F.col("turned"))).alias("e"), n((F.col("outcome") == "refused") & ~F.col("turned")).alias("r"))
    back = seen.where("turned").select(F.col("_d").alias("day"), F.col("_m").alias("model"), F.lit(-1).alias("s"), F.lit(1).alias("e"), F.lit(1).alias("r"))
    total = lambda c: F.greatest(F.lit(0), F.sum(c)).cast("long")
    return ahead.unionByName(back).groupBy("day", "model").agg(total("s").alias("successes"), total("e").alias("errors"), total("r").alias("refusals"))


def ordered_intake(batches: DataFrame, heads: DataFrame) -> DataFrame:
    """batches(book, number) against heads(book, head): a number is applied when all from the head on are there before it, repeated
    when the head has it already, and a gap otherwise. A book without a head starts at zero."""
    own = batches.where("number is not null").groupBy("book", "number").agg(F.count("*").alias("copies")).join(heads, "book", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    ahead = F.col("number") > F.col("head")
    place = F.sum(ahead.cast("int")).over(Window.partitionBy("book").orderBy("number"))
    state = F.when(~ahead, "repeated").when(F.col("number") == F.col("head") + place, "applied").otherwise("gap")
    return own.withColumn("state", state).groupBy("book", "state").agg(F.count("*").alias("numbers"), F.min("number").alias("first"), F.max("number").alias("last"))


def signature(chapters: DataFrame) -> DataFrame:
    """What a cached result of a book depends on: rows, the newest time, characters; equal signatures keep the cache valid."""
    return chapters.groupBy("book").agg(F.count("*").alias("rows"), F.max("created_at").alias("newest"), F.sum(F.length(F.coalesce("source_text", F.lit(""))) + F.length(F.coalesce("translation", F.lit("")))).cast("long").alias("chars"))


def restored(current: DataFrame, archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, digest, place): the wanted archived version becomes current, what was current goes to the archive, all else stays.
    Versions are known by url and digest; a version wanted but not archived changes nothing."""
    w = archive.join(wanted, ["url", "digest"], "left_semi").groupBy("url").agg(F.min("digest").alias("_w"))
    now = current.join(w, "url", "left").select("url", F.coalesce("_w", "digest").alias("digest"), F.lit("current").alias("place"))
    sent = current.join(w, "url", "left_semi").select("url", "digest", F.lit("archive").alias("place"))
    rest = archive.join(w, "url", "left").where(F.col("_w").isNull() | (F.col("digest") != F.col("_w"))).select("url", "digest", F.lit("archive").alias("place"))
    return now.unionByName(sent).unionByName(rest).distinct()


def precedence(settings: DataFrame) -> DataFrame:
    """settings(book, key, value, origin): a person's value before a model's before the code's; within an origin the newest by seq."""
    rank = F.when(F.col("origin") == "manual", 2).when(F.col("origin") == "model", 1).otherwise(0)
    best = settings.groupBy("book", "key").agg(F.max(F.struct(rank.alias("r"), "seq", "value", "origin")).alias("x"))
    return best.select("book", "key", "x.value", "x.origin")


def daily_models(calls: DataFrame, days: int = 12) -> DataFrame:
    """Successful calls of the last days that have any: how many and by which models, commonest first."""
    per = calls.where("outcome = 'success'").groupBy("day", "model").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "model")))
    daily = per.groupBy("day").agg(F.sum("n").alias("calls"), F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["model"], -x["k"])), ",").alias("models"))
    return daily.orderBy(F.desc("day")).limit(days)


def shelf(chapters: DataFrame) -> DataFrame:
    """Books by their newest chapter, newest first."""
    last = chapters.groupBy("book").agg(F.max(F.struct("created_at", "url", "chapter_no", "title")).alias("x"), F.count("*").alias("chapters"))
    return last.select("book", "x.url", "x.chapter_no", "x.title", "x.created_at", "chapters").orderBy(F.desc("created_at"), "book")


def key_panel(calls: DataFrame, day: str) -> DataFrame:
    """Per key: models it was used with, the day's tries and successes, and models that cool, their last call having met the quota."""
    that = F.col("day") == F.lit(day).cast("date")
    card = calls.groupBy("api_key", "model").agg(F.count(F.when(that, 1)).alias("tries"), F.count(F.when(that & (F.col("outcome") == "success"), 1)).alias("successes"), F.max(F.struct("ts", "id", "outcome")).alias("x"))
    return card.groupBy("api_key").agg(F.count("*").alias("models"), F.sum("tries").alias("tries"), F.sum("successes").alias("successes"), F.count(F.when(F.col("x.outcome") == "quota", 1)).alias("cooling"))


def burn_forecast(calls: DataFrame, budget: int, days_left: int, window: int = 7) -> DataFrame:
    """Per model: tokens used, the daily rate of the last days that the log covers, days until the budget is gone at that rate (null
    without use), and whether it lasts."""
    end = F.lit(calls.agg(F.max("day")).first()[0]).cast("date")  # one value
    tokens = F.col("tokens_in") + F.col("tokens_out")
    used = calls.groupBy("model").agg(F.sum(tokens).cast("long").alias("used"), F.sum(F.when(F.datediff(end, "day") < window, tokens).otherwise(0)).cast("long").alias("recent"))
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("used"))
    days = F.when(F.col("recent") > 0, F.round(left * window / F.col("recent"), 4))
    return used.select("model", "used", "recent", days.alias("days"), F.coalesce(days >= days_left, F.lit(True)).alias("lasts"))


def risen(records: DataFrame, told: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """records and told(book, subject, rank, chapter) -> (book, subject, rank, chapter, recorded): the highest rank that a later
    chapter than the record's tells of someone, if it is above the recorded one; its first chapter. Ranks off the list are none."""
    step = F.array_position(F.array(*map(F.lit, order)), F.col("rank"))
    first = told.select("book", "subject", "chapter", "rank", step.alias("s")).where("s > 0").groupBy("book", "subject", "rank", "s").agg(F.collect_set("chapter").alias("at"))
    r = records.select("book", "subject", F.col("rank").alias("recorded"), step.alias("_s"), F.col("chapter").alias("_c"))
    later = F.array_min(F.filter("at", lambda c: c > F.col("_c")))
    up = first.join(r, ["book", "subject"]).withColumn("chapter", later).where((F.col("s") > F.col("_s")) & F.col("chapter").isNotNull())
    return up.groupBy("book", "subject", "recorded").agg(F.max(F.struct("s", "rank", "chapter")).alias("x")).select("book", "subject", "x.rank", "x.chapter", "recorded")


_NUMBERED = "(SELECT book, concat('https://books/', book, '/chapter-', CAST(floor(doc_id / 20) AS INT) + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END, '/', doc_id) AS url, title, chapter_no + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS chapter_no FROM {chapters})"
_BATCH = "(SELECT book, chapter_no AS number FROM {chapters} WHERE chapter_no IS NOT NULL)"
_HEADS = "(SELECT book, CAST(min(chapter_no) + 1 AS INT) AS head FROM {chapters} WHERE length(book) % 2 = 0 GROUP BY book)"
_NOW = "(SELECT url, concat('now', doc_id % 5) AS digest FROM {chapters})"
_OLD = "(SELECT url, concat('old', doc_id % 3) AS digest FROM {chapters} WHERE doc_id % 2 = 0 UNION SELECT url, concat('old', doc_id % 4) FROM {chapters} WHERE doc_id % 3 = 0)"
_WANT = "(SELECT url, concat('old', doc_id % 4) AS digest FROM {chapters} WHERE doc_id % 5 = 0)"
_RECORDS = "(SELECT book, subject, min(relation) AS rank, CAST(floor(max(chapter) / 2) AS INT) AS chapter FROM {claims} WHERE id % 7 = 0 GROUP BY book, subject)"
_RANKS = "(SELECT book, subject, relation AS rank, chapter FROM {claims} WHERE id % 3 > 0)"
_SET = "(SELECT book, node AS key, value, CASE WHEN seq % 7 = 0 THEN 'manual' WHEN seq % 2 = 0 THEN 'model' ELSE 'code' END AS origin, seq FROM {node_values})"


def _sql(s, d, text: str) -> DataFrame:
    return s.sql("SELECT * FROM " + text, **{name: role(s, d, name) for name in ("chapters", "node_values", "claims") if "{" + name + "}" in text})


def _duck(text: str) -> str:
    for name in ("chapters", "node_values", "calls", "claims"):
        text = text.replace("{" + name + "}", sql_role(name) + f" {name}_")
    return text


QUERIES = {
    "number_fixes": lambda s, d: number_fixes(_sql(s, d, _NUMBERED)),
    "counters_retracted": lambda s, d: counters(role(s, d, "calls")),
    "ordered_intake": lambda s, d: ordered_intake(_sql(s, d, _BATCH), _sql(s, d, _HEADS)),
    "store_signature": lambda s, d: signature(role(s, d, "chapters")),
    "restore_versions": lambda s, d: restored(_sql(s, d, _NOW), _sql(s, d, _OLD), _sql(s, d, _WANT)),
    "setting_precedence": lambda s, d: precedence(_sql(s, d, _SET)),
    "daily_models": lambda s, d: daily_models(role(s, d, "calls")),
    "key_panel": lambda s, d: key_panel(role(s, d, "calls"), "2024-01-20"),
    "burn_forecast": lambda s, d: burn_forecast(role(s, d, "calls"), 20_000_000, 14),
    "risen_ranks": lambda s, d: risen(_sql(s, d, _RECORDS), _sql(s, d, _RANKS), ("rel_A", "rel_N", "rel_R")),
    "shelf": lambda s, d: shelf(role(s, d, "chapters")),
}
ORACLE = {
    "number_fixes": _duck(f"SELECT book, url, chapter_no, u AS number FROM (SELECT *, TRY_CAST(regexp_extract(url, '{URL_NUMBER}', 1) AS INT) AS u, TRY_CAST(regexp_extract(title, '{TITLE_NUMBER}', 1) AS INT) AS t FROM {_NUMBERED} n) q WHERE u = t AND chapter_no IS DISTINCT FROM u"),
    "counters_retracted": _duck("WITH c AS (SELECT *, coalesce(outcome = 'refused' AND lag(outcome) OVER w = 'success', false) AS turned, lag(day) OVER w AS d, lag(model) OVER w AS m FROM {calls} WINDOW w AS (PARTITION BY chapter, api_key ORDER BY ts, id)), x AS (SELECT day, model, CASE WHEN outcome = 'success' THEN 1 ELSE 0 END AS s, CASE WHEN outcome IN ('error', 'quota') OR (outcome = 'refused' AND NOT turned) THEN 1 ELSE 0 END AS e, CASE WHEN outcome = 'refused' AND NOT turned THEN 1 ELSE 0 END AS r FROM c UNION ALL SELECT d, m, -1, 1, 1 FROM c WHERE turned) SELECT day, model, CAST(greatest(0, sum(s)) AS BIGINT) AS successes, CAST(greatest(0, sum(e)) AS BIGINT) AS errors, CAST(greatest(0, sum(r)) AS BIGINT) AS refusals FROM x GROUP BY ALL"),
    "ordered_intake": _duck(f"WITH b AS (SELECT DISTINCT b.book, number, coalesce(head, 0) AS head FROM {_BATCH} b LEFT JOIN {_HEADS} h ON b.book = h.book), p AS (SELECT *, count(CASE WHEN number > head THEN 1 END) OVER (PARTITION BY book ORDER BY number) AS place FROM b) SELECT book, CASE WHEN number <= head THEN 'repeated' WHEN number = head + place THEN 'applied' ELSE 'gap' END AS state, count(*) AS numbers, min(number) AS first, max(number) AS last FROM p GROUP BY ALL"),
    "store_signature": _duck("SELECT book, count(*) AS rows, max(created_at) AS newest, CAST(sum(length(coalesce(source_text, '')) + length(coalesce(translation, ''))) AS BIGINT) AS chars FROM {chapters} GROUP BY book"),
    "restore_versions": _duck(f"WITH a AS (SELECT * FROM {_OLD} o), w AS (SELECT url, min(digest) AS w FROM a WHERE (url, digest) IN (SELECT (url, digest) FROM {_WANT} x) GROUP BY url), n AS (SELECT * FROM {_NOW} y) SELECT n.url, coalesce(w.w, digest) AS digest, 'current' AS place FROM n LEFT JOIN w ON n.url = w.url UNION SELECT url, digest, 'archive' FROM n WHERE url IN (SELECT url FROM w) UNION SELECT a.url, digest, 'archive' FROM a LEFT JOIN w ON a.url = w.url WHERE w.w IS NULL OR digest <> w.w"),
    "setting_precedence": _duck(f"SELECT book, key, arg_max(value, (CASE origin WHEN 'manual' THEN 2 WHEN 'model' THEN 1 ELSE 0 END, seq, value)) AS value, arg_max(origin, (CASE origin WHEN 'manual' THEN 2 WHEN 'model' THEN 1 ELSE 0 END, seq, value)) AS origin FROM {_SET} s GROUP BY book, key"),
    "daily_models": _duck("SELECT day, CAST(sum(n) AS BIGINT) AS calls, string_agg(concat(model, ':', n), ',' ORDER BY n DESC, model) AS models FROM (SELECT day, model, count(*) AS n FROM {calls} WHERE outcome = 'success' GROUP BY ALL) q GROUP BY day ORDER BY day DESC LIMIT 12"),
    "key_panel": _duck("SELECT api_key, count(*) AS models, CAST(sum(t) AS BIGINT) AS tries, CAST(sum(s) AS BIGINT) AS successes, count(CASE WHEN o = 'quota' THEN 1 END) AS cooling FROM (SELECT api_key, model, count(CASE WHEN day = DATE '2024-01-20' THEN 1 END) AS t, count(CASE WHEN day = DATE '2024-01-20' AND outcome = 'success' THEN 1 END) AS s, arg_max(outcome, (ts, id)) AS o FROM {calls} GROUP BY ALL) q GROUP BY api_key"),
    "burn_forecast": _duck("SELECT *, coalesce(days >= 14, true) AS lasts FROM (SELECT model, used, recent, CASE WHEN recent > 0 THEN round(greatest(0, 20000000 - used) * 7::DOUBLE / recent, 4) END AS days FROM (SELECT model, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS used, CAST(sum(CASE WHEN date_diff('day', day, e) < 7 THEN tokens_in + tokens_out ELSE 0 END) AS BIGINT) AS recent FROM (SELECT *, max(day) OVER () AS e FROM {calls}) a GROUP BY model) b) c"),
    "risen_ranks": _duck(f"SELECT book, subject, x[2] AS rank, x[3] AS chapter, recorded FROM (SELECT book, subject, recorded, max((s, rank, chapter)) AS x FROM (SELECT t.book, t.subject, t.rank, list_position(['rel_A', 'rel_N', 'rel_R'], t.rank) AS s, r.rank AS recorded, min(t.chapter) AS chapter FROM {_RANKS} t JOIN {_RECORDS} r ON t.book = r.book AND t.subject = r.subject AND t.chapter > r.chapter AND list_position(['rel_A', 'rel_N', 'rel_R'], t.rank) > list_position(['rel_A', 'rel_N', 'rel_R'], r.rank) GROUP BY ALL) a GROUP BY ALL) b"),
    "shelf": _duck("SELECT book, x[2] AS url, x[3] AS chapter_no, x[4] AS title, x[1] AS created_at, chapters FROM (SELECT book, max((created_at, url, chapter_no, title)) AS x, count(*) AS chapters FROM {chapters} GROUP BY book) q"),
}
