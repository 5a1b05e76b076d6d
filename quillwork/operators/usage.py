"""Usage and API telemetry: costs, pivots, gauges, roll-ups, latest states, retraction, stage times, jobs, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import role, sql_role

#: Micro-units of money for a token in and a token out; models without a price are left out of costs and flagged in gauges.
PRICES = {"model-click": (10, 40), "model-view": (3, 12), "model-error": (1, 2), "model-purchase": (25, 75)}


def prices(spark) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, price_in long, price_out long")


def days_of_month(calls: DataFrame, month: str) -> DataFrame:
    """(day, model, requests, tokens_in, tokens_out) of one month, by the prefix of its days: YYYY-MM."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return calls.where(day.startswith(f"{month}-")).groupBy(day.alias("day"), "model").agg(F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def monthly_cost(calls: DataFrame, price: DataFrame) -> DataFrame:
    """Requests, tokens and cost per month and priced model; half-even rounding to four digits."""
    sums = calls.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "model").agg(F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return sums.join(price, "model").select("month", "model", "requests", "tokens_in", "tokens_out", F.bround(cost, 4).alias("cost"))


def token_pivot(calls: DataFrame, price: DataFrame) -> DataFrame:
    """Hourly facts unpivoted to (hour, model, type), summed and pivoted back; an unknown price is flagged, not dropped."""
    facts = calls.select("model", F.expr("stack(2, 'input', tokens_in, 'output', tokens_out) as (type, token)"))
    wide = facts.groupBy("model").pivot("type", ["input", "output"]).sum("token")
    cost = F.bround((F.col("input") * F.col("price_in") + F.col("output") * F.col("price_out")) / 1e6, 4)
    return wide.join(price, "model", "left").select("model", "input", "output", cost.alias("cost"), F.col("price_in").isNull().alias("unpriced"))


def hourly_tokens(calls: DataFrame) -> DataFrame:
    """The point of a metering interval carries its end: its hour is that of a second earlier. Zero points go."""
    hour = F.date_format(F.date_trunc("hour", F.col("ts") - F.expr("interval 1 second")), "yyyy-MM-dd'T'HH")
    return calls.where("tokens_in > 0").groupBy(hour.alias("hour"), "model").agg(F.sum("tokens_in").alias("tokens"))


def credit_gauge(calls: DataFrame, price: DataFrame, grant: float, until: str) -> DataFrame:
    """One row: spent, left, the used share capped at 1, spend of the last 7 days, days to exhaustion at that rate."""
    cost = F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")
    end = F.lit(until).cast("date")
    sums = calls.join(price, "model").agg((F.sum(cost) / 1e6).alias("s"), (F.sum(F.when((F.col("day") > F.date_sub(end, 7)) & (F.col("day") <= end), cost)) / 1e6).alias("w"))
    return sums.select(F.bround("s", 4).alias("spent"), F.bround(F.lit(grant) - F.col("s"), 4).alias("left"), F.bround(F.least(F.lit(1.0), F.col("s") / grant), 4).alias("share"), F.bround("w", 4).alias("week"), F.bround((F.lit(grant) - F.col("s")) / (F.col("w") / 7), 2).alias("days_left"))


def daily_rollup(calls: DataFrame) -> DataFrame:
    """Counters per key, model and day. A refusal is a success retracted: it counts as an error and takes one success off, not below 0."""
    is_ = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    return calls.groupBy("api_key", "model", "day").agg(F.count("*").alias("tries"), F.greatest(F.lit(0), is_("success") - is_("refused")).alias("successes"), is_("error", "refused").alias("errors"), is_("quota").alias("quotas"), is_("refused").alias("refusals"))


def latest_state(calls: DataFrame, cooling_s: int = 3600) -> DataFrame:
    """Per key and model: last try, last success, last outcome, and the end of cooling, which later rows without one leave standing."""
    at = F.struct("ts", "id")
    return calls.groupBy("api_key", "model").agg(F.max("ts").alias("last_try"), F.max(F.when(F.col("outcome") == "success", F.col("ts"))).alias("last_success"), F.max_by("outcome", at).alias("outcome"), (F.max(F.when(F.col("outcome") == "quota", F.col("ts"))) + F.expr(f"interval {cooling_s} seconds")).alias("cooling_until"))


def card_state(latest: DataFrame, now: str) -> DataFrame:
    """The card of a key and model: cooling while its quota lasts, retryable after, else by the last outcome."""
    t = F.lit(now).cast("timestamp")
    return latest.select("api_key", "model", F.when((F.col("outcome") == "quota") & (F.col("cooling_until") > t), "cooling").when(F.col("outcome") == "quota", "retryable").when(F.col("outcome") == "success", "ready").when(F.col("outcome") == "error", "transient").otherwise("refused").alias("card"))


def stage_means(calls: DataFrame, last: int = 40) -> DataFrame:
    """Mean milliseconds per stage over the last chapters: a chapter without the stage counts as 0; and the share that has it."""
    recent = calls.groupBy("chapter").agg(F.max(F.struct("ts", "id")).alias("at")).orderBy(F.desc("at"), F.desc("chapter")).limit(last)
    own = calls.join(recent.select("chapter"), "chapter").groupBy("chapter", "stage").agg(F.sum("duration_ms").alias("ms"))
    n = recent.agg(F.count("*").alias("n"))
    return own.groupBy("stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("chapters")).join(F.broadcast(n)).select("stage", F.round(F.col("ms") / F.col("n"), 3).alias("mean_ms"), F.round(F.col("chapters") / F.col("n"), 4).alias("share"))


def time_breakdown(calls: DataFrame) -> DataFrame:
    """Per chapter: measured span, the calls' sum and the residue, never negative."""
    out = calls.groupBy("chapter").agg(F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).alias("total_ms"), F.sum("duration_ms").alias("calls_ms"), F.count(F.when(F.col("outcome") != "success", 1)).alias("failures"), F.countDistinct("model").alias("models"))
    return out.withColumn("rest_ms", F.greatest(F.lit(0).cast("long"), F.col("total_ms") - F.col("calls_ms")))


def model_days(calls: DataFrame) -> DataFrame:
    """Calls and failures per day and model with the failure rate."""
    return calls.groupBy("day", "model").agg(F.count("*").alias("calls"), F.count(F.when(F.col("outcome") != "success", 1)).alias("failures")).withColumn("rate", F.round(F.col("failures") / F.col("calls"), 6))


def attention_job(jobs: DataFrame) -> DataFrame:
    """Per book the job to show: the newest of each type (ties stay), then running before error before the rest, newest first."""
    kind = F.coalesce("type", F.lit("bulk"))
    newest = jobs.withColumn("type", kind).withColumn("_r", F.rank().over(Window.partitionBy("book", kind).orderBy(F.desc("updated_at")))).where("_r = 1")
    order = F.when(F.col("state") == "running", 0).when(F.col("state") == "error", 1).otherwise(2)
    return newest.withColumn("_p", F.row_number().over(Window.partitionBy("book").orderBy(order, F.desc("updated_at"), "id"))).where("_p = 1").select("book", "type", "state", "updated_at", "id")


def retained(calls: DataFrame, until: str, days: int = 30, keep: int = 2000) -> DataFrame:
    """Rows of the last `days` that are among the newest `keep` ids. The cap is the feature: a bounded top-k, not a sort of all."""
    fresh = calls.where(F.col("ts") > F.lit(until).cast("timestamp") - F.expr(f"interval {days} days"))
    return fresh.select("id", "ts", "model", "outcome").orderBy(F.desc("id")).limit(keep)


def event_page(calls: DataFrame, cursor: int, size: int = 50) -> DataFrame:
    """A page of events before the cursor, newest first, at most 500."""
    return calls.where(F.col("id") < cursor).select("id", "model", "stage", "outcome").orderBy(F.desc("id")).limit(max(1, min(500, size)))


def reingested(hours: DataFrame, again: DataFrame, overlap_h: int = 2) -> DataFrame:
    """Trailing re-ingestion: everything from the last stored hour less the overlap on is replaced by the new pull."""
    cut = hours.agg(F.date_format(F.to_timestamp(F.max("hour"), "yyyy-MM-dd'T'HH") - F.expr(f"interval {overlap_h} hours"), "yyyy-MM-dd'T'HH").alias("cut"))
    old = hours.join(F.broadcast(cut)).where("hour < cut").drop("cut")
    return old.unionByName(again.join(F.broadcast(cut)).where("hour >= cut").drop("cut"))


_P = lambda s: prices(s)
QUERIES = {
    "usage_days_of_month": lambda s, d: days_of_month(role(s, d, "calls"), "2024-01"),
    "usage_monthly_cost": lambda s, d: monthly_cost(role(s, d, "calls"), _P(s)),
    "usage_token_pivot": lambda s, d: token_pivot(role(s, d, "calls"), _P(s)),
    "usage_hourly_tokens": lambda s, d: hourly_tokens(role(s, d, "calls")),
    "usage_credit_gauge": lambda s, d: credit_gauge(role(s, d, "calls"), _P(s), 5000.0, "2024-01-30"),
    "api_daily_rollup": lambda s, d: daily_rollup(role(s, d, "calls")),
    "api_latest_state": lambda s, d: latest_state(role(s, d, "calls")),
    "api_card_state": lambda s, d: card_state(latest_state(role(s, d, "calls")), "2024-01-30 22:00:00"),
    "stage_mean_with_zero": lambda s, d: stage_means(role(s, d, "calls")),
    "chapter_time_breakdown": lambda s, d: time_breakdown(role(s, d, "calls")),
    "failures_by_model_day": lambda s, d: model_days(role(s, d, "calls")),
    "job_latest_priority": lambda s, d: attention_job(role(s, d, "jobs")),
    "retention_cap": lambda s, d: retained(role(s, d, "calls"), "2024-01-31 00:00:00", 20),
    "event_page": lambda s, d: event_page(role(s, d, "calls"), 900),
    "usage_reingest": lambda s, d: reingested(hourly_tokens(role(s, d, "calls").where("id % 3 > 0 and day <= '2024-01-20'")), hourly_tokens(role(s, d, "calls"))),
}
_CALLS, _JOBS = sql_role("calls"), sql_role("jobs")
_PRICES = "(VALUES " + ", ".join(f"('{m}', CAST({i} AS BIGINT), CAST({o} AS BIGINT))" for m, (i, o) in PRICES.items()) + ") p(model, price_in, price_out)"
_HOURS = lambda where: f"(SELECT strftime(date_trunc('hour', ts - INTERVAL 1 SECOND), '%Y-%m-%dT%H') AS hour, model, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM {_CALLS} x WHERE tokens_in > 0 AND {where} GROUP BY ALL)"
_STATE = f"(SELECT api_key, model, max(ts) AS last_try, max(CASE WHEN outcome = 'success' THEN ts END) AS last_success, arg_max(outcome, (ts, id)) AS outcome, max(CASE WHEN outcome = 'quota' THEN ts END) + INTERVAL 3600 SECOND AS cooling_until FROM {_CALLS} x GROUP BY ALL)"
ORACLE = {
    "usage_days_of_month": f"SELECT strftime(ts, '%Y-%m-%d') AS day, model, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM {_CALLS} x WHERE strftime(ts, '%Y-%m-%d') LIKE '2024-01-%' GROUP BY ALL",
    "usage_monthly_cost": f"SELECT month, s.model, requests, tokens_in, tokens_out, round_even((tokens_in * price_in + tokens_out * price_out) / 1e6, 4) AS cost FROM (SELECT strftime(ts, '%Y-%m') AS month, model, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM {_CALLS} x GROUP BY ALL) s JOIN {_PRICES} ON s.model = p.model",
    "usage_token_pivot": f"SELECT s.model, input, output, round_even((input * price_in + output * price_out) / 1e6, 4) AS cost, price_in IS NULL AS unpriced FROM (SELECT model, CAST(sum(tokens_in) AS BIGINT) AS input, CAST(sum(tokens_out) AS BIGINT) AS output FROM {_CALLS} x GROUP BY ALL) s LEFT JOIN {_PRICES} ON s.model = p.model",
    "usage_hourly_tokens": f"SELECT * FROM {_HOURS('true')} h",
    "usage_credit_gauge": f"SELECT round_even(s, 4) AS spent, round_even(5000.0 - s, 4) AS left, round_even(least(1.0, s / 5000.0), 4) AS share, round_even(w, 4) AS week, round_even((5000.0 - s) / (w / 7), 2) AS days_left FROM (SELECT CAST(sum(c) AS DOUBLE) / 1e6 AS s, CAST(sum(CASE WHEN day > DATE '2024-01-30' - 7 AND day <= DATE '2024-01-30' THEN c END) AS DOUBLE) / 1e6 AS w FROM (SELECT day, tokens_in * price_in + tokens_out * price_out AS c FROM {_CALLS} x JOIN {_PRICES} ON x.model = p.model) y) z",
    "api_daily_rollup": f"SELECT api_key, model, day, count(*) AS tries, greatest(0, count(*) FILTER (outcome = 'success') - count(*) FILTER (outcome = 'refused')) AS successes, count(*) FILTER (outcome IN ('error', 'refused')) AS errors, count(*) FILTER (outcome = 'quota') AS quotas, count(*) FILTER (outcome = 'refused') AS refusals FROM {_CALLS} x GROUP BY ALL",
    "api_latest_state": f"SELECT * FROM {_STATE} y",
    "api_card_state": f"SELECT api_key, model, CASE WHEN outcome = 'quota' AND cooling_until > TIMESTAMP '2024-01-30 22:00:00' THEN 'cooling' WHEN outcome = 'quota' THEN 'retryable' WHEN outcome = 'success' THEN 'ready' WHEN outcome = 'error' THEN 'transient' ELSE 'refused' END AS card FROM {_STATE} y",
    "stage_mean_with_zero": f"WITH c AS (SELECT * FROM {_CALLS} x), r AS (SELECT chapter FROM (SELECT chapter, max((ts, id)) AS last_at FROM c GROUP BY chapter) q ORDER BY last_at DESC, chapter DESC LIMIT 40), o AS (SELECT chapter, stage, sum(duration_ms) AS ms FROM c WHERE chapter IN (SELECT chapter FROM r) GROUP BY ALL) SELECT stage, round(sum(ms) / (SELECT count(*) FROM r), 3) AS mean_ms, round(count(*) / (SELECT count(*) FROM r), 4) AS share FROM o GROUP BY stage",
    "chapter_time_breakdown": f"SELECT *, greatest(CAST(0 AS BIGINT), total_ms - calls_ms) AS rest_ms FROM (SELECT chapter, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS total_ms, CAST(sum(duration_ms) AS BIGINT) AS calls_ms, count(*) FILTER (outcome <> 'success') AS failures, count(DISTINCT model) AS models FROM {_CALLS} x GROUP BY chapter) y",
    "failures_by_model_day": f"SELECT *, round(failures / calls, 6) AS rate FROM (SELECT day, model, count(*) AS calls, count(*) FILTER (outcome <> 'success') AS failures FROM {_CALLS} x GROUP BY ALL) y",
    "job_latest_priority": f"WITH j AS (SELECT id, book, coalesce(type, 'bulk') AS type, state, updated_at FROM {_JOBS} x), n AS (SELECT *, rank() OVER (PARTITION BY book, type ORDER BY updated_at DESC) AS r FROM j) SELECT book, type, state, updated_at, id FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY CASE state WHEN 'running' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, updated_at DESC, id) AS p FROM n WHERE r = 1) q WHERE p = 1",
    "retention_cap": f"SELECT id, ts, model, outcome FROM {_CALLS} x WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY ORDER BY id DESC LIMIT 2000",
    "event_page": f"SELECT id, model, stage, outcome FROM {_CALLS} x WHERE id < 900 ORDER BY id DESC LIMIT 50",
    "usage_reingest": f"WITH h AS (SELECT * FROM {_HOURS("id % 3 > 0 AND day <= DATE '2024-01-20'")} a), c AS (SELECT strftime(strptime(max(hour), '%Y-%m-%dT%H') - INTERVAL 2 HOUR, '%Y-%m-%dT%H') AS cut FROM h) SELECT h.* FROM h, c WHERE hour < cut UNION ALL SELECT n.* FROM {_HOURS('true')} n, c WHERE hour >= cut",
}
