"""Reading log and reading speed: distinct counts, session validity, medians, first and last sessions, daily series, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import role, sql_role

MIN_CHARS, MIN_MS, SLOWEST, FASTEST = 1500, 60_000, 400, 5000
IDLE_S, TICK_S = 90, 2


def daily_distinct(log: DataFrame, day: str) -> DataFrame:
    """Distinct chapters ever read and on one day, per book, in one pass."""
    return log.groupBy("slug").agg(F.countDistinct("url").alias("total"), F.countDistinct(F.when(F.col("day") == F.lit(day).cast("date"), F.col("url"))).alias("today"))


def once_a_day(log: DataFrame) -> DataFrame:
    """One row per (day, slug, url), the first by time: a later resend changes nothing."""
    return log.groupBy("day", "slug", "url").agg(F.min("ts").alias("ts"))


def chars_per_minute() -> Column:
    return F.col("chars") * 60000.0 / F.col("active_ms")


def is_valid() -> Column:
    """Recomputed from the facts; the client's no is final."""
    return F.coalesce("client_valid", F.lit(False)) & (F.col("chars") >= MIN_CHARS) & (F.col("active_ms") >= MIN_MS) & chars_per_minute().between(SLOWEST, FASTEST)


_VALID = f"client_valid AND chars >= {MIN_CHARS} AND active_ms >= {MIN_MS} AND chars * 60000.0 / active_ms BETWEEN {SLOWEST} AND {FASTEST}"


def free_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(is_valid() & (F.col("mode") == "free")).withColumn("cpm", chars_per_minute())


def speed_median(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Median speed without outliers: of three sessions or more, those above twice the median go."""
    of_key = Window.partitionBy(*keys)
    marked = sessions.withColumn("_m", F.median("cpm").over(of_key)).withColumn("_n", F.count("*").over(of_key))
    return marked.where((F.col("_n") < 3) | (F.col("cpm") <= 2 * F.col("_m"))).groupBy(*keys).agg(F.round(F.median("cpm"), 3).alias("cpm"), F.count("*").alias("sessions"), F.round(F.sum("words") * 60000.0 / F.sum("active_ms"), 3).alias("wpm"))


def first_and_last(sessions: DataFrame, first: int = 5, last: int = 10) -> DataFrame:
    """Per book: median of the first and of the last sessions; the change only where there are `last` sessions."""
    up, down = Window.partitionBy("book").orderBy("ts", "session"), Window.partitionBy("book").orderBy(F.desc("ts"), F.desc("session"))
    ranked = sessions.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down))
    out = ranked.groupBy("book").agg(F.round(F.median(F.when(F.col("_a") <= first, F.col("cpm"))), 3).alias("baseline"), F.round(F.median(F.when(F.col("_z") <= last, F.col("cpm"))), 3).alias("personal"), F.min("day").alias("first_day"), F.count("*").alias("n"))
    return out.withColumn("change", F.when(F.col("n") >= last, F.round(F.col("personal") - F.col("baseline"), 2)))


def last_per_chunk(sessions: DataFrame, keep: int = 10) -> DataFrame:
    """Median speed of the last sessions of every chunk size."""
    newest = Window.partitionBy("book", "chunk").orderBy(F.desc("ts"), F.desc("session"))
    return sessions.where("chunk is not null").withColumn("_z", F.row_number().over(newest)).where(F.col("_z") <= keep).groupBy("book", "chunk").agg(F.round(F.median("cpm"), 3).alias("cpm"), F.count("*").alias("n"))


def daily_series(sessions: DataFrame, until: str, days: int = 30) -> DataFrame:
    """Minutes a day and mode over the window, valid or not, and the valid sessions among them."""
    end = F.lit(until).cast("date")
    return sessions.where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days))).groupBy("day", "mode").agg(F.round(F.sum("active_ms") / 60000.0, 3).alias("minutes"), F.count(F.when(is_valid(), 1)).alias("valid"))


def active_time(ticks: DataFrame) -> DataFrame:
    """Seconds of attention per reader: gaps between ticks count up to TICK_S, none after an idle gap. An idle gap ends no session,
    it only takes time off, so this is a running difference and not a session window."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("slug").orderBy("ts", "event_id"))
    counted = F.when(F.col("gap") <= IDLE_S * 1_000_000, F.least("gap", F.lit(TICK_S * 1_000_000))).otherwise(0)
    return ticks.withColumn("gap", gap).groupBy("slug").agg(F.sum(F.when(F.col("gap").isNull(), 0).otherwise(counted)).alias("active_us"), F.count(F.when(F.col("gap") > IDLE_S * 1_000_000, 1)).alias("idle_gaps"), F.count("*").alias("ticks"))


def latest_by_session(sessions: DataFrame) -> DataFrame:
    """Upsert by session id: the last write wins, however late."""
    return sessions.groupBy("session").agg(F.max_by(F.struct("book", "chars", "active_ms"), "ts").alias("x"), F.max("ts").alias("ts")).select("session", "x.*", "ts")


QUERIES = {
    "reading_daily_distinct": lambda s, d: daily_distinct(role(s, d, "events_log"), "2024-01-15"),
    "reading_once_a_day": lambda s, d: once_a_day(role(s, d, "events_log")),
    "reading_speed_median": lambda s, d: speed_median(free_sessions(role(s, d, "sessions")), ["book"]),
    "speed_first5_last10": lambda s, d: first_and_last(free_sessions(role(s, d, "sessions"))),
    "speed_last10_per_chunk": lambda s, d: last_per_chunk(free_sessions(role(s, d, "sessions"))),
    "speed_daily_30d": lambda s, d: daily_series(role(s, d, "sessions"), "2024-01-30"),
    "session_active_time": lambda s, d: active_time(role(s, d, "events_log")),
    "session_upsert": lambda s, d: latest_by_session(role(s, d, "sessions").withColumn("session", F.col("session") % 700)),
}
_LOG, _SESSIONS = sql_role("events_log"), sql_role("sessions")
_FREE = f"(SELECT *, chars * 60000.0 / active_ms AS cpm FROM {_SESSIONS} x WHERE {_VALID} AND mode = 'free')"
ORACLE = {
    "reading_daily_distinct": f"SELECT slug, count(DISTINCT url) AS total, count(DISTINCT CASE WHEN day = DATE '2024-01-15' THEN url END) AS today FROM {_LOG} x GROUP BY slug",
    "reading_once_a_day": f"SELECT day, slug, url, min(ts) AS ts FROM {_LOG} x GROUP BY ALL",
    "reading_speed_median": f"SELECT book, round(median(cpm), 3) AS cpm, count(*) AS sessions, round(sum(words) * 60000.0 / sum(active_ms), 3) AS wpm FROM (SELECT *, median(cpm) OVER (PARTITION BY book) AS m, count(*) OVER (PARTITION BY book) AS n FROM {_FREE} y) z WHERE n < 3 OR cpm <= 2 * m GROUP BY book",
    "speed_first5_last10": f"SELECT *, CASE WHEN n >= 10 THEN round(personal - baseline, 2) END AS change FROM (SELECT book, round(median(CASE WHEN a <= 5 THEN cpm END), 3) AS baseline, round(median(CASE WHEN z <= 10 THEN cpm END), 3) AS personal, min(day) AS first_day, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ts, session) AS a, row_number() OVER (PARTITION BY book ORDER BY ts DESC, session DESC) AS z FROM {_FREE} y) q GROUP BY book) r",
    "speed_last10_per_chunk": f"SELECT book, chunk, round(median(cpm), 3) AS cpm, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY book, chunk ORDER BY ts DESC, session DESC) AS z FROM {_FREE} y WHERE chunk IS NOT NULL) q WHERE z <= 10 GROUP BY ALL",
    "speed_daily_30d": f"SELECT day, mode, round(sum(active_ms) / 60000.0, 3) AS minutes, count(CASE WHEN {_VALID} THEN 1 END) AS valid FROM {_SESSIONS} x WHERE day <= DATE '2024-01-30' AND day > DATE '2024-01-30' - 30 GROUP BY ALL",
    "session_active_time": f"SELECT slug, CAST(sum(CASE WHEN gap IS NULL OR gap > 90000000 THEN 0 ELSE least(gap, 2000000) END) AS BIGINT) AS active_us, count(CASE WHEN gap > 90000000 THEN 1 END) AS idle_gaps, count(*) AS ticks FROM (SELECT slug, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY slug ORDER BY ts, event_id) AS gap FROM {_LOG} x) y GROUP BY slug",
    "session_upsert": f"SELECT session % 700 AS session, arg_max(book, ts) AS book, arg_max(chars, ts) AS chars, arg_max(active_ms, ts) AS active_ms, max(ts) AS ts FROM {_SESSIONS} x GROUP BY 1",
}
