"""Reading sessions from what a reader's page reports: ticks, touches, scrolls and the end of a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import duck, shared
from .reading import IDLE_S, TICK_S

# Shares of a chapter that a session may open at and that one scroll may skip.
OPEN_RATIO, JUMP_RATIO = 0.1, 0.2


def reading_sessions(events: DataFrame) -> DataFrame:
    """events(session, at, seq, kind, visible, dialog, flowing, ratio) -> (session, mode, active_ms, finished, skipped).

    at is in milliseconds, equal times go by seq. `open` and `tick` count the time since the one before, TICK_S at most, if the page is
    visible and no dialog is open; without a flowing text only up to IDLE_S after the last touch (`touch`, or the opening). A session that
    ever flowed is `tempo`, and counts nothing if it was never touched. `skipped`: opened beyond OPEN_RATIO, or a `scroll` went on by more
    than JUMP_RATIO at once. `finished`: an `end` came. Null flags are false, a null ratio tells nothing."""
    by = Window.partitionBy("session").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    kind, is_ = F.col("kind"), lambda c: F.coalesce(F.col(c), F.lit(False))
    told = events.select(
        "*", F.coalesce(F.last(F.when(kind.isin("open", "tick"), F.col("at")), True).over(by), F.col("at")).alias("_tick"),
        F.coalesce(F.last(F.when(kind.isin("open", "touch"), F.col("at")), True).over(by), F.col("at")).alias("_touch"), F.last(F.when(kind.isin("open", "scroll"), F.col("ratio")), True).over(by).alias("_ratio"),
    )
    gap = F.least(F.col("at") - F.col("_tick"), F.lit(TICK_S * 1000))
    awake = F.greatest(F.lit(0), F.least(F.col("at"), F.col("_touch") + IDLE_S * 1000) - (F.col("at") - gap))
    counted = F.when((kind == "tick") & is_("visible") & ~is_("dialog"), F.when(is_("flowing"), gap).otherwise(awake)).otherwise(0)
    skip = ((kind == "open") & (F.col("ratio") > OPEN_RATIO)) | ((kind == "scroll") & (F.col("ratio") - F.col("_ratio") > JUMP_RATIO))
    ever = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    per = told.groupBy("session").agg(ever((kind == "tick") & is_("flowing")).alias("tempo"), ever(kind == "touch").alias("touched"), F.sum(counted).alias("ms"), ever(kind == "end").alias("finished"), ever(skip).alias("skipped"))
    return per.select("session", F.when(F.col("tempo"), "tempo").otherwise("free").alias("mode"), F.when(F.col("tempo") & ~F.col("touched"), 0).otherwise(F.col("ms")).cast("long").alias("active_ms"), "finished", "skipped")


# A reader's events of a day are a session, their times drawn together; what each reports follows its number.
_EVENTS = """(SELECT concat(slug, '/', day) AS session, moment, seq, CASE WHEN n = 1 THEN 'open' WHEN seq % 7 = 0 THEN 'touch' WHEN seq % 5 = 1 THEN 'scroll' WHEN seq % 31 = 3 THEN 'end' ELSE 'tick' END AS kind,
  seq % 11 <> 2 AS visible, seq % 13 = 4 AS dialog, seq % 3 = 0 AND slug % 4 = 0 AS flowing, CASE WHEN seq % 17 = 5 THEN NULL ELSE CAST(seq % 29 AS DOUBLE) / 100 END AS ratio
  FROM (SELECT slug, day, event_id AS seq, CAST(floor({ms} / 400) AS BIGINT) AS moment, row_number() OVER (PARTITION BY slug, day ORDER BY CAST(floor({ms} / 400) AS BIGINT), event_id) AS n FROM {events_log}) e)"""
# DuckDB's epoch_ms rounds halves away from zero, where unix_millis cuts.
_MICROS = "unix_micros(CAST(ts AS TIMESTAMP))"
_SPARK_MS, _DUCK_MS = f"(({_MICROS} + CASE WHEN {_MICROS} < 0 THEN -500 ELSE 500 END) DIV 1000)", "epoch_ms(ts)"


def _events(s, d):
    return shared(s, d, _EVENTS.replace("{ms}", _SPARK_MS)).withColumnRenamed("moment", "at")


QUERIES = {"reading_sessions": lambda s, d: reading_sessions(_events(s, d))}
_W = 'PARTITION BY session ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING'
ORACLE = {
    "reading_sessions": f"""WITH e AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('open', 'tick') THEN moment END IGNORE NULLS) OVER w, moment) AS tick, coalesce(last_value(CASE WHEN kind IN ('open', 'touch') THEN moment END IGNORE NULLS) OVER w, moment) AS touch,
  last_value(CASE WHEN kind IN ('open', 'scroll') THEN ratio END IGNORE NULLS) OVER w AS was FROM {duck(_EVENTS.replace('{ms}', _DUCK_MS))} q WINDOW w AS ({_W})),
g AS (SELECT *, CASE WHEN kind = 'tick' AND visible AND NOT dialog THEN CASE WHEN flowing THEN least(moment - tick, 2000) ELSE greatest(0, least(moment, touch + 90000) - (moment - least(moment - tick, 2000))) END ELSE 0 END AS ms FROM e),
p AS (SELECT session, bool_or(kind = 'tick' AND flowing) AS tempo, bool_or(kind = 'touch') AS touched, sum(ms) AS ms, bool_or(kind = 'end') AS finished, bool_or(coalesce(kind = 'open' AND ratio > 0.1::DOUBLE OR kind = 'scroll' AND ratio - was > 0.2::DOUBLE, false)) AS skipped FROM g GROUP BY session)
SELECT session, CASE WHEN tempo THEN 'tempo' ELSE 'free' END AS mode, CAST(CASE WHEN tempo AND NOT touched THEN 0 ELSE ms END AS BIGINT) AS active_ms, finished, skipped FROM p""",
}
