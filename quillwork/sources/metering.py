"""Metered tokens from a monitoring service's JSON answers: series with labels and points that carry the end of their interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import role, sql_role

#: What is read of an answer; other fields are never parsed.
ANSWER = """timeSeries array<struct<metric: struct<labels: struct<type: string>>, resource: struct<labels: struct<model_user_id: string>>,
  points: array<struct<interval: struct<endTime: string>, value: struct<int64Value: string, doubleValue: double>>>>>"""
# The kinds of tokens that are counted.
KINDS = ("input", "output")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Files of one answer each -> (path, answer)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("answer"))


def points(answers: DataFrame) -> DataFrame:
    """answers(answer, ...) -> (hour, model, type, tokens), a row per point that counts. A point's hour is that of the second before its end.
    Series without a model or of other kinds go, as do points without an end or with nothing in them; an answer that is no JSON has none."""
    series = answers.select(F.explode(F.from_json("answer", ANSWER)["timeSeries"]).alias("s"))
    named = series.select(F.trim("s.resource.labels.model_user_id").alias("model"), F.col("s.metric.labels.type").alias("type"), F.explode("s.points").alias("p")).where((F.col("model") != "") & F.col("type").isin(*KINDS))
    tokens = F.coalesce(F.col("p.value.int64Value").try_cast("double"), F.col("p.value.doubleValue")).cast("long")
    end = F.col("p.interval.endTime").try_cast("timestamp")
    hour = F.date_format(F.date_trunc("hour", end - F.expr("interval 1 second")), "yyyy-MM-dd'T'HH")
    return named.select(hour.alias("hour"), "model", "type", tokens.alias("tokens")).where("hour is not null and tokens <> 0")


def hours(found: DataFrame) -> DataFrame:
    """Tokens by hour, model and kind of one pull."""
    return found.groupBy("hour", "model", "type").agg(F.sum("tokens").alias("tokens"))


def refreshed(stored: DataFrame, pulled: DataFrame) -> DataFrame:
    """Stored hours after another pull: an hour that comes again is written over, as its last pull may have seen only part of it."""
    keys = ["hour", "model", "type"]
    return stored.join(pulled.select(*keys), keys, "left_anti").unionByName(pulled)


def _answers(s, d):
    """An answer for every call: its tokens in two series, now and then without a label, a value or an end."""
    end = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = lambda v, whole: F.struct(F.struct(F.when(F.col("id") % 19 > 0, end).alias("endTime")).alias("interval"), F.struct(F.when(F.lit(whole), v.cast("string")).alias("int64Value"), F.when(F.lit(not whole), v.cast("double")).alias("doubleValue")).alias("value"))
    series = lambda kind, v, whole: F.struct(F.struct(F.struct(kind.alias("type")).alias("labels")).alias("metric"), F.struct(F.struct(F.when(F.col("id") % 13 > 0, F.col("model")).otherwise(" ").alias("model_user_id")).alias("labels")).alias("resource"), F.array(point(v, whole), point(F.lit(0), whole)).alias("points"))
    both = F.array(series(F.lit("input"), F.col("tokens_in"), True), series(F.when(F.col("id") % 11 > 0, "output").otherwise("cached"), F.col("tokens_out"), False))
    return role(s, d, "calls").select(F.to_json(F.struct(both.alias("timeSeries"))).alias("answer"))


QUERIES = {"metered_hours": lambda s, d: hours(points(_answers(s, d)))}
ORACLE = {
    "metered_hours": f"""WITH c AS (SELECT strftime(date_trunc('hour', ts - INTERVAL 1 SECOND), '%Y-%m-%dT%H') AS hour, * FROM {sql_role('calls')} x WHERE id % 19 > 0 AND id % 13 > 0)
SELECT hour, model, type, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT hour, model, 'input' AS type, tokens_in AS tokens FROM c UNION ALL SELECT hour, model, 'output', tokens_out FROM c WHERE id % 11 > 0) q WHERE tokens <> 0 GROUP BY ALL""",
}
