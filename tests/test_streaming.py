"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from quillwork.operators import reading, upkeep, usage
from quillwork.sources.tables import role
from quillwork.streaming import usage as streams


def parts(spark, df, folder, n=3):
    for i in range(n):
        df.where(f"event_id % {n} = {i}").coalesce(1).write.parquet(f"{folder}/in", mode="append")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drained(stream, name, mode, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/c-{name}").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_rollup(spark, data, tmp_path):
    calls = role(spark, data, "calls").withColumnRenamed("id", "event_id")
    stream = parts(spark, calls, f"file://{tmp_path}")
    table = drained(streams.rollup_stream(stream, "60 days"), "rollup", "update", f"file://{tmp_path}")
    last = table.groupBy("hour", "api_key", "model").agg({"tries": "max"}).agg({"max(tries)": "sum"}).first()[0]
    assert last == calls.count() == usage.daily_rollup(role(spark, data, "calls")).agg({"tries": "sum"}).first()[0]


def test_once(spark, data, tmp_path):
    log = role(spark, data, "events_log")
    stream = parts(spark, log.unionByName(log), f"file://{tmp_path}")
    assert drained(streams.once_stream(stream, "60 days"), "once", "append", f"file://{tmp_path}").count() == reading.once_a_day(log).count()


def test_active_time(spark, data, tmp_path):
    log = role(spark, data, "events_log")
    log.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/in")
    got = {tuple(r) for r in drained(streams.active_time_stream(stream), "active", "update", f"file://{tmp_path}").collect()}
    assert got == {tuple(r) for r in reading.active_time(log).select("slug", "active_us", "idle_gaps", "ticks").collect()}


def test_upsert_sink(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    write = streams.upsert_batch(target, "k", "at")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    write(first, 0)
    write(spark.createDataFrame([(1, "c", 2), (3, "d", 1)], "k long, v string, at long"), 1)
    write(spark.createDataFrame([(1, "c", 2), (3, "d", 1)], "k long, v string, at long"), 1)
    assert {(r.k, r.v) for r in streams.latest_version(spark, target).collect()} == {(1, "c"), (2, "b"), (3, "d")}


def test_signed_counters(spark, data, tmp_path):
    calls = role(spark, data, "calls")
    for low, high in ((0, 11), (11, 21), (21, 32)):  # as they would come, some days a file
        calls.where(f"day(ts) >= {low} and day(ts) < {high}").coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    rows = drained(streams.signed_stream(stream), "signed", "append", f"file://{tmp_path}")
    got = rows.groupBy("day", "model").agg(*[F.greatest(F.lit(0), F.sum(c)).alias(c) for c in ("successes", "errors", "refusals")])
    assert {tuple(r) for r in got.collect()} == {(str(r.day), r.model, r.successes, r.errors, r.refusals) for r in upkeep.counters(calls).collect()}
    assert rows.where("successes < 0").count() > 0


def test_intake(spark, tmp_path):
    for batch in ([1, 2, 3], [5, 2], [4, 5, None]):
        spark.createDataFrame([("b", n) for n in batch], "book string, number long").coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    stream = spark.readStream.schema("book string, number long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = [(r.number, r.state) for r in drained(streams.intake_stream(stream), "intake", "append", f"file://{tmp_path}").collect()]
    assert sorted(got) == [(1, "applied"), (2, "applied"), (2, "repeated"), (3, "applied"), (4, "applied"), (5, "applied"), (5, "gap")]
