"""Structured Streaming forms of the incremental operators. The batch operators are the truth; each stream states its bound on
late data, which the batch form does not have."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.attention import JUMP_RATIO, OPEN_RATIO
from ..operators.reading import IDLE_S, TICK_S


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def _timed(rows: DataFrame) -> DataFrame:
    """Watermarks need instants: a time without zone is read in the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rollup_stream(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly counters per key and model, updated as rows come; rows later than the watermark are left to the batch form."""
    is_ = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    return _timed(calls).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "api_key", "model").agg(F.count("*").alias("tries"), is_("success").alias("successes"), is_("error", "refused").alias("errors"), is_("quota").alias("quotas")).select(F.col("w.start").alias("hour"), "api_key", "model", "tries", "successes", "errors", "quotas")


def once_stream(log: DataFrame, late: str = "1 day") -> DataFrame:
    """One row per slug and url while the watermark keeps its key: resends are dropped."""
    return _timed(log).withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "slug", "url"])


_STATE = "last_us long, active_us long, idle_gaps long, ticks long"


def active_time_stream(ticks: DataFrame) -> DataFrame:
    """Attention per reader as a running state: the last tick and the sums. Ticks of one trigger are put in order; across triggers
    they must not go back in time by more than the trigger holds. State is four numbers per reader, whatever its history."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts_us")
        last, active, idle, n = state.get if state.exists else (None, 0, 0, 0)
        for at in rows.ts_us:
            gap = None if last is None else int(at) - last
            if gap is not None and gap <= IDLE_S * 1_000_000:
                active += min(gap, TICK_S * 1_000_000)
            elif gap is not None:
                idle += 1
            last, n = int(at), n + 1
        state.update((last, active, idle, n))
        yield pd.DataFrame([(key[0], active, idle, n)], columns=["slug", "active_us", "idle_gaps", "ticks"])

    own = ticks.select("slug", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return own.groupBy("slug").applyInPandasWithState(step, "slug long, active_us long, idle_gaps long, ticks long", _STATE, "update", GroupStateTimeout.NoTimeout)


_SIGNED = "day string, model string, successes long, errors long, refusals long"


def signed_stream(calls: DataFrame) -> DataFrame:
    """Signed counter rows as calls come: a refusal right after a success of the same chapter and key takes it back in the counters
    of the success. Sums of the rows are the batch counters. Calls of one trigger are put in order; the state is the last call of
    a chapter and key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts_us", "id"])
        last, day, model = state.get if state.exists else (None, None, None)
        out = []
        for x in rows.itertuples():
            if x.outcome == "refused" and last == "success":
                out.append((day, model, -1, 1, 1))
            else:
                out.append((x.day, x.model, int(x.outcome == "success"), int(x.outcome in ("error", "quota", "refused")), int(x.outcome == "refused")))
            last, day, model = x.outcome, x.day, x.model
        state.update((last, day, model))
        yield pd.DataFrame(out, columns=["day", "model", "successes", "errors", "refusals"])

    own = calls.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("day").cast("string").alias("day"), "model", "outcome", "chapter", "api_key")
    return own.groupBy("chapter", "api_key").applyInPandasWithState(step, _SIGNED, "outcome string, day string, model string", "append", GroupStateTimeout.NoTimeout)


def intake_stream(numbers: DataFrame) -> DataFrame:
    """numbers(book, number) as they come -> (book, number, state): applied when it is the next after the book's head, repeated when
    the head has it, gap otherwise; a gap does not move the head. The state is one number per book, which starts at zero."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, out = state.get[0] if state.exists else 0, []
        for n in sorted(int(x) for b in batches for x in b.number):
            kind = "repeated" if n <= head else "applied" if n == head + 1 else "gap"
            head += kind == "applied"
            out.append((key[0], n, kind))
        state.update((head,))
        yield pd.DataFrame(out, columns=["book", "number", "state"])

    return numbers.where("number is not null").select("book", F.col("number").cast("long").alias("number")).groupBy("book").applyInPandasWithState(step, "book string, number long, state string", "head long", "append", GroupStateTimeout.NoTimeout)


def upsert_batch(target: str, key: str, at: str):
    """foreachBatch sink: the newest row per key wins. Each batch writes a whole new version next to the old one and readers take
    the last that is complete, so a repeated batch only writes its version again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = latest_version(spark, target, batch_id)
        rows = batch if old is None else old.unionByName(batch)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), at).alias("_x")).select(key, "_x.*")
        newest.write.mode("overwrite").parquet(f"{target}/version={batch_id:09d}")

    return write


def latest_version(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The last complete version of an upsert target (before a batch, if one is named)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    found = sorted(x.getPath().toString() for x in system.listStatus(path) if x.getPath().getName().startswith("version=") and system.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
    if before is not None:
        found = [x for x in found if int(x.rsplit("=", 1)[1]) < before]
    return spark.read.parquet(found[-1]) if found else None


_SESSION = "tick long, touch long, ratio double, ms long, tempo boolean, touched boolean, finished boolean, skipped boolean"


def session_stream(events: DataFrame, late: str = "10 minutes", idle_ms: int = 1_800_000) -> DataFrame:
    """events(session, at, seq, kind, visible, dialog, flowing, ratio), `at` in milliseconds, as they come -> (session, mode, active_ms, finished,
    skipped, closed): the rules of `reading_sessions` as a state of eight values. Every trigger tells how a session stands; when none of its
    events came for `idle_ms` of event time it is told a last time, closed, and its state goes. Events of one trigger are put in order."""

    def told(key: tuple, s: tuple, closed: bool) -> pd.DataFrame:
        _, _, _, ms, tempo, touched, finished, skipped = s
        row = (key[0], "tempo" if tempo else "free", 0 if tempo and not touched else ms, finished, skipped, closed)
        return pd.DataFrame([row], columns=["session", "mode", "active_ms", "finished", "skipped", "closed"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield told(key, state.get, True)
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        tick, touch, last, ms, tempo, touched, finished, skipped = state.get if state.exists else (None, None, None, 0, False, False, False, False)
        for at, kind, visible, dialog, flowing, ratio in rows[["at", "kind", "visible", "dialog", "flowing", "ratio"]].itertuples(index=False, name=None):
            at, ratio = int(at), None if ratio is None or ratio != ratio else float(ratio)
            if kind == "tick":
                gap = min(at - (at if tick is None else tick), TICK_S * 1000)
                if visible is True and dialog is not True:
                    ms += gap if flowing is True else max(0, min(at, (at if touch is None else touch) + IDLE_S * 1000) - (at - gap))
                tempo = tempo or flowing is True
            if ratio is not None and kind in ("open", "scroll"):
                skipped = skipped or (kind == "open" and ratio > OPEN_RATIO) or (kind == "scroll" and last is not None and ratio - last > JUMP_RATIO)
                last = ratio
            tick = at if kind in ("open", "tick") else tick
            touch = at if kind in ("open", "touch") else touch
            touched, finished = touched or kind == "touch", finished or kind == "end"
        held = (tick, touch, last, ms, tempo, touched, finished, skipped)
        state.update(held)
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["at"].max()) + idle_ms))
        yield told(key, held, False)

    timed = events.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", late)
    return timed.groupBy("session").applyInPandasWithState(step, "session string, mode string, active_ms long, finished boolean, skipped boolean, closed boolean", _SESSION, "update", GroupStateTimeout.EventTimeTimeout)
