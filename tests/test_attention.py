"""Reading sessions rule by rule, and the stream against the batch form."""

import datetime as dt
import random

import duckdb
import pytest

from quillwork.operators.attention import ORACLE, QUERIES, reading_sessions
from quillwork.streaming.usage import session_stream

SCHEMA = "session string, at long, seq long, kind string, visible boolean, dialog boolean, flowing boolean, ratio double"


def one(spark, *events):
    rows = [("s", at, i, kind, *({"visible": True, "dialog": False, "flowing": False, "ratio": None} | more).values()) for i, (at, kind, more) in enumerate(events)]
    (r,) = reading_sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    return r.mode, r.active_ms, r.finished, r.skipped


START = (0, "open", {"ratio": 0.0})


@pytest.mark.parametrize(
    ("events", "found"),
    [
        ([START, (1000, "tick", {}), (9000, "tick", {})], ("free", 3000, False, False)),  # a tick counts two seconds at most
        ([START, (1000, "tick", {"visible": False}), (2000, "tick", {"dialog": True}), (3000, "tick", {})], ("free", 1000, False, False)),
        ([START, (89_500, "tick", {}), (91_000, "tick", {}), (92_000, "tick", {})], ("free", 2500, False, False)),  # up to 90 s after the last touch
        ([START, (91_000, "touch", {}), (91_500, "tick", {})], ("free", 2000, False, False)),
        ([START, (1000, "tick", {"flowing": True}), (2000, "touch", {}), (200_000, "tick", {"flowing": True})], ("tempo", 3000, False, False)),  # flowing text keeps a reader
        ([START, (1000, "tick", {"flowing": True})], ("tempo", 0, False, False)),  # but not one who never touches it
        ([(0, "open", {"ratio": 0.11}), (5, "end", {})], ("free", 0, True, True)),
        ([(0, "open", {"ratio": 0.1}), (5, "scroll", {"ratio": 0.3}), (6, "scroll", {"ratio": 0.1}), (7, "scroll", {"ratio": 0.29})], ("free", 0, False, False)),
        ([START, (5, "scroll", {"ratio": 0.21})], ("free", 0, False, True)),
        ([(5, "tick", {}), (6, "tick", {"visible": None})], ("free", 0, False, False)),
    ],
)
def test_rules(spark, events, found):
    assert one(spark, *events) == found


def test_milliseconds_round_as_in_sql(spark, tmp_path):
    """Times half a millisecond and more above a boundary of 400 ms, on both sides of 1970."""
    rows = [(10 * s + i, start + dt.timedelta(microseconds=400_000 * i - cut), s) for s, start in enumerate((dt.datetime(2024, 1, 24, 8), dt.datetime(1969, 12, 30, 8))) for i, cut in enumerate((0, 500, 501, 499, 1, 999, 1500))]
    spark.createDataFrame([(e, t, s, "view", 1.0, '{"k": 1}') for e, t, s in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    mine = QUERIES["reading_sessions"](spark, str(tmp_path))
    found = con.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE['reading_sessions']}) q").fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(found)


def test_stream_equals_batch(spark, tmp_path):
    rng, rows = random.Random(6), []
    for s in range(12):
        at = rng.randrange(5_000)
        for i in range(rng.randint(1, 60)):
            kind = "open" if i == 0 and s % 5 else rng.choice(["tick", "tick", "tick", "touch", "scroll", "end"])
            rows.append((f"s{s}", at, i, kind, rng.random() < 0.9, rng.random() < 0.1, s % 3 == 0 and rng.random() < 0.5, rng.choice([None, round(rng.random() * 0.3, 2)])))
            at += rng.choice([500, 1000, 4000, 40_000])
    df = spark.createDataFrame(rows, SCHEMA)
    batch = {r.session: tuple(r) for r in reading_sessions(df).collect()}
    cuts = [0, 30_000, 90_000, 200_000, 10**9]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where(f"at >= {low} and at < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 2:  # much later, so that all else is idle
            spark.createDataFrame([("later", 10**10, 0, "open", True, False, False, 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    told: dict[str, list] = {}

    def note(out, _):
        for r in out.collect():
            told.setdefault(r.session, []).append(tuple(r))

    def run(folder):
        stream = session_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), late="1 second")
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(note).trigger(availableNow=True).start()
        query.awaitTermination(240)

    run(str(tmp_path / "in"))
    assert {s: r[-1][:5] for s, r in told.items()} == batch
    assert not any(r[5] for rows_ in told.values() for r in rows_)
    for f in (tmp_path / "late").glob("*.parquet"):
        f.rename(tmp_path / "in" / f"late-{f.name}")
    run(str(tmp_path / "in"))
    closed = {s: r[-1] for s, r in told.items() if r[-1][5]}
    assert {s: r[:5] for s, r in closed.items()} == batch
