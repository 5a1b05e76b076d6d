"""Metering answers from files."""

import json

from quillwork.sources import metering


def series(model, kind, *points):
    return {"metric": {"labels": {"type": kind}}, "resource": {"labels": {"model_user_id": model}}, "points": [{"interval": {"endTime": e} if e else {}, "value": v} for e, v in points]}


def test_files(spark, tmp_path):
    ten, later = ("2024-01-01T10:00:00Z", {"int64Value": "5"}), ("2024-01-01T10:00:01Z", {"doubleValue": 7.9})
    (tmp_path / "a.json").write_text(json.dumps({"timeSeries": [series(" m ", "input", ten, later, ("2024-01-01T10:00:00Z", {"int64Value": "0"}), (None, {"int64Value": "9"})), series("", "input", ten), series("m", "cached", ten)], "unit": "x"}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"timeSeries": [series("m", "input", ("2024-01-01T09:30:00+00:00", {"int64Value": "1"})), series("m", "output", ten, ("soon", {"int64Value": "4"}), ("2024-01-01T10:00:00Z", {}))]}))
    (tmp_path / "c.json").write_text("no json")
    (tmp_path / "d.json").write_text("{}")
    found = metering.hours(metering.points(metering.read_answers(spark, f"{tmp_path}/*.json")))
    assert sorted(map(tuple, found.collect())) == [("2024-01-01T09", "m", "input", 6), ("2024-01-01T09", "m", "output", 5), ("2024-01-01T10", "m", "input", 7)]
    stored = spark.createDataFrame([("2024-01-01T09", "m", "input", 2), ("2024-01-01T08", "m", "input", 3)], "hour string, model string, type string, tokens long")
    again = metering.refreshed(stored, found)
    assert sorted(map(tuple, again.collect())) == [("2024-01-01T08", "m", "input", 3), ("2024-01-01T09", "m", "input", 6), ("2024-01-01T09", "m", "output", 5), ("2024-01-01T10", "m", "input", 7)]
