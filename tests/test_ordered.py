"""Running values by blocks against the plain window, with a group that holds most rows and with null keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwork.plans.ordered import carried, numbered, ordered


@pytest.fixture
def rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    rng = random.Random(1)
    keys = ["hot"] * 300 + ["a", "b", None] * 20
    yield spark.createDataFrame([(k, rng.choice([None, *range(40)]), i, rng.choice([None, f"v{i}"])) for i, k in enumerate(keys)], "k string, no int, id int, v string").repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plain_window(spark, rows):
    dealt = ordered(rows, ["k"], ["no", "id"])
    hot = dealt.where("k = 'hot'").select("_block").distinct().count()
    assert hot > 1  # the large group is more than one task
    found = carried(dealt, ["k"], before={"last": F.col("v")}, after={"next": F.col("v")}, sums={"total": F.col("id"), "n": F.lit(1)})
    by = Window.partitionBy("k").orderBy("no", "id")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    plain = rows.select("k", "no", "id", F.last("v", True).over(back).alias("last"), F.first("v", True).over(ahead).alias("next"), F.coalesce(F.sum("id").over(back), F.lit(0)).alias("total"), (F.row_number().over(by) - 1).alias("n"))
    key = lambda df: sorted(map(tuple, df.select("k", "no", "id", "last", "next", "total", "n").collect()), key=repr)
    assert key(found) == key(plain)


def test_no_frame_up_to_the_end(spark, rows):
    """Spark works a frame that ends with its group out anew for every row, so a group's time grows with its square."""
    found = carried(ordered(rows, ["k"], ["no", "id"]), ["k"], after={"next": F.col("v")})
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_numbers(spark, rows):
    found = numbered(rows, ["k"], [F.desc("no"), "id"], "r")
    plain = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("no"), "id")))
    assert {(r.id, r.r) for r in found.collect()} == {(r.id, r.r) for r in plain.collect()}
    assert numbered(rows.where("false"), ["k"], ["no"]).collect() == []
