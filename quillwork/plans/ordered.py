"""Running values over long ordered groups. A group's rows are dealt out by ranges of its order, so that a group of any share of all rows is
many tasks; each block of a group is worked out by itself, a small table of the blocks' ends is scanned in order, and what comes
from earlier or later blocks is joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import reliable


def ordered(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df in range partitions of keys and order (nulls first), with `_block`, the number of the partition, and `_at`, which rises along
    the order. Written once to the shared folder, so that both stay as they are."""
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return reliable(dealt.withColumn("_block", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def carried(rows: DataFrame, keys: list[str], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """rows of `ordered` with, for each row, the nearest value before it (`before`) and after it (`after`) that is not null, and the sum of
    all values before it (`sums`, 0 where there are none), within its group. At most as many blocks of a group are scanned in one task as there are
    range partitions. What comes after is read from the last row on: a frame up to the end is worked out anew for every row."""
    before, after, sums = before or {}, after or {}, sums or {}
    place, upwards = Window.partitionBy(*keys, "_block"), (Window.unboundedPreceding, -1)
    back, ahead = place.orderBy("_at").rowsBetween(*upwards), place.orderBy(F.desc("_at")).rowsBetween(*upwards)
    own = rows.select(
        "*", *[F.last(v, True).over(back).alias(f"_o_{k}") for k, v in before.items()], *[F.last(v, True).over(ahead).alias(f"_o_{k}") for k, v in after.items()],
        *[F.coalesce(F.sum(v).over(back), F.lit(0)).alias(f"_o_{k}") for k, v in sums.items()],
    )
    there = lambda v: F.when(v.isNotNull(), F.col("_at"))
    ends = rows.groupBy(*keys, "_block").agg(
        *[F.max_by(v, there(v)).alias(k) for k, v in before.items()], *[F.min_by(v, there(v)).alias(k) for k, v in after.items()], *[F.sum(v).alias(k) for k, v in sums.items()], F.count("*").alias("_n")
    )
    along = Window.partitionBy(*keys)
    early, late = along.orderBy("_block").rowsBetween(*upwards), along.orderBy(F.desc("_block")).rowsBetween(*upwards)
    scanned = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *[F.last(k, True).over(early).alias(f"_c_{k}") for k in before],
        *[F.last(k, True).over(late).alias(f"_c_{k}") for k in after], *[F.coalesce(F.sum(k).over(early), F.lit(0)).alias(f"_c_{k}") for k in sums],
    )
    same = F.col("_block") == F.col("_k_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = own.join(scanned, same)
    found = [F.coalesce(f"_o_{k}", f"_c_{k}").alias(k) for k in [*before, *after]] + [(F.col(f"_o_{k}") + F.col(f"_c_{k}")).alias(k) for k in sums]
    return out.select(*rows.columns, *found)


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """df with the number of each row in its group's order, from 1."""
    return carried(ordered(df, keys, order), keys, sums={"_before": F.lit(1)}).select(*df.columns, (F.col("_before") + 1).alias(name))
