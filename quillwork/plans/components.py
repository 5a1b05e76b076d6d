"""Connected components of a string-keyed edge table: minimum labels with pointer jumping, every round cut by a reliable checkpoint."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """checkpoint() into the session's shared folder; where a local session (as in tests) has none, into a temporary one."""
    context = df.sparkSession.sparkContext
    if not (context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")):
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillwork-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, component), component the least node reachable. Each round a node takes the least label among its
    neighbours and then the label of that label, so the rounds grow with the logarithm of the longest path."""
    both = reliable(edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = reliable(edges.select(F.col("u").alias("node")).union(edges.select("v")).where("node is not null").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("_n"))
        step = labels.join(near, "node", "left").select("node", F.least("component", "_n").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("_j"))
        moved = reliable(step.join(jump, "to", "left").select("node", F.least("to", "_j").alias("component"), "was"))
        changed = not moved.where("component <> was").isEmpty()
        labels = moved.select("node", "component")
        if not changed:
            return labels
