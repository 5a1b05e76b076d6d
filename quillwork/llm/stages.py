"""The stages of the corpus pipeline: each applies one operator to its predecessor's documents and puts its decisions into effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_key
from .decontamination import decontaminate
from .packing import pack
from .quality import keep_good
from .secrets import mask_secrets
from .simhash import BROADCAST_IDS, keep_one_per_group


def quality_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null, empty and repeated rows are each judged by their own text."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays; null and empty texts are one class; rows without an id stay only where
    their class has no id."""
    return keep_one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each row by its own text, whether or not it has an id or shares one. Null and empty texts stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = stage(found.where("contaminated").select(F.col("text_key").alias("_qw_key")).distinct(), "contaminated")
    n = bad.count()
    if not n:
        return docs
    return docs.join(F.broadcast(bad) if n <= BROADCAST_IDS else bad, text_key(F.col("text")) == F.col("_qw_key"), "left_anti")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span, base and linked, is overwritten: character for character, by asterisks. All rows stay, null text stays null."""
    return mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece; null and empty texts are a piece of the end id alone; repeated rows are packed each; none for no rows."""
    return pack(docs)
