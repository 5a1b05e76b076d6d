"""Shared helpers of the training-data operators: staged tables, table loading, Arrow batch plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes that a broadcast may hold; larger joins shuffle.
BROADCAST_BYTES = 96 << 20
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S29, _S32 = np.uint64(29), np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where it is unset, a local session (as in tests) gets
    a temporary one; a cluster does not, as its machines would not share it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillwork-stage-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators read, under fixed names, so that extra columns never clash; null text is empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """The key by which rows are known by their text: 128 bits, in lower hex; null text is empty text."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def keyed_bytes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key binary, text binary): rows with the 128-bit digest of their text's bytes."""
    return docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), F.col("text").cast("binary").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()] if not pa.types.is_binary(column.type) else [x or b"" for x in column.to_pylist()]


def rows_out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices (no copies) of at most so many rows and bytes of text (a single longer text is a slice alone), so that a task's Python
    memory is bounded by them and not by the Arrow batch."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type)]
        held = sum((pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
        ends = np.cumsum(held)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def sized(df: DataFrame, row: int, more=None) -> DataFrame:
    """df, to be broadcast if its counted rows, of `row` bytes and `more` each, are within the bound."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if more is None else more), F.lit(0))).first()
    return F.broadcast(df) if rows * row + total <= BROADCAST_BYTES else df


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    y = b * _C[1]
    h = (a * _C[0]) ^ (y >> _S32 | y << _S32)
    h = (h ^ h >> _S29) * _C[2] + c * _C[3]
    return h ^ h >> _S32


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        a = op(a[:-k], a[k:])
        k *= 2
    return op(a[: len(a) - (width - k)], a[width - k :]) if k < width else a
