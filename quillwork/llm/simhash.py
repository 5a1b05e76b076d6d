"""Near-duplicate detection: 64-bit SimHash fingerprints linked through covering locality-sensitive hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, hex16, id_and_text, small_batches, stage, table, text_key, utf8
from .components import connected_components

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Distinct fingerprints of one bucket that a task compares at once; larger buckets are cut into tiles of two such chunks.
CHUNK = 4096
#: Rows of an id and a text's key (some 100 bytes each) that a broadcast may hold.
BROADCAST_IDS = 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash: a bit is set if more than half the shingle hashes have it; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) > shingle:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    else:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_key): one row per input row; null text counts as empty (fp 0). text_key is the text's MD5, in lower hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([fingerprint(t) for t in texts], pa.int64()), pa.array([hashlib.md5(t).hexdigest() for t in texts])], ["doc_id", "fp", "text_key"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, text_key string")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius+1)-1 masks. Bit i carries the nonzero vector 1 + i mod (2**(radius+1)-1) of F2**(radius+1); mask v keeps the
    bits whose vector has odd product with v. At most `radius` differing bits span a proper subspace, so some v is orthogonal
    to all of them, and the two words agree on mask v."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % top) & v).count("1") % 2) for v in range(1, top + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fp: np.ndarray, side: np.ndarray, two_sided: bool, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the graph that links two words (of different sides, if two_sided) within the radius: at most n-1 pairs."""
    left, out = np.ones(len(fp), bool), []
    for root in range(len(fp)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            rest = np.flatnonzero(left & (side != side[u])) if two_sided else np.flatnonzero(left)
            if not len(rest):
                continue
            near = rest[np.bitwise_count(fp[rest] ^ fp[u]) <= radius]
            left[near] = False
            queue += near.tolist()
            out += [(u, v) for v in near.tolist()]
    return out


def _links(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(t: pa.Table, last: bool):
            """Complete groups of a run of rows that is sorted by bucket; the last group waits for the next batch."""
            cols = [t.column(c).to_numpy() for c in ("mask", "key", "a", "b")]
            if not len(cols[0]):
                return [], None
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            cuts = [0, *new.tolist(), len(cols[0])]
            spans = list(zip(cuts, cuts[1:], strict=False))
            return (spans, None) if last else (spans[:-1], t.slice(spans[-1][0]))

        def edges(t: pa.Table, spans):
            fp, side, node = t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy(), t.column("node").to_numpy()
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            us, vs = [], []
            for lo, hi in spans:
                if hi - lo == 2:
                    if (side[lo] != side[lo + 1] or a[lo] == b[lo]) and (int(fp[lo]) ^ int(fp[lo + 1])).bit_count() <= radius:
                        us.append(node[lo])
                        vs.append(node[lo + 1])
                elif hi - lo > 2:
                    for i, j in forest(fp[lo:hi], side[lo:hi], a[lo] != b[lo], radius):
                        us.append(node[lo + i])
                        vs.append(node[lo + j])
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            spans, held = groups(t, False)
            yield edges(t, spans)
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            yield edges(held, groups(held, True)[0])

    return run


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """nodes(node long, fp long), one row per distinct fingerprint; returns (u, v) links whose transitive closure is that of
    all pairs within the radius. Every pair within the radius meets in a bucket of some mask; a bucket yields a spanning
    forest and never all its pairs; a bucket above `chunk` rows is dealt out as tiles of two chunks each."""
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(covering_masks(radius))])
    keys = nodes.select("node", "fp", F.explode(masks).alias("k")).select("node", "fp", "k.mask", "k.key")
    sizes = keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(sizes, ["mask", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    tiled = met.select("mask", "key", "fp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = tiled.select("mask", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "node")
    dealt = tiles.repartition(bucket_count(nodes.sparkSession), "mask", "key", "a", "b").sortWithinPartitions("mask", "key", "a", "b")
    return dealt.mapInArrow(_links(radius), "u long, v long")


def fingerprint_classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(doc_id, fp, ...) -> (fp, class_fp, component_id): each fingerprint's class, named by the class's least fingerprint, and the
    smallest doc_id in it, null where no row of the class has one."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(link_fingerprints(nodes.select(F.col("fp").alias("node"), "fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("class_fp"))
    classes = nodes.join(groups, "fp", "left").select("fp", "least", F.coalesce("class_fp", "fp").alias("class_fp"))
    return classes.join(classes.groupBy("class_fp").agg(F.min("least").alias("component_id")), "class_fp").select("fp", "class_fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, class_fp, text_key) per input row; component_id is the smallest doc_id reachable over links of
    `radius` or fewer differing bits, class_fp the smallest fingerprint, which names a class also where it has no id.

    Null or empty text has fingerprint 0 and links like any other; rows that repeat a doc_id give repeated rows; a null
    doc_id links like any other but never serves as a component id (null if no row of the class has an id). Empty tables give
    empty results; other columns are ignored."""
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    return fps.join(fingerprint_classes(fps, radius), "fp").select("doc_id", "fp", "component_id", "class_fp", "text_key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """Pipeline stage: of each class of near duplicates one document stays, with all its columns: the smallest doc_id, of equal ids
    the smallest text digest.

    Decided by id and text together, so a row goes only if it is itself a near duplicate of what stays, whatever else has its id.
    Rows without an id are documents as well and stay only where no row of their class has one. Of rows equal in id and text one
    stays. An empty table gives none. What goes is broadcast only if it is counted and small; beyond that the join shuffles."""
    found = stage(near_duplicates(docs), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    best = stage(found.groupBy("class_fp").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1").select("class_fp", "best"), "classes")
    judged = found.join(small(best), "class_fp").withColumn("own", rank)
    gone = stage(judged.where("own <> best").select(F.col("doc_id").alias("_qw_id"), F.col("text_key").alias("_qw_key")).distinct(), "gone")
    again = stage(judged.where("own = best").groupBy(F.col("doc_id").alias("_qw_id"), F.col("text_key").alias("_qw_key")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    same = F.col("doc_id").eqNullSafe(F.col("_qw_id")) & (F.col("_qw_own") == F.col("_qw_key"))
    kept = docs.withColumn("_qw_own", text_key(F.col("text"))).join(small(gone), same, "left_anti")
    if not again.isEmpty():
        repeats = small(again)
        kept = kept.join(repeats, same, "left_anti").unionByName(kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "_qw_own"]))
    return kept.select(*docs.columns)
