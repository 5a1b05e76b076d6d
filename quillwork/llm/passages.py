"""Passages of more than 50 words that stand in several documents, whatever their length in bytes.

The words are those of decontamination: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Each window of WORDS words is known by
the least name of the GRAM-word sequences inside it, a function of its content; a unit is a run of windows with the same one. Units
whose least name stands in one text only are settled; a unit that stands in several texts repeats whole. Where unlike units share a
least name, one of each has its windows listed by their 128-bit digests: compared where the units of one least name have been brought
together, many least names to a task, or dealt out by digest where a least name has more than LOCAL_KINDS different units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, hex16, mix, sized, slide, small_batches, stage, unstage
from .decontamination import words

WORDS = 51
GRAM = 8
#: Different units of one least name (some 25 windows each) that one task compares.
LOCAL_KINDS = 8192
#: Windows that a task sorts at a time, unless one least name has more.
SORTED_WINDOWS = 1 << 16
#: Rows of an Arrow batch that a worker turns into Python objects at a time.
ROWS = 256

_BYTE = np.random.default_rng(400).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ROOT = pow(_BASE, -1, 1 << 64)
_SALT = np.array([0xD6E8FEB86659FD93], np.uint64)


def joined_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the words joined by one blank each, where each starts, where each ends)."""
    joined = b" ".join(words(text))
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if not joined:
        return joined, blanks, blanks
    return joined, np.concatenate([[0], blanks + 1]), np.append(blanks, len(joined))


def word_names(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word, a function of its bytes; unlike words may share one."""
    powers = np.cumprod(np.full(len(joined), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(joined, np.uint8)] * powers)])
    back = np.cumprod(np.full(len(joined), _ROOT, np.uint64))
    return (sums[end] - sums[start]) * back[start]


def units(joined: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least name, first window, windows) of each unit of a text of WORDS words or more."""
    name, k = word_names(joined, start, end), 1
    while k < GRAM:
        name = mix(name[:-k], name[k:], _SALT)
        k *= 2
    least = slide(name, WORDS - GRAM + 1, np.minimum)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first], first, np.diff(np.concatenate([first, [len(least)]]))


_UNITS = "k1 long, k2 long, least long, unit binary, first int, size int, words int"
_UNITS_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())


def _find_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words: of the whole text, with its first unit only."""
    for b in small_batches(batches, ROWS):
        out: list[list] = [[] for _ in _UNITS_ARROW]
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            joined, start, end = joined_words(text)
            if len(start) < WORDS:
                continue
            least, first, size = units(joined, start, end)
            k1, k2 = np.frombuffer(key, ">i8").tolist()
            n = len(first)
            out[0] += [k1] * n
            out[1] += [k2] * n
            out[2] += least.view(np.int64).tolist()
            out[3] += [xxhash.xxh3_128_digest(joined[a:e]) for a, e in zip(start[first].tolist(), end[first + size + WORDS - 2].tolist(), strict=True)]
            out[4] += first.tolist()
            out[5] += size.tolist()
            out[6] += [len(start)] + [None] * (n - 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _UNITS_ARROW, strict=True)], [x.split()[0] for x in _UNITS.split(", ")])


_WINDOWS = "least long, near boolean, k1 long, k2 long, unit binary, several boolean, windows binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted units with the digests of their windows, once for each task that meets the text, however many rows repeat it there."""
    done: set[bytes] = set()
    for b in small_batches(batches, ROWS):
        rows = []
        for key, text, wanted in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if key in done:
                continue
            done.add(key)
            joined, start, end = joined_words(text)
            k1, k2 = np.frombuffer(key, ">i8").tolist()
            for w in wanted:
                a, e = w["first"], w["first"] + w["size"]
                windows = b"".join(xxhash.xxh3_128_digest(joined[s:t]) for s, t in zip(start[a:e].tolist(), end[a + WORDS - 1 : e + WORDS - 1].tolist(), strict=True))
                rows.append((w["least"], w["near"], k1, k2, w["unit"], w["several"], windows))
        if rows:
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _WINDOWS.split(", ")])


_RUNS = "unit binary, runs array<struct<a:int,b:int>>"
_RUNS_ARROW = (pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))


def _as_runs(places: np.ndarray) -> list[dict[str, int]]:
    return [{"a": int(x[0]), "b": int(x[-1]) + 1} for x in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)]


def local_runs(held: list[tuple[int, int, bytes, bool, bytes]]) -> list[tuple[bytes, list[dict[str, int]]]]:
    """(k1, k2, unit, several, windows) of whole groups -> the runs [a, b) of repeated windows of each unit of one text."""
    sizes = np.array([len(x[4]) // 16 for x in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    digests = np.frombuffer(b"".join(x[4] for x in held), np.uint64).reshape(-1, 2)
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    head = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]))
    several = np.array([x[3] for x in held])
    met = np.logical_or.reduceat(several[owner[order]], head)
    for k in (0, 1):
        key = np.array([x[k] for x in held], np.int64)[owner[order]]
        met |= np.minimum.reduceat(key, head) != np.maximum.reduceat(key, head)
    hit = np.sort(order[np.repeat(met, np.diff(np.append(head, len(order))))])
    hit = hit[~several[owner[hit]]]
    begin = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero(np.diff(owner[hit])) + 1
    return [(held[owner[p[0]]][2], _as_runs(p - begin[owner[p[0]]])) for p in np.split(hit, cuts) if len(p)]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by least name and unit; groups are never cut, repeated rows of a unit are one."""
    held: list[tuple[int, int, bytes, bool, bytes]] = []
    size, last = 0, None

    def emit() -> pa.RecordBatch:
        found = local_runs(held)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(_RUNS_ARROW)], ["unit", "runs"])

    for b in small_batches(batches, ROWS):
        for least, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if least != last and size > SORTED_WINDOWS:
                yield emit()
                held, size = [], 0
            if least != last or row[2] != held[-1][2]:
                held.append(tuple(row))
                size += len(row[4]) // 16
            last = least
    if held:
        yield emit()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_as_runs(np.unique(p)) for p in b.column(1).to_pylist()], _RUNS_ARROW[1])], ["unit", "runs"])


def dealt_runs(listed: DataFrame) -> DataFrame:
    """The same with windows dealt out by their digests."""
    rows = listed.selectExpr("k1", "k2", "unit", "several", "posexplode(transform(sequence(0, length(windows) div 16 - 1), i -> substring(windows, i * 16 + 1, 16))) AS (at, window)")
    twice = rows.groupBy("window").agg((_unlike() | F.bool_or("several")).alias("met")).where("met").select("window")
    return rows.where("not several").join(twice, "window", "left_semi").groupBy("unit").agg(F.collect_list("at").alias("at")).mapInArrow(_runs, _RUNS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window runs of a text's units to maximal passages, counted."""
    for b in batches:
        keys, passages, covered = [], [], []
        for k1, k2, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
            pairs = sorted((u["first"] + r["a"], u["first"] + r["b"] - 1 + WORDS) for u in own for r in u["runs"])
            n = held = last = 0
            for a, e in pairs:
                n += not n or a > last
                held += max(0, e - max(a, last))
                last = max(last, e)
            keys.append(np.array([k1, k2], ">i8").tobytes())
            passages.append(n)
            covered.append(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(passages, pa.int64()), pa.array(covered, pa.int64())], ["text_key", "n_passages", "n_passage_words"])


_COUNTS = "text_key binary, n_passages long, n_passage_words long"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [np.array(k, ">i8").tobytes() for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([1] * len(keys), pa.int64()), b.column(2).cast(pa.int64())], ["text_key", "n_passages", "n_passage_words"])


def _unlike() -> Column:
    return (F.min("k1") != F.max("k1")) | (F.min("k2") != F.max("k2"))


def repeated_passages(docs: DataFrame, local_kinds: int = LOCAL_KINDS) -> DataFrame:
    """docs(text_key, text binary) -> (text_key, n_passages, n_passage_words): for each text with words in a sequence of WORDS words
    that another row holds as well, its maximal runs of such words and their words."""
    texts = docs.select("text_key", "text").where(F.octet_length("text") >= 2 * WORDS - 1)
    found = stage(texts.mapInArrow(_find_units, _UNITS), "passage-units")
    hot = stage(found.groupBy("least").agg(_unlike().alias("met")).where("met").select("least"), "passage-least")
    candidates = stage(found.join(sized(hot, 24), "least", "left_semi").drop("words"), "passage-candidates")
    copied = stage(found.where("words is not null").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("words").alias("words")).where("n > 1").select("k1", "k2", "words"), "passage-copies")
    unstage(found)
    kinds = stage(candidates.groupBy("least", "unit").agg(_unlike().alias("several"), F.min(F.struct("k1", "k2", "first", "size")).alias("at")), "passage-kinds")
    met = kinds.groupBy("least").agg(F.count("*").alias("kinds"), F.every("several").alias("all")).where("kinds > 1 and not all").select("least", (F.col("kinds") <= local_kinds).alias("near"))
    text_key = F.unhex(F.concat(hex16(F.col("at.k1")), hex16(F.col("at.k2")))).alias("text_key")
    wanted = kinds.join(sized(stage(met, "passage-met"), 25), "least").groupBy(text_key).agg(F.collect_list(F.struct("least", "near", "unit", "several", "at.first", "at.size")).alias("wanted"))
    wanted = sized(stage(wanted, "passage-wanted"), 48, 88 * F.size("wanted"))
    listed = stage(texts.join(wanted, "text_key").select("text_key", "text", "wanted").mapInArrow(_windows, _WINDOWS), "passage-windows")
    local = listed.where("near").drop("near").repartition(bucket_count(docs.sparkSession), "least").sortWithinPartitions("least", "unit")
    runs = local.mapInArrow(_local, _RUNS)
    large = listed.where("not near")
    if not large.isEmpty():
        runs = runs.unionByName(dealt_runs(large))
    settled = kinds.where("several").select("unit", F.array(F.struct(F.lit(0).alias("a"), F.col("at.size").alias("b"))).alias("runs"))
    placed = candidates.select("k1", "k2", "unit", "first").distinct().join(settled.unionByName(runs), "unit").join(sized(copied, 32), ["k1", "k2"], "left_anti")
    parts = placed.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "runs")).alias("units")).mapInArrow(_merge, _COUNTS)
    return parts.unionByName(copied.mapInArrow(_whole, _COUNTS))


def brute_force(texts: list[str | None]) -> list[tuple[int, int]]:
    """(n_passages, n_passage_words) window by window, for tests."""
    own = [re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower()) for t in texts]
    seen: dict[tuple[bytes, ...], set[int]] = {}
    for i, w in enumerate(own):
        for p in range(len(w) - WORDS + 1):
            seen.setdefault(tuple(w[p : p + WORDS]), set()).add(i)
    out = []
    for w in own:
        hit = [False] * len(w)
        for p in range(len(w) - WORDS + 1):
            if len(seen[tuple(w[p : p + WORDS])]) > 1:
                hit[p : p + WORDS] = [True] * WORDS
        out.append((sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), sum(hit)))
    return out
