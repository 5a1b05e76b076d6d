"""Exact substring dedup: every byte that a repeated string of LENGTH bytes covers is removed. Copies are settled by counting equal
units (128-bit digests of runs of windows); where units differ, suffixes are sorted by a difference cover and neighbours compared.

Suffixes are compared by names. A name of depth 3 is a triple of bytes; a name of depth 3k is a triple of names of depth k, made
of 64-bit mixes instead of ranks, so that naming needs no global sort and equal strings have equal names in every task.

1. Units. Each 400-byte window is known by the least depth-81 name inside it, a function of its content; a unit is a run of
   windows with the same one. A window can only have an equal under the same least name, so units whose least name occurs
   once are settled as unique, and equal units are counted, not compared: copies shrink to one row before any shuffle.
2. Difference cover. Where different units share a least name, suffixes are sampled at positions whose residues form a
   difference cover modulo V: two equal windows have, at some common distance below V, sampled suffixes that agree on the
   next LENGTH - V + 1 bytes. Sampled suffixes are named to that depth and sorted; those met once are dropped.
3. The remaining suffixes, those with a repeated sample within V - 1 bytes, are merged in, sorted by the names of their
   LENGTH-byte prefixes, and neighbours with equal names are compared byte by byte. Names only ever select what is compared.

Steps 2 and 3 run where the units of one least name have been brought together, many least names to a task; a least name with
more than LOCAL_KINDS different units has its suffixes dealt out over the cluster instead, by the same two steps; equal prefixes
are then known by their 128-bit digests, as neighbours are not in one memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, id_and_text, keyed_bytes, mix, sized, slide, small_batches, stage, table, unstage
from .passages import repeated_passages

LENGTH = 400
GRAM = 81
#: Different units of one least name (some 650 bytes each) that one task compares.
LOCAL_KINDS = 8192
#: Bytes of a least name's different units that one task compares, at some 110 bytes of memory each; long runs of one period are long units.
LOCAL_BYTES = 6 << 20
#: Bytes of units whose suffixes a task sorts at a time.
SORTED_BYTES = 1 << 19
#: Rows of an Arrow batch that a worker turns into Python objects at a time.
ROWS = 256


def difference_cover(r: int) -> tuple[int, list[int]]:
    """(modulus, residues): 24rr+36r+13 and 6r+4 residues whose differences are all residues of the modulus."""
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, list(accumulate(gaps, initial=0))


V, RESIDUES = difference_cover(1)
DEPTH = LENGTH - V + 1


def names(data: np.ndarray, depth: int) -> np.ndarray:
    """The name of depth 3, 9, 27, 81, ... of every position that has so many bytes before it ends."""
    t = data.astype(np.uint64)
    level = t[:-2] << np.uint64(16) | t[1:-1] << np.uint64(8) | t[2:]
    k = 3
    while k < depth:
        level = mix(level[: -2 * k], level[k:-k], level[2 * k :])
        k *= 3
    return level


def names_to(data: np.ndarray, depth: int) -> np.ndarray:
    """Names of any depth from 81 on, of overlapping names of the greatest power of three below it."""
    k = GRAM
    while 3 * k <= depth:
        k *= 3
    own = names(data, k)
    n = len(data) - depth + 1
    middle = min(k, depth - k)
    return mix(own[:n], own[middle : middle + n], own[depth - k : depth - k + n])


def units(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least name, first window, windows, whether the least name stands at several places within) of each unit."""
    data, width = np.frombuffer(text, np.uint8), length - GRAM + 1
    name = names(data, GRAM)
    least = slide(name, width, np.minimum)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cuts])
    size = np.diff(np.concatenate([first, [len(least)]]))
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(name == slide(np.concatenate([edge, least, edge]), width, np.maximum))
    value = name[chosen]
    twice = value[1:] == value[:-1]
    again = np.isin(least[first], value[1:][twice]) if twice.any() else np.zeros(len(first), bool)
    return least[first], first, size, again


_UNITS = "text_key binary, least long, unit binary, first int, size int, again boolean"


def _find_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, ROWS):
        out: list[list] = [[] for _ in range(6)]
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(text) < LENGTH:
                continue
            least, first, size, again = units(text)
            out[0] += [key] * len(first)
            out[1].append(least.view(np.int64))
            out[2] += [xxhash.xxh3_128_digest(text[p : p + n + LENGTH - 1]) for p, n in zip(first.tolist(), size.tolist(), strict=True)]
            out[3].append(first)
            out[4].append(size)
            out[5].append(again)
        whole = [np.concatenate(x) if x else np.zeros(0) for x in (out[1], out[3], out[4], out[5])]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(whole[0].astype(np.int64)), pa.array(out[2], pa.binary()), pa.array(whole[1].astype(np.int32)), pa.array(whole[2].astype(np.int32)), pa.array(whole[3].astype(bool))], [x.split()[0] for x in _UNITS.split(", ")])


def _slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(text_key, least, unit, first, size, copies) -> (least, unit, copies, slice): the bytes of all the unit's windows, once
    for each task that meets the text, however many rows repeat it there."""
    keys = wanted.groupBy("text_key").agg(F.collect_list(F.struct("least", "unit", "copies", "first", "size")).alias("wanted"))
    keys = stage(keys, "substring-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for b in small_batches(batches, ROWS):
            rows = []
            for key, text, want in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key not in done:
                    done.add(key)
                    rows += [(w["least"], w["unit"], w["copies"], text[w["first"] : w["first"] + w["size"] + LENGTH - 1]) for w in want]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["least", "unit", "copies", "slice"])

    return docs.where(F.octet_length("text") >= LENGTH).join(sized(keys, 48, 56 * F.size("wanted")), "text_key").select("text_key", "text", "wanted").mapInArrow(cut, "least long, unit binary, copies long, slice binary")


def _same_bytes(data: np.ndarray, at: np.ndarray, name: np.ndarray, copied: np.ndarray) -> np.ndarray:
    """The places whose LENGTH bytes occur elsewhere: sorted by name, neighbours are compared byte by byte. A neighbour pair one byte
    on from another needs only its last byte compared. Should unlike strings share a name, that name's places are compared by their
    bytes alone."""
    order = np.argsort(name, kind="stable")
    ranked, placed = name[order], at[order]
    alike = np.flatnonzero(ranked[1:] == ranked[:-1])
    p, q = placed[alike], placed[alike + 1]
    rank = np.argsort(p, kind="stable")
    p, q = p[rank], q[rank]
    follows = np.zeros(len(p), bool)
    follows[1:] = (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1)
    equal = np.zeros(len(p), bool)
    equal[follows] = data[p[follows] + LENGTH - 1] == data[q[follows] + LENGTH - 1]
    windows, heads = np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.flatnonzero(~follows)
    for k in range(0, len(heads), 4096):
        h = heads[k : k + 4096]
        equal[h] = (windows[p[h]] == windows[q[h]]).all(axis=1)
    met = copied[order]
    if equal.all():
        met[alike] = met[alike + 1] = True
        return np.sort(placed[met])
    for k in range(0, len(p), 4096):
        equal[k : k + 4096] = (windows[p[k : k + 4096]] == windows[q[k : k + 4096]]).all(axis=1)
    mixed = np.isin(ranked, np.unique(ranked[alike[rank[~equal]]]))
    sure = alike[~mixed[alike]]
    met[sure] = met[sure + 1] = True
    by_bytes: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(mixed).tolist():
        by_bytes.setdefault(data[placed[i] : placed[i] + LENGTH].tobytes(), []).append(i)
    for own in by_bytes.values():
        if len(own) > 1:
            met[own] = True
    return np.sort(placed[met])


def local_runs(units_: list[tuple[bytes, int, bytes]]) -> list[tuple[bytes, list[dict[str, int]]]]:
    """(unit, copies, bytes) of whole groups -> the runs [a, b) of repeated windows of each unit that occurs once itself."""
    sizes = np.array([len(x[2]) for x in units_], np.int64)
    copies = np.array([x[1] for x in units_], np.int64)
    data = np.frombuffer(b"".join(x[2] for x in units_), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(units_), dtype=np.int32), sizes)
    place = (np.arange(len(data)) - starts[owner]).astype(np.int32)
    room = sizes.astype(np.int32)[owner] - place

    def met(at: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The places whose name occurs elsewhere: neighbours in sorted order, or copies of the unit."""
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        return np.sort(at[order[same[1:] | same[:-1] | (copies[owner[at[order]]] > 1)]])  # a superset, if unlike strings share a name

    sampled = np.flatnonzero(np.isin(place % V, RESIDUES) & (room >= DEPTH))
    repeated = met(sampled, names_to(data, DEPTH)[sampled])
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.maximum(repeated - V + 1, starts[owner[repeated]]), 1)
    np.add.at(change, repeated + 1, -1)
    remaining = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (room >= LENGTH))
    if not len(remaining):
        return []
    found = _same_bytes(data, remaining, names_to(data, LENGTH)[remaining], copies[owner[remaining]] > 1)
    found = found[copies[owner[found]] == 1]
    cuts = np.flatnonzero((np.diff(found) > 1) | (np.diff(owner[found]) > 0)) + 1
    out: dict[int, list[dict[str, int]]] = {}
    for run in np.split(found, cuts) if len(found) else ():
        out.setdefault(int(owner[run[0]]), []).append({"a": int(place[run[0]]), "b": int(place[run[-1]]) + 1})
    return [(units_[k][0], runs) for k, runs in out.items()]


_RUNS = "unit binary, runs array<struct<a:int,b:int>>"
_RUNS_ARROW = [pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by least name and unit; groups are never cut, repeated rows of a unit are one."""
    held: list[tuple[bytes, int, bytes]] = []
    size, last = 0, None

    def emit() -> pa.RecordBatch:
        found = local_runs(held)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(_RUNS_ARROW)], ["unit", "runs"])

    for b in small_batches(batches, ROWS):
        for least, unit, copies, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if least != last and size > SORTED_BYTES:
                yield emit()
                held, size = [], 0
            if least != last or unit != held[-1][0]:
                held.append((unit, copies, text))
                size += len(text)
            last = least
    if held:
        yield emit()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names to DEPTH bytes of the suffixes at the cover's residues."""
    for b in batches:
        unit, at, name, copies = [], [], [], []
        for u, c, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
            own = names_to(np.frombuffer(text, np.uint8), DEPTH)
            places = np.arange(len(own))
            places = places[np.isin(places % V, RESIDUES)]
            unit += [u] * len(places)
            copies.append(np.full(len(places), c))
            at.append(places)
            name.append(own[places])
        whole = [np.concatenate(x) if x else np.zeros(0) for x in (at, name, copies)]
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.binary()), pa.array(whole[0].astype(np.int32)), pa.array(whole[1].astype(np.uint64).view(np.int64)), pa.array(whole[2].astype(np.int64))], ["unit", "at", "name", "copies"])


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes with a repeated sample within V - 1 bytes, by the digest of their LENGTH-byte prefixes."""
    for b in batches:
        unit, at, prefix, copies = [], [], [], []
        for u, c, text, marks in zip(*(x.to_pylist() for x in b.columns), strict=True):
            n = len(text) - LENGTH + 1
            near = np.zeros(n + 1, np.int32)
            places = np.array(marks)
            np.add.at(near, np.clip(places - V + 1, 0, n), 1)
            np.add.at(near, np.clip(places + 1, 0, n), -1)
            for p in np.flatnonzero(np.cumsum(near[:n]) > 0).tolist():
                unit.append(u)
                at.append(p)
                prefix.append(xxhash.xxh3_128_digest(text[p : p + LENGTH]))
                copies.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.binary()), pa.array(at, pa.int32()), pa.array(prefix, pa.binary()), pa.array(copies, pa.int64())], ["unit", "at", "prefix", "copies"])


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose name occurs more than once, copies counted; counted before the shuffle, joined back skew-safely."""
    met = rows.groupBy(name).agg(F.sum("copies").alias("_qw_met")).where("_qw_met > 1").select(name)
    return rows.join(met, name, "left_semi")


def dealt_runs(slices: DataFrame) -> DataFrame:
    """The two steps with suffixes dealt out by name: slices(unit, copies, slice) -> (unit, runs array<struct<a int, b int>>): the windows [a, b) of each unit that occur again."""
    samples = _repeated(slices.mapInArrow(_sampled, "unit binary, at int, name long, copies long"), "name")
    marks = samples.groupBy("unit").agg(F.collect_list("at").alias("marks"))
    rest = slices.join(marks, "unit").select("unit", "copies", "slice", "marks").mapInArrow(_remaining, "unit binary, at int, prefix binary, copies long")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places in b.column(1).to_pylist():
                p = np.unique(places)
                cuts = np.flatnonzero(np.diff(p) > 1) + 1
                out.append([{"a": int(x[0]), "b": int(x[-1]) + 1} for x in np.split(p, cuts)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["unit", "runs"])

    return _repeated(stage(rest, "substring-suffixes"), "prefix").groupBy("unit").agg(F.collect_list("at").alias("at")).mapInArrow(runs, "unit binary, runs array<struct<a:int,b:int>>")


def repeated_spans(docs: DataFrame, local_kinds: int = LOCAL_KINDS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """docs(text_key, text binary) -> (text_key, starts, ends): for each text with repeats, its maximal removed runs."""
    spark = docs.sparkSession
    found = stage(docs.select("text_key", "text").mapInArrow(_find_units, _UNITS), "substring-units")
    hot = stage(found.groupBy("least").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("least"), "substring-least")
    candidates = stage(found.join(sized(hot, 24), "least", "left_semi"), "substring-candidates")
    unstage(found)
    kinds = stage(candidates.groupBy("least", "unit").agg(F.count("*").alias("copies"), F.max("again").alias("again"), F.min(F.struct("text_key", "first", "size")).alias("at")), "substring-kinds")
    met = kinds.groupBy("least").agg(F.count("*").alias("kinds"), F.sum(F.col("at.size") + LENGTH).alias("bytes"), F.min("copies").alias("fewest"), F.max("again").alias("again")).where("fewest = 1 and (kinds > 1 or again)")
    near = (F.col("kinds") <= local_kinds) & (F.col("bytes") <= local_bytes)
    mixed = stage(kinds.join(met.select("least", near.alias("near")), "least").select("least", "near", "unit", "copies", "at.text_key", "at.first", "at.size"), "substring-mixed")
    local = _slices(docs, mixed.where("near"))
    runs = local.repartition(bucket_count(spark), "least").sortWithinPartitions("least", "unit").mapInArrow(_local, _RUNS)
    large = mixed.where("not near")
    settled = kinds.where("copies > 1").select("unit", F.array(F.struct(F.lit(0).alias("a"), F.col("at.size").alias("b"))).alias("runs"))
    if not large.isEmpty():
        dealt = dealt_runs(stage(_slices(docs, large).dropDuplicates(["unit"]).drop("least"), "substring-slices"))
        runs = runs.unionByName(dealt.join(settled, "unit", "left_anti"))
    placed = candidates.select("text_key", "unit", "first").distinct().join(settled.unionByName(runs), "unit")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Window runs of a text's units to removed byte runs, each as far as it goes."""
        for b in batches:
            starts, ends = [], []
            for own in b.column(1).to_pylist():
                pairs = sorted((u["first"] + r["a"], u["first"] + r["b"] - 1 + LENGTH) for u in own for r in u["runs"])
                out = [list(pairs[0])]
                for a, e in pairs[1:]:
                    if a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], e)
                    else:
                        out.append([a, e])
                starts.append([x[0] for x in out])
                ends.append([x[1] for x in out])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["text_key", "starts", "ends"])

    return placed.groupBy("text_key").agg(F.collect_list(F.struct("first", "runs")).alias("units")).mapInArrow(merge, "text_key binary, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", local_kinds: int = LOCAL_KINDS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_passages, n_passage_words, kept binary) per input row.

    Removed is each byte covered by a 400-byte string that starts anywhere else as well, in the same text or another, judged on
    the input. Null and empty texts, and texts below 400 bytes, keep all; a row that repeats another of 400 bytes or more loses
    all; matches never cross rows; an empty table gives no rows; other columns are ignored. n_passages and n_passage_words count the
    passages of more than 50 words that another row holds as well, of any length in bytes; nothing is removed for them."""
    own = keyed_bytes(id_and_text(docs, id_col, text_col))
    spans = stage(repeated_spans(own, local_kinds, local_bytes), "substring-spans").join(stage(repeated_passages(own), "passage-counts"), "text_key", "full")
    spans = sized(stage(spans, "substring-found"), 80, 8 * F.greatest(F.size("starts"), F.lit(0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ROWS):
            rows = []
            for doc, text, starts, ends, passages, passage_words in zip(*(x.to_pylist() for x in b.columns), strict=True):
                kept = text if not starts else b"".join(text[a:e] for a, e in zip([0, *ends], [*starts, len(text)], strict=True))
                rows.append((doc, len(text), len(text) - len(kept), len(starts or ()), passages or 0, passage_words or 0, kept))
            types = (*[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words", "kept"])

    found = own.join(spans, "text_key", "left").select("doc_id", "text", "starts", "ends", "n_passages", "n_passage_words")
    return found.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, n_passages long, n_passage_words long, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the contract's columns: the passages of more than 50 words that stand in another document too, which may be below 400
    bytes and are then not removed, and the remaining text itself; where a cut falls inside a character, what is left of it reads
    as U+FFFD."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The contract window by window, for tests."""
    data, seen = [(t or "").encode() for t in texts], {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), len(d) - len(kept), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out
