"""Benchmark decontamination: exact containment of item-sized word windows, found through a prefix-filtered set join.

Items are cut into windows of `window` consecutive words (shorter items are one window). A window is a sequence of
`shingle`-word shingles; containment must be whole, so its necessary prefix is one token: the rarest of its shingles.
1. A first pass over the texts counts the documents of every benchmark shingle: the order of rarity.
2. A second pass joins documents and windows on the prefix tokens alone. The token's place in the window fixes the candidate's
   start (positional bound), which must leave room for the whole window (length bound).
3. A candidate counts when the window's words stand at its place, word by word: exact containment.
Documents without a prefix token are settled by the join; no other shingle is looked up for them."""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, small_batches, stage, table, utf8

WINDOW = 13
SHINGLE = 5
#: Benchmark words that one broadcast may hold; a larger benchmark is matched in slices, each with its own pass over the texts.
SLICE_WORDS = 2_000_000

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then the maximal runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The windows of a slice of the benchmark, with its shingles numbered. Sized by the slice, never by the corpus."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE):
        self.vocabulary: dict[bytes, int] = {}
        self.shingles: dict[tuple[int, ...], int] = {}
        seen: dict[tuple[int, ...], int] = {}
        self.windows: list[tuple[int, ...]] = []  # word numbers
        self.items: list[set[str]] = []  # of each window
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                key = tuple(ids[at : at + window])
                if key not in seen:
                    seen[key] = len(self.windows)
                    self.windows.append(key)
                    self.items.append(set())
                self.items[seen[key]].add(name)
        self.parts: list[list[int]] = []  # shingle numbers of each window, by place
        for w in self.windows:
            k = min(shingle, len(w))
            self.parts.append([self.shingles.setdefault(w[i : i + k], len(self.shingles)) for i in range(len(w) - k + 1)])
        for seed in count(7):  # no two shingles of one size share a code
            self.factors = np.random.default_rng(seed).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
            if all(len(np.unique(codes)) == len(codes) for _, codes, _, _ in self.table()):
                break

    def _code(self, columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for column, factor in zip(columns, self.factors, strict=False):
            total += (column.astype(np.uint64) + np.uint64(1)) * factor
        return total

    def table(self, kept: set[int] | None = None) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, sorted codes, shingle numbers, their words) of the kept shingles, or of all."""
        by_size: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for words_, number in self.shingles.items():
            if kept is None or number in kept:
                by_size.setdefault(len(words_), []).append((words_, number))
        out = []
        for k, own in sorted(by_size.items()):
            members = np.array([w for w, _ in own], np.int64).reshape(len(own), k)
            code = self._code(members.T)
            order = np.argsort(code)
            out.append((k, code[order], np.array([n for _, n in own], np.int64)[order], members[order]))
        return out

    def ids(self, text: bytes) -> np.ndarray:
        """Word numbers of a text, -1 where no item has the word."""
        get = self.vocabulary.get
        return np.array([get(x, -1) for x in words(text)], np.int64)

    def hits(self, ids: np.ndarray, tables) -> list[tuple[int, int]]:
        """(place, shingle number) of the table's shingles in a document of these word numbers."""
        out: list[tuple[int, int]] = []
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for k, codes, numbers, members in tables:
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            code = self._code([ids[at + i] for i in range(k)])
            found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[found] == code
            at, found = at[same], found[same]
            exact = np.all([ids[at + i] == members[found, i] for i in range(k)], axis=0) if len(at) else np.zeros(0, bool)
            out += zip(at[exact].tolist(), numbers[found[exact]].tolist(), strict=True)
        return out


def _frequencies(held) -> object:
    """Documents of a task with each shingle: one row per shingle, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = pickle.loads(held.value)
        tables, total = w.table(), Counter()
        for b in small_batches(batches):
            for text in utf8(b.column(0)):
                total.update({n for _, n in w.hits(w.ids(text), tables)})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["s", "n"])

    return run


_FOUND = "doc_id long, text_key string, n_words long, hit array<int>, items array<string>"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _joined(held, rarest) -> object:
    """rarest: shingle number -> (window, place of the shingle in it), for each window's rarest shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = pickle.loads(held.value)
        prefix: dict[int, list[tuple[int, int]]] = pickle.loads(rarest.value)
        tables, windows = w.table(set(prefix)), [np.array(x, np.int64) for x in w.windows]
        for b in small_batches(batches):
            out = []
            for doc, text in zip(b.column(0).cast(pa.int64()).to_pylist(), utf8(b.column(1)), strict=True):
                ids = w.ids(text)
                covered, items = np.zeros(len(ids) + 1, np.int32), set()
                for p, s in w.hits(ids, tables):
                    for window, place in prefix[s]:
                        start, own = p - place, windows[window]
                        if 0 <= start <= len(ids) - len(own) and (ids[start : start + len(own)] == own).all():
                            covered[start] += 1
                            covered[start + len(own)] -= 1
                            items |= w.items[window]
                hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0).astype(np.int32) if items else []
                out.append((doc, hashlib.md5(text).hexdigest(), len(ids), hit, sorted(items)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


def slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Runs of whole items, each of about `limit` words at most, so that what is broadcast has a bound whatever the benchmark."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len(words((row.text or "").encode()))
        if row.item is None or not n:
            continue
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((row.item, row.text.encode()))
        size += n
    if held:
        yield held


def _match(docs: DataFrame, items: list[tuple[str, bytes]], window: int, shingle: int, last: bool) -> DataFrame:
    """One slice of the benchmark against all documents. But for the last slice the result is staged and what was broadcast is
    released, so memory does not grow with the number of slices."""
    spark = docs.sparkSession
    w = Windows(items, window, shingle)
    held = spark.sparkContext.broadcast(cloudpickle.dumps(w))
    counts = docs.select("text").mapInArrow(_frequencies(held), "s int, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rarity = {r.s: r.n for r in counts.collect()} if items else {}  # a row per shingle of the slice at most
    prefix: dict[int, list[tuple[int, int]]] = {}
    for number, parts in enumerate(w.parts):
        place = min(range(len(parts)), key=lambda i: (rarity.get(parts[i], 0), parts[i], i))
        if rarity.get(parts[place]):  # a window with a shingle that no document has is in none
            prefix.setdefault(parts[place], []).append((number, place))
    rarest = spark.sparkContext.broadcast(pickle.dumps(prefix))
    found = docs.mapInArrow(_joined(held, rarest), _FOUND)
    if last:
        return found
    found = stage(found, "benchmark-slice")
    held.destroy()
    rarest.destroy()
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items array<string> sorted as strings, contaminated) per input row; text_key is
    the text's MD5.

    A word is hit when any occurrence of any item window covers it; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    Null and empty texts have no words and are clean; items of no words or without an id match nothing; an item of fewer
    words than the window is one window; equal windows of several items count for each item; rows that repeat a doc_id give
    repeated rows. An empty benchmark leaves all clean. Other columns are ignored."""
    own = id_and_text(docs, id_col, text_col)
    parts, waiting = [], []
    for items in slices(benchmark, slice_words):
        if waiting:
            parts.append(_match(own, waiting, window, shingle, False))
        waiting = items
    parts.append(_match(own, waiting, window, shingle, True))
    found = parts[0]
    if len(parts) > 1:
        # equal rows are interchangeable, so a number among them pairs the slices' results
        window_ = "row_number() over (partition by doc_id, text_key order by n_words) as _qw_row"
        whole = reduce(DataFrame.unionByName, [p.selectExpr("*", window_) for p in parts])
        found = whole.groupBy("doc_id", "text_key", "n_words", "_qw_row").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def brute_force(text: str | None, items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """The contract word by word, for tests."""
    own, hit, found = words((text or "").encode()), set(), set()
    for name, item in items:
        w = words((item or "").encode())
        for at in range(max(1, len(w) - window + 1) if w else 0):
            part = w[at : at + window]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(str(name))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)
