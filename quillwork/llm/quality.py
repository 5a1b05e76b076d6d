"""Quality classifier: a generalised additive model with pairwise interactions on features of the text alone.

Cyclic boosting: round after round, every feature in turn gets a shallow tree over its own bins, whose leaf values are added to
the feature's lookup table; then the pairs that reduce the loss most get tables of two binned features the same way. Scoring
adds one table entry per feature and pair, vectorised over rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table, utf8

#: Labelled rows that training takes at most, the lowest by hash of the id: a bounded sample, whatever the corpus.
TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 48
PAIR_BINS = 10
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
SEED = 11

FEATURES = ("words", "bytes", "letters", "capitals", "digits", "punctuation", "symbols", "bars", "bangs", "high_bytes", "word_length", "word_length_spread", "distinct_words", "top_word", "same_as_last", "all_caps", "symbol_tail", "distinct_lines", "line_length", "compression")

_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASSES[_c] = 1 if "a" <= _ch <= "z" else 2 if "A" <= _ch <= "Z" else 3 if "0" <= _ch <= "9" else 4 if _ch in ".,;:'\"()-?" else 5 if _ch in "#$%&*+/<=>@[\\]^_`{}~" else 6 if _ch == "|" else 7 if _ch == "!" else 8 if _c >= 128 else 0


def features(text: bytes) -> list[float]:
    """Of the whole text; an empty text has zeros throughout."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=9)
    size = len(text)
    letters = kinds[1] + kinds[2] + kinds[8]
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = sum(map(bytes.__eq__, words, words[1:]))
    caps = sum(map(bytes.isupper, words))
    tails = sum(w[-1] in b"#$%&*!|~^" for w in words)
    packer = zlib.compressobj(1)
    packed = len(packer.compress(text)) + len(packer.flush())
    return [
        np.log1p(n), np.log1p(size), letters / size, kinds[2] / max(1, letters), kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size, kinds[8] / size,
        float(lengths.mean()), float(lengths.std()), len(counts) / n, max(counts.values()) / n, last / n, caps / n, tails / n, len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))), packed / size,
    ]


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.pair_edges[f], x[:, f], "right"), np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(column) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values over ordered bins from gradient and hessian sums: greedy best cuts up to `leaves` leaves."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = _gain(gs[at] - gs[a], hs[at] - hs[a]) + _gain(gs[b] - gs[at], hs[b] - hs[at]) - _gain(gs[b] - gs[a], hs[b] - hs[a])
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), int(at[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut on each axis: four leaves, and how much loss they take off."""
    gs, hs = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    inner = lambda s: (s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1, -1] - s[-1:, 1:-1] - s[1:-1, -1:] + s[1:-1, 1:-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gq, hq = inner(gs), inner(hs)
    gain = sum(_gain(a, b) for a, b in zip(gq, hq, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for q, (rows, columns) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(i + 1, None), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, columns] = gq[q][i, j] / (hq[q][i, j] + 1.0)
    return float(gain[i, j] - _gain(gs[-1, -1], hs[-1, -1])), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Gam:
    """Logistic loss. No rows, or rows of one class, give a constant score at their smoothed rate (0.5 for none)."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Gam(float(np.log(rate / (1 - rate))), [_edges(x[:, f], BINS) for f in range(x.shape[1])], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    logit = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, own in enumerate(bins):
            p = 1 / (1 + np.exp(-logit))
            step = RATE * shallow_tree(np.bincount(own, y - p, len(model.tables[f])), np.bincount(own, p * (1 - p), len(model.tables[f])))
            model.tables[f] += step
            logit += step[own]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def sums(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[f] * wide[g] + coarse[g], values, wide[f] * wide[g]).reshape(wide[f], wide[g])

    p = 1 / (1 + np.exp(-logit))
    ranked = sorted(((-_pair_tree(sums(f, g, y - p), sums(f, g, p * (1 - p)))[0], f, g) for f, g in combinations(range(x.shape[1]), 2)))
    model.pairs = [(f, g) for _, f, g in ranked[:pairs]]
    model.pair_tables = [np.zeros((wide[f], wide[g])) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-logit))
            step = RATE * _pair_tree(sums(f, g, y - p), sums(f, g, p * (1 - p)))[1]
            model.pair_tables[k] += step
            logit += step[coarse[f], coarse[g]]
    return model


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> Gam:
    """Fit on the labelled documents outside the held-out fold, at most `limit` of them (lowest id hashes).

    Labels of null id or null value are left out; an id labelled more than once takes its smallest label; of an id's different
    texts the one of the smallest digest is learned from."""
    kept = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("y")).where("label_id is not null and y is not null")
    kept = kept.where(~held_out("label_id")).groupBy("label_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    rows = kept.collect()  # `limit` pairs of numbers at most
    chosen = kept.sparkSession.createDataFrame(rows, "label_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "text_key", "x"])

    own = id_and_text(docs).join(F.broadcast(chosen.select(F.col("label_id").alias("doc_id"))), "doc_id", "left_semi")
    one = own.mapInArrow(run, "doc_id long, text_key binary, x array<double>").groupBy("doc_id").agg(F.min(F.struct("text_key", "x")).alias("of"))
    seen = {r.doc_id: r.x for r in one.select("doc_id", "of.x").collect()}  # a row per id, `limit` at most
    both = sorted((r.label_id, r.y) for r in rows if r.label_id in seen)
    x = np.array([seen[i] for i, _ in both], np.float64).reshape(len(both), len(FEATURES))
    return fit(x, np.array([float(y == 1) for _, y in both]))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) per row; null text is scored as empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.scores(feature_matrix(utf8(b.column(1)))), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per input row. Only the text enters the score; empty and null texts are scored
    too; a null doc_id is never held out; repeated rows give equal scores; without labels every score is 0.5."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier accepts, with all their columns: rows are filtered as they pass, without a join.

    Null and empty texts are scored as empty texts; rows without an id or with a repeated one are each judged by their own text;
    without usable labels every score is 0.5 and all stay; an empty table gives no rows."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(feature_matrix(utf8(b.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
