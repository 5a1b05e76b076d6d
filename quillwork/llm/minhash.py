"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once; the top bits of the hash choose one of `BINS` bins, and a bin keeps its least hash. A bin
that no shingle fell into takes the hash of a filled bin, each filled bin being as likely as any other and the choice depending on
nothing but the two bins (optimal densification). Of each bin's hash, mixed with the bin's number so that copies of one hash give
independent bits, the `BITS` lowest are stored, packed. The share of equal bins exceeds the Jaccard similarity by chance agreements,
one in 2^BITS of the rest, which the estimate takes off.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. A text of fewer than five words is one shingle; a text of none has the empty
fingerprint, which is like itself and like no other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import id_and_text, small_batches, stage, table

SHINGLE, BINS, BITS, SEED = 5, 512, 2, 42
#: Bytes of words that are hashed together; a longer word is hashed by XXH64.
BLOCK = 1 << 18
#: Filled bins below which an empty bin compares all of them, instead of trying its bins in order.
FEW = 24
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = 0x9E3779B97F4A7C15
_SPACES = bytes(32 if chr(b) in " \t\n\v\f\r" else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(salt))


class Hasher:
    """Tables of the hash: a key per byte, powers of an odd base and of its inverse, a key per place of a shingle and per bin."""

    def __init__(self, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS, seed: int = SEED):
        self.shingle, self.bins, self.bits, self.seed = shingle, bins, bits, seed
        self.byte = _keys(256, seed)
        self.byte[32] = 0
        base = _ODD | 1
        step = np.full(BLOCK, base, np.uint64)
        step[0] = 1
        self.power = np.multiply.accumulate(step)
        step[1:] = pow(base, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(step)
        self.place = _keys(shingle + 1, seed + 1) | np.uint64(1)
        self.bin = _keys(bins, seed + 2)
        self.choice = _keys(bins * bins, seed + 3).reshape(bins, bins)
        self.probes = self.choice.argsort(axis=1).astype(np.int16)

    def words(self, text: bytes) -> np.ndarray:
        """A hash of each word: its bytes' keys times rising powers, summed modulo 2^64, and mixed."""
        data = np.frombuffer(text.lower().translate(_SPACES), np.uint8)
        gap = np.ones(len(data) + 2, bool)
        np.equal(data, 32, out=gap[1:-1])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        out, k = np.empty(len(starts), np.uint64), 0
        while k < len(starts):
            end = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK, "right")))
            if ends[k] - starts[k] > BLOCK:
                out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), self.seed)
            else:
                part, at = data[starts[k] : ends[end - 1]], starts[k:end] - starts[k]
                out[k:end] = np.add.reduceat(self.byte[part] * self.power[: len(part)], at) * self.inverse[at]
            k = end
        return mixed(out + np.uint64(_ODD))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Hashes of all runs of `shingle` words; fewer words are one run."""
        size = min(len(words), self.shingle)
        if not size:
            return words
        runs = len(words) - size + 1
        total = np.full(runs, size, np.uint64) * self.place[self.shingle]
        for j in range(size):
            total += words[j : j + runs] * self.place[j]
        return mixed(total)

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(code of each bin, whether there are words), a row per text."""
        least = np.full((len(texts), self.bins), _NONE)
        for row, text in zip(least, texts, strict=True):
            hashes = self.shingles(self.words(text))
            np.minimum.at(row, (hashes >> np.uint64(64 - self.bins.bit_length() + 1)).astype(np.int64), hashes)
        filled = least != _NONE
        some = filled.any(axis=1)
        self.densify(least, filled)
        return (mixed(least ^ self.bin) & np.uint64((1 << self.bits) - 1)).astype(np.uint8), some

    def densify(self, least: np.ndarray, filled: np.ndarray) -> None:
        """Each empty bin takes the hash of the filled bin that stands first in its own order of all bins."""
        counts = filled.sum(axis=1)
        for k in np.flatnonzero((counts > 0) & (counts < FEW)):
            full, empty = np.flatnonzero(filled[k]), np.flatnonzero(~filled[k])
            least[k, empty] = least[k, full[self.choice[np.ix_(empty, full)].argmin(axis=1)]]
        rows, empty = np.nonzero(~filled & (counts >= FEW)[:, None])
        nth = 0
        while len(rows):
            taken = self.probes[empty, nth]
            met = filled[rows, taken]
            least[rows[met], empty[met]] = least[rows[met], taken[met]]
            rows, empty, nth = rows[~met], empty[~met], nth + 1

    def packed(self, codes: np.ndarray, some: np.ndarray) -> list[str]:
        bits = np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(codes), -1)
        return [row.tobytes().hex() if any_ else "" for row, any_ in zip(np.packbits(bits, axis=1), some, strict=True)]


def alike(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The estimated Jaccard similarity of each pair of rows of codes, with chance agreements taken off."""
    chance = 0.5**bits
    near = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, near, (some_a == some_b).astype(float))


def unpacked(fingerprints: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The codes of packed fingerprints of one size, and whether each has words."""
    some = np.array([bool(f) for f in fingerprints], bool)
    size = max((len(f) for f in fingerprints), default=0) // 2
    data = np.frombuffer(b"".join(bytes.fromhex(f) if f else bytes(size) for f in fingerprints), np.uint8).reshape(len(fingerprints), size)
    return np.packbits(np.unpackbits(data, axis=1).reshape(len(data), -1, bits), axis=2)[:, :, 0] >> (8 - bits), some


@pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of two columns of fingerprints; null is the empty one."""
    both = [*a.fillna(""), *b.fillna("")]
    codes, some = unpacked(both)
    return pd.Series(alike(codes[: len(a)], some[: len(a)], codes[len(a) :], some[len(a) :]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row per input row, without a shuffle; null text is empty; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in small_batches(batches):
            found = hasher.packed(*hasher.codes([t.encode() for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split(" ")[0] for c in _RESULT.split(", ")]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _judged(hasher: Hasher, ids: list, texts: list[str], followings: list[str], own: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> list[list]:
    """The result's columns; `own` and `after` are the codes of texts and followings."""
    changed = [edited(t, f).encode() for t, f in zip(texts, followings, strict=True)]
    other = hasher.codes(changed)
    return [ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], hasher.packed(*own), hasher.packed(*other), alike(*own, *other).tolist(), alike(*own, *after).tolist()]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text and the document after it, by descending id (null ids last, equal ids by text); the first
    document comes after the last.

    Documents are dealt out by ranges of that order and sorted there, so neighbours meet within a partition; the last document of a
    partition meets the first of the next partition in a second step over those alone, two for each partition. Null text is empty;
    repeated rows follow each other; a single document follows itself; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part, held = Hasher(), TaskContext.get().partitionId(), None

        def out(columns: list[list], kind: int, text: str | None = None) -> pa.RecordBatch:
            n = len(columns[0])
            more = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *more], [*_NAMES, "kind", "part", "text"])

        none = lambda doc: [[doc], *[[None]] * 6]
        for b in small_batches(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            codes, some = hasher.codes([t.encode() for t in texts])
            if held is None:
                yield out(none(ids[0]), 1, texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
                codes, some = np.concatenate([held[2], codes]), np.concatenate([held[3], some])
            held = (ids[-1], texts[-1], codes[-1:], some[-1:])
            if len(ids) > 1:
                yield out(_judged(hasher, ids[:-1], texts[:-1], texts[1:], (codes[:-1], some[:-1]), (codes[1:], some[1:])), 0)
        if held is not None:
            yield out(none(held[0]), 2, held[1])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in small_batches(batches):
            texts, followings = b.column(1).to_pylist(), b.column(2).to_pylist()
            own, after = (hasher.codes([t.encode() for t in c]) for c in (texts, followings))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_judged(hasher, b.column(0).to_pylist(), texts, followings, own, after), kinds, strict=True)], _NAMES)

    order = F.desc_nulls_last("doc_id")
    dealt = id_and_text(docs, id_col, text_col).repartitionByRange(order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")
    found = stage(dealt.mapInArrow(run, f"{_RESULT}, kind int, part int, text string"), "compared")
    heads = found.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    parts = sorted(r.next for r in heads.select("next").collect())  # one number for each partition with rows
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = found.where("kind = 2").select("doc_id", "text", "part").join(after, "part").join(heads, "next")
    return found.where("kind = 0").select(*_NAMES).unionByName(last.select("doc_id", "text", "following").mapInArrow(ends, _RESULT))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
