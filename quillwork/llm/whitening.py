"""Embedding whitening with an exact scatter matrix.

Entries are taken as whole numbers, x = floor(256 * c). Each partition multiplies its vectors, an extra entry of ones beside them, with
themselves modulo several primes below 2^20: products of residues over `ROWS` rows stay below 2^53, so the multiplication in doubles
is exact. The partitions' residues are summed by Spark; the primes are as many as the count and the largest entry need, so that
Chinese remaindering gives count, sums and scatter as whole numbers of any size. Their centred form, n times the scatter less the
products of the sums, is exact too, and rounded once, to the doubles whose eigenvectors whiten the vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, table

SCALE, COMPONENTS = 256, 4
#: Rows multiplied at once, and bytes of entries: 2^13 products of residues below 2^20 stay below 2^53.
ROWS, ROW_BYTES = 1 << 13, 16 << 20
TOP = 1 << 20
_LONG = 1 << 63


def primes_over(bound: int) -> list[int]:
    """The largest primes below 2^20, as many as make their product exceed the bound."""
    sieve = np.ones(TOP, bool)
    sieve[:2] = False
    for k in range(2, 1 << 10):
        if sieve[k]:
            sieve[k * k :: k] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > bound:
            break
        found.append(p)
        product *= p
    return found


def restored(residues: np.ndarray, primes: list[int]) -> np.ndarray:
    """Whole numbers between plus and minus half the primes' product, from their residues (a row per prime)."""
    total, product = np.zeros(residues.shape[1], object), 1
    for row, p in zip(residues, primes, strict=True):
        step = (row.astype(object) - total) * pow(product, -1, p) % p
        total, product = total + product * step, product * p
    return np.where(total > product // 2, total - product, total)


@dataclass
class Fit:
    """Over the distinct vectors: their number, sums, covariance's leading eigenvectors (columns) and values, and its trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components with any variance beyond rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(float(self.values.max(initial=0.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in longs where they fit, else in Python's whole numbers."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums))
        return x * self.n - np.array(self.sums, np.int64) if most < _LONG else x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Squared distance from the mean times n squared; null where it is no long."""
        far = self.centred(x)
        if far.dtype == object or (most := int(np.abs(far).max(initial=0))) ** 2 * far.shape[1] >= _LONG:
            return [d if d < _LONG else None for d in (far.astype(object) ** 2).sum(axis=1).tolist()]
        return (far**2).sum(axis=1).tolist() if most else [0] * len(x)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates along the components in units of their deviations; not a number where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.centred(x).astype(float) / self.n) @ self.vectors / np.sqrt(self.values)
        return np.where(self.usable, out, np.nan)


def longs(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE))


def _usable(vector: Column) -> Column:
    """No vector is null, and none of its entries null, not finite or beyond a long when scaled."""
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & (F.abs(c * SCALE) < float(_LONG)))


def _matrices(batch: pa.RecordBatch, column: int, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) of bounded slices of a batch."""
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, min(ROWS, ROW_BYTES // (8 * d)))
    for at in range(0, len(x), step):
        yield at, x[at : at + step]


def scatter(fit: DataFrame, d: int, bound: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, scatter) of fit(x), exact, where no entry of the scatter exceeds the bound."""
    primes = primes_over(2 * bound + 1)
    upper = np.triu_indices(d + 1)
    cells = len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for _, x in _matrices(b, 0, d):
                total = np.zeros((len(primes), cells), np.int64) if total is None else total
                for k, p in enumerate(primes):
                    r = np.column_stack([np.mod(x, p), np.ones(len(x), np.int64)]).astype(float)
                    total[k] = (total[k] + (r.T @ r)[upper].astype(np.int64) % p) % p
        if total is not None:
            for k in range(len(primes)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cells, k, np.int32)), pa.array(np.arange(cells, dtype=np.int32)), pa.array(total[k])], ["prime", "cell", "residue"])

    summed = fit.mapInArrow(run, "prime int, cell int, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue"))
    found = summed.toPandas()  # a row per prime and pair of dimensions, whatever the number of vectors
    residues = np.zeros((len(primes), cells), np.int64)
    residues[found["prime"], found["cell"]] = found["residue"] % np.array(primes)[found["prime"]]
    whole = np.zeros((d + 1, d + 1), object)
    whole[upper] = restored(residues, primes)
    whole.T[upper] = whole[upper]
    return int(whole[d, d]), whole[d, :d].tolist(), whole[:d, :d]


def covariance(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """The centred products over n, each rounded once."""
    s = np.array(sums, object)
    return ((products * n - np.outer(s, s)) / (n * n)).astype(float)


def principal(n: int, sums: list[int], v: np.ndarray, components: int) -> Fit:
    """Leading eigenvectors; a vector's sign makes its largest entry positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Fit(n, sums, vectors * signs, values, float(np.trace(v)))


def identity_error(rows: DataFrame, d: int, fit: Fit) -> float | None:
    """How far the whitened vectors' covariance is from the identity, over rows(x); null where no component has variance."""
    k = int(fit.usable.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            for _, x in _matrices(b, 0, d):
                w = np.column_stack([fit.whitened(x)[:, :k], np.ones(len(x))])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "part"])

    total = np.zeros((k + 1) ** 2)
    for r in rows.mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect():
        total[r.cell] = r.part
    total = total.reshape(k + 1, k + 1) / fit.n
    mean = total[k, :k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component, from the largest.

    Left out are vectors that are null, hold null or non-finite entries or such as no long holds when scaled, and vectors of another
    length than most have (of lengths equally frequent, the longest counts). The fit takes every distinct vector once; repeated rows
    are whitened each; null ids stay; other columns are ignored; an empty table gives no rows. Without variance along a component
    `whitened` is null, without any `explained` and `identity_error` are as well; a deviation beyond a long is null."""
    spark = embeddings.sparkSession
    id_type = embeddings.schema[id_col].dataType
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [id_type, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])
    usable = embeddings.where(_usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), longs(F.col(vector_col)).alias("x"))
    largest = F.greatest(F.array_max("x"), -F.array_min("x"))
    most = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"), F.max(largest).alias("largest")).orderBy(F.desc("rows"), F.desc("d")).first()
    if most is None or not most.d:
        return spark.createDataFrame([], schema)
    d, rows = most.d, usable.where(F.size("x") == most.d)
    distinct = stage(rows.select("x").distinct(), "vectors")
    n, sums, products = scatter(distinct, d, max(1, most.largest) ** 2 * most.rows)
    fit = principal(n, sums, covariance(n, sums, products), components)
    explained = [max(e, 0.0) / fit.trace if fit.trace > 0 else None for e in fit.values.tolist()]
    error, width = identity_error(distinct, d, fit), len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _matrices(b, 1, d):
                rows_, own = len(x), b.column(0).slice(at, len(x))
                each = np.repeat(np.arange(rows_), width)
                w = fit.whitened(x).ravel()
                columns = [own.take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows_)), pa.array(np.full(len(each), n)), pa.array(fit.deviation(x), pa.int64()).take(pa.array(each))]
                columns += [pa.array(w, mask=np.isnan(w)), pa.array(explained * rows_, pa.float64()), pa.array([error] * len(each), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
