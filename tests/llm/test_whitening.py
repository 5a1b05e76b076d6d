"""Whitening against whole-number sums by plain loops and a covariance of its own."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quillwork.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component int, x string, n int"


def clean(rows):
    return [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(found, rows, components=4):
    """Every value of the result against the plain definition."""
    good = clean(rows)
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    deviation = {}
    for i, x in good:
        deviation.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), x))
    assert len(found) == len(good) * min(components, d)
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit, float) - mean
    v = np.array([[float(sum(Fraction(n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit) / n**3) for b in range(d)] for a in range(d)])
    values = np.linalg.eigvalsh(v)[::-1]
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, min(components, d) + 1))
    for k, part in by.items():
        e = values[k - 1]
        assert all(abs(r.explained - e / np.trace(v)) <= 1e-9 * r.explained for r in part)
        vector = np.linalg.eigh(v)[1][:, ::-1][:, k - 1]
        for r in part:
            assert any(r.deviation == dev for dev, _ in deviation[r.vec_id])
            own = [abs((np.array(x, float) - mean) @ vector) / math.sqrt(e) for _, x in deviation[r.vec_id]]
            assert min(abs(abs(r.whitened) - o) for o in own) < 1e-6 * max(1.0, abs(r.whitened))
    assert found[0].identity_error <= 1e-4
    return centred


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_plain_definition(spark, size):
    rng = random.Random(2)
    base = [[rng.gauss(0, s) * size for s in (9, 5, 3, 1, 0.5)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base)] + [(i + 100, base[0]) for i in range(40)]
    rows += [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0]), (302, [math.nan] * 5), (303, [math.inf, 0.0, 0.0, 0.0, 0.0]), (304, [-0.0] * 5), (None, base[1]), (0, base[2])]
    df = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA)
    found = whitening.whiten(df.repartition(6)).collect()
    if size > 1:  # squares beyond a long
        assert all(r.deviation is None or r.deviation < 1 << 63 for r in found)
        assert any(r.deviation is None for r in found)
        assert found[0].identity_error <= 1e-4
    else:
        check(found, rows)


def test_query_on_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").limit(60).collect()]
    cut = [(i, v[:6]) for i, v in rows]
    check(whitening.whiten(spark.createDataFrame([(*r, 0, "", 0) for r in cut], SCHEMA)).collect(), cut)
    whole = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = whitening.op12_whitening(spark, data).collect()
    x = np.array(sorted({tuple(v) for _, v in clean(whole)}))
    assert len(found) == 4 * len(clean(whole)) and found[0].n == len(x) and found[0].identity_error < 1e-9
    centred = len(x) * x - x.sum(axis=0)
    deviations = sorted((centred**2).sum(axis=1).tolist())
    assert sorted({r.deviation for r in found}) == sorted(set(deviations))
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    for r in found[:40]:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9


def test_scatter_is_exact_beyond_doubles(spark):
    rng = random.Random(4)
    x = [[rng.randrange(-(1 << 60), 1 << 60) for _ in range(3)] for _ in range(50)]
    n, sums, products = whitening.scatter(spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(4), 3, (1 << 120) * 50)
    assert n == 50 and sums == [sum(v[j] for v in x) for j in range(3)]
    assert products.tolist() == [[sum(v[a] * v[b] for v in x) for b in range(3)] for a in range(3)]


def test_no_variance_other_lengths_and_none(spark):
    make = lambda rows: spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA)
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None), (2, [])])).collect() == []
    one = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    flat = whitening.whiten(make([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 2.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened) if r.whitened is not None else None) for r in flat) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    assert {r.explained for r in flat} == {0.0, 1.0} and flat[0].identity_error < 1e-12
