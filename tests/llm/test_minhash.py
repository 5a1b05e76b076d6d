"""Fingerprints against a plain version in whole numbers, and their estimates against true similarities."""

import functools
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillwork.llm import minhash

SCHEMA = "doc_id long, text string, part int, kind string, next int, following string"
FULL = 1 << 64


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % FULL
    return x ^ (x >> 31)


@functools.cache
def key(n, salt):
    return mix(((n + 1) * 0x9E3779B97F4A7C15 + salt) % FULL)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@functools.cache
def word(w):
    raw = xxhash.xxh64_intdigest(w, 42) if len(w) > minhash.BLOCK else sum(key(b, 42) * pow(0x9E3779B97F4A7C15, i, FULL) for i, b in enumerate(w))
    return mix((raw + 0x9E3779B97F4A7C15) % FULL)


@functools.cache
def plain(text):
    """One bin at a time, as the module's description says."""
    least = {}
    for s in shingles(text):
        h = mix((len(s) * (key(5, 43) | 1) + sum(word(w) * (key(j, 43) | 1) for j, w in enumerate(s))) % FULL)
        least[h >> 55] = min(least.get(h >> 55, FULL), h)
    if not least:
        return ""
    bits = 0
    for i in range(512):
        j = i if i in least else min(least, key=lambda j: key(i * 512 + j, 45))
        bits = bits << 2 | (mix(least[j] ^ key(i, 44)) & 3)
    return f"{bits:0256x}"


def estimate(a, b):
    if not a or not b:
        return float(a == b)
    x, y = int(a, 16), int(b, 16)
    same = sum((x >> 2 * i) & 3 == (y >> 2 * i) & 3 for i in range(512)) / 512
    return min(1.0, max(0.0, (same - 0.25) / 0.75))


def expected(rows):
    """Sorted result rows of (id, text) rows."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, other = plain(text), plain(changed)
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, round(estimate(own, other), 9), round(estimate(own, plain(after)), 9)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, df.collect())), key=repr)


def test_rows_of_every_kind(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["Über", "the", "cat", "Ran", "x", "日本", "𝄞𝄞"]) + rng.choice(["", "s", "\t", "\n"]) for _ in range(n))
    texts = [some(n) for n in (1, 2, 4, 5, 6, 7, 30, 200, 1500)] + ["", None, " \t\n", "same text here", "same text here", "w" * (minhash.BLOCK + 5) + " b", "日" * 40]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "same id, other text"), (None, "no id"), (None, None), (9, texts[3])]
    df = spark.createDataFrame([(*r, 1, "k", 2, "f") for r in rows], SCHEMA)
    assert found(minhash.compared(df.repartition(5))) == expected(rows)
    assert found(minhash.compared(df.repartition(1))) == expected(rows)
    own = {(r.doc_id, r.fingerprint) for r in minhash.fingerprints(df).collect()}
    assert own == {(i, plain(t or "")) for i, t in rows}


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "a b c d e f g", 0, "", 0, "")], SCHEMA)
    assert found(minhash.compared(one)) == expected([(1, "a b c d e f g")])
    assert minhash.compared(one.where("false")).collect() == []


def test_query_on_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found(minhash.op13_minhash(spark, data)) == expected(rows)


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 0.9, 1.0])
def test_estimate_is_unbiased(share):
    rng, errors = random.Random(5), []
    for _ in range(40):
        n = rng.choice([40, 120, 600, 3000])
        a = [f"w{rng.random()}" for _ in range(n)]
        b = a[: int(n * share)] + [f"w{rng.random()}" for _ in range(n - int(n * share))]
        ta, tb = " ".join(a), " ".join(b)
        codes, some = minhash.Hasher().codes([ta.encode(), tb.encode()])
        true = jaccard(shingles(ta), shingles(tb))
        errors.append(minhash.alike(codes[:1], some[:1], codes[1:], some[1:])[0] - true)
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_unlike_short_texts_are_not_alike():
    texts = [f"word{i} other{i}".encode() for i in range(200)]
    codes, some = minhash.Hasher().codes(texts)
    near = minhash.alike(codes[:-1], some[:-1], codes[1:], some[1:])
    assert near.max() < 0.2


def test_likeness_of_columns(spark):
    texts = ["a b c d e f g h", "a b c d e f g x", "", None]
    f = [plain(t or "") for t in texts]
    df = spark.createDataFrame([(x, y) for x in [*f, None] for y in f], "a string, b string")
    for r in df.select("a", "b", minhash.likeness(F.col("a"), F.col("b")).alias("j")).collect():
        assert abs(r.j - estimate(r.a or "", r.b or "")) < 1e-9
