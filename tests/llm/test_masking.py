"""Masking against a plain loop over the spans, in whole texts and in blocks."""

import random
import time

from pyspark.sql import functions as F

from quillwork.llm import secrets

SCHEMA = "doc_id long, text string, start int, _n string"


def masked(text, spans):
    out = list(text)
    for x in spans:
        out[x["start"] : x["end"]] = "*" * (x["end"] - x["start"])
    return "".join(out)


def test_blocks(spark):
    rng = random.Random(3)
    pieces = ["password: hunter2hunter2x", "AKIA" + "B2" * 9, "0123456789abcdef" * 3, "é", "𝄞 word\n", "plain text ", "token=" + "a1" * 3000]
    texts = ["".join(rng.choice(pieces) for _ in range(n)) for n in (0, 5, 60, 900, 3000)] + [None, "", "f" * 40_000, "é" * 20_000]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] * 2, SCHEMA)
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(df.limit(len(texts))).collect()}
    found = secrets.mask_secrets(df).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        assert r.text == (None if texts[r.doc_id] is None else masked(texts[r.doc_id], spans[r.doc_id]))


def test_many_spans_in_one_text(spark):
    """A dump of 200 000 hexadecimal words takes seconds."""
    rng = random.Random(1)
    text = " ".join(f"{rng.getrandbits(64):016x}" for _ in range(200_000))
    began = time.time()
    (row,) = secrets.mask_secrets(spark.createDataFrame([(1, text, 0, "")], SCHEMA)).select(F.length("text").alias("n"), F.length(F.translate("text", "* ", "")).alias("left")).collect()
    assert (row.n, row.left) == (len(text), 0) and time.time() - began < 240
