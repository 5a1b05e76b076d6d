"""Secret scan in Spark SQL only: pattern spans with positions, and multipart credentials linked by interval joins.

A span's place comes from the text between matches: `split` and `regexp_extract_all` with one pattern give the gaps and the
matches in turn, and their running lengths are the starts (code points, as `length` counts them).

A credential has an access identifier, a secret and an endpoint. What identifies one provider's account, what could be a secret
of any, and what names a service are weak candidates: alone each is ordinary text, and only parts that complete each other
within a scope are reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, stage, table

ASSIGN = r"""(?<key>[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?(?<value>[A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, least length of the whole match). A maximal run is found at its start, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What starts an access identifier: a cloud key's prefix, a telephony account's, a service account's or client's own words. A text
#: without one of them has no identifier, so no link.
ID_PREFIXES = ("AKIA", "ASIA", "AIDA", "AROA")
ID_MARKS = (*ID_PREFIXES, "AC")
ID_WORDS = ("accountname", "account_name", "client_id", "clientid", "client-id", "iam.gserviceaccount.com", "username", "user_name", "user id")
#: Weak parts: reported only beside the parts that complete them. An identifier is a prefixed key, an account id, a named client,
#: account or user, or a service account's address; a secret is 40, 64 or 88 characters of base 64, or 32 or 40 of lower hex.
WEAK_ACCESS = (
    rf"(?<![A-Za-z0-9])(?:{'|'.join(ID_PREFIXES)})[A-Z0-9]{{8,}}"
    r"|(?<![A-Za-z0-9])AC[0-9a-f]{32}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?i:account_?name|client[_-]?id|user_?name|user id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"
    r"|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}@[A-Za-z0-9-]{1,63}\.iam\.gserviceaccount\.com"
)
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])(?:[A-Za-z0-9+/]{86}==|[A-Za-z0-9+/]{64}|[A-Za-z0-9+/]{40}|[0-9a-f]{32})(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?i)\b(?:[a-z][a-z0-9+.-]{1,20}://[a-z0-9.-]+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws|windows|googleapis|twilio|azure)\.(?:com|net))"
#: Parts of one credential stand within so many code points.
SCOPE = 400
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
MIN_SECRET = 12
#: Code points from which on a text is masked in blocks, and those of a block.
LONG, BLOCK = 16_384, 4096


def _bound(x: Column, body) -> Column:
    """body(x), with x worked out once however often the body names it."""
    return F.transform(F.array(x), body)[0]


def _placed(pairs: Column) -> Column:
    """pairs(gap, match) -> (start, end, match) of each match. A running sum that appends to an array copies what it has so far, so it
    runs within blocks of about the root of the number of pairs, and over the blocks' lengths to place them."""
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def running(lengths: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def within(block: Column, at: Column) -> Column:
        starts = running(F.transform(block, size))
        placed = F.transform(F.arrays_zip(block.alias("x"), starts.alias("at")), lambda p: F.struct((at + p["at"] + F.length(p["x"]["gap"])).alias("start"), (at + p["at"] + size(p["x"])).alias("end"), p["x"]["match"].alias("match")))
        return F.filter(placed, lambda p: p["match"].isNotNull())

    def whole(pairs_: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(pairs_))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs_) / width).cast("int") - 1), lambda k: F.slice(pairs_, k * width + 1, width))
        return _bound(blocks, lambda bs: F.flatten(F.transform(F.arrays_zip(bs.alias("b"), running(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + size(x)))).alias("at")), lambda b: within(b["b"], b["at"]))))

    return _bound(pairs, whole)


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start int, end int, kind string>> of the leftmost non-overlapping matches that `keep` accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    whole = _placed(F.arrays_zip(gaps.alias("gap"), found.alias("match")))
    if keep is not None:
        whole = F.filter(whole, lambda x: keep(x["match"]))
    return F.transform(whole, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


_NONE = "array<struct<start:int,end:int,kind:string>>"


def _where(test: Column, found: Column) -> Column:
    """A cheap test of the whole text keeps the pattern off texts that cannot match."""
    return F.when(test, found).otherwise(F.array().cast(_NONE))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `_qw_base`, sorted by start and then kind as listed, and `_qw_weak`, the candidate parts by start."""
    text, low = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col("_qw_low")
    folded = docs.select("*", F.inline(F.array(F.struct(F.lower(text).alias("_qw_low")))))  # once, however often it is named
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_SECRET
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = _where(named, spans(text, ASSIGN, "assign", long_value))
    access = _where(text.contains("AKIA"), spans(text, ACCESS, "access"))
    hexes = _where(text.rlike(HEX), spans(text, HEX, "hex"))
    # every link has an access id at one end, so texts without one have no weak part to report
    has_id = reduce(lambda a, b: a | b, [text.contains(p) for p in ID_MARKS] + [low.contains(w) for w in ID_WORDS]) & text.rlike(WEAK_ACCESS)
    weak = F.concat(spans(text, WEAK_ACCESS, "weak_access"), spans(text, WEAK_SECRET, "weak_secret"), spans(text, ENDPOINT, "endpoint"))
    return folded.select(*docs.columns, _ordered(F.concat(assign, access, hexes)).alias("_qw_base"), _where(has_id, weak).alias("_qw_weak"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def _ordered(found: Column) -> Column:
    keyed = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), _rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def _written(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _role(kind: Column) -> Column:
    """The part of a credential that a span can be."""
    return F.when(kind.isin("access", "weak_access"), "id").when(kind == "endpoint", "endpoint").otherwise("secret")


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """found(row_key, base, weak) -> (row_key, linked): the weak parts with a part of every complementary kind within the scope.

    An access id needs a secret and a secret needs an access id; an endpoint needs both. The interval join is an equi-join on
    zones as wide as the scope: all of a part's own zone is within reach, the zone before counts by its last start and the
    zone after by its first, so a zone is one row per role however many parts it holds."""
    parts = found.where(F.size("weak") > 0).select("row_key", F.explode(F.concat("base", "weak")).alias("x")).select("row_key", "x.start", "x.end", "x.kind", _role(F.col("x.kind")).alias("role"), F.floor(F.col("x.start") / scope).alias("zone"))
    zones = parts.groupBy("row_key", "role", "zone").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    reach = zones.select("row_key", "role", F.explode(F.array([F.struct((F.col("zone") + d).alias("zone"), F.when(F.lit(d) >= 0, F.col("high")).alias("before"), F.when(F.lit(d) <= 0, F.col("low")).alias("after")) for d in (-1, 0, 1)])).alias("z"))
    near = reach.groupBy("row_key", F.col("z.zone").alias("zone")).agg(*[f(F.when(F.col("role") == r, F.col(f"z.{c}"))).alias(f"{r}_{c}") for r in ("id", "secret", "endpoint") for c, f in (("before", F.max), ("after", F.min))])
    weak = parts.where(F.col("kind").isin("weak_access", "weak_secret", "endpoint"))

    def within(role: str) -> Column:
        close = (F.abs(F.col(f"{role}_before") - F.col("start")) <= scope) | (F.abs(F.col(f"{role}_after") - F.col("start")) <= scope)
        return F.coalesce(close, F.lit(False))

    complete = F.when(F.col("role") == "id", within("secret")).when(F.col("role") == "secret", within("id")).otherwise(within("id") & within("secret"))
    return weak.join(near, ["row_key", "zone"]).where(complete).groupBy("row_key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with `_qw_base` and `_qw_spans`, every row once and all columns kept.

    Only rows with weak parts, a few, go through the link join; they are known by a hash of id and spans, so equal rows
    share one link result."""
    found = with_spans(docs, text_col)
    weak = found.where(F.size("_qw_weak") > 0).withColumn("_qw_key", F.sha2(F.to_json(F.struct(F.col(id_col).cast("string").alias("id"), "_qw_base", "_qw_weak")), 256))
    new = F.filter("_qw_weak", lambda w: ~F.exists("_qw_base", lambda b: (b["start"] <= w["start"]) & (w["end"] <= b["end"])))
    # what stands inside an identifier is no secret beside it
    ids = F.filter(F.concat("_qw_base", "_qw_weak"), lambda x: x["kind"].isin("access", "weak_access"))
    apart = F.filter("_qw_base", lambda b: (b["kind"] == "access") | ~F.exists(ids, lambda x: (x["start"] <= b["start"]) & (b["end"] <= x["end"])))
    parts = weak.select(F.col("_qw_key").alias("row_key"), apart.alias("base"), new.alias("weak")).dropDuplicates(["row_key"])
    linked = link_parts(parts, scope).select(F.col("row_key").alias("_qw_key"), F.col("linked").alias("_qw_linked"))
    all_spans = _ordered(F.concat("_qw_base", F.coalesce("_qw_linked", F.array().cast(_NONE))))
    joined = weak.join(linked, "_qw_key", "left").select(*docs.columns, "_qw_base", all_spans.alias("_qw_spans"))
    plain = found.where(F.size("_qw_weak") == 0).select(*docs.columns, "_qw_base", F.col("_qw_base").alias("_qw_spans"))
    return plain.unionByName(joined)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans) per input row: arrays of (start, end, kind) in code points, end exclusive, by start and then kind.

    base holds the assign, access and hex matches; spans adds the weak parts that complementary parts stand beside. Null and
    empty texts have none; repeated rows are scanned each for itself; an empty table gives no rows; other columns are ignored.
    Candidates are bounded by the text's own length."""
    return annotate(id_and_text(docs, id_col, text_col), scope=scope).select("doc_id", F.col("_qw_base").alias("base"), F.col("_qw_spans").alias("spans"))


def _overwritten(text: Column, spans: Column) -> Column:
    """The text with its spans, sorted by start, as asterisks. Each span cuts from the text's start, so texts are short here."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stars = F.repeat(F.lit("*"), F.greatest(F.lit(0), x["end"] - F.greatest(acc["at"], x["start"])))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"])), stars).alias("out"))

    folded = F.aggregate(spans, first, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text))))


def _mask_long(found: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """Long texts in blocks: a block is overwritten with what of the spans lies in it, and the blocks are joined again."""
    rows = stage(found.withColumn("_qw_row", F.monotonically_increasing_id()), "long-texts")
    blocks = rows.select("_qw_row", F.posexplode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("_qw_k", "_qw_block"))
    spans = rows.select("_qw_row", F.inline("_qw_spans"))
    cut = spans.select("_qw_row", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BLOCK).cast("int"), F.floor((F.col("end") - 1) / BLOCK).cast("int"))).alias("_qw_k"))
    inside = lambda c: F.least(F.lit(BLOCK), F.greatest(F.lit(0), F.col(c) - F.col("_qw_k") * BLOCK)).cast("int").alias(c)
    of = cut.select("_qw_row", "_qw_k", F.struct(inside("start"), inside("end")).alias("x")).groupBy("_qw_row", "_qw_k").agg(F.sort_array(F.collect_set("x")).alias("_qw_in"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    done = blocks.join(of, ["_qw_row", "_qw_k"], "left").select("_qw_row", F.struct("_qw_k", _overwritten(F.col("_qw_block"), F.coalesce("_qw_in", none)).alias("t")).alias("b"))
    texts = done.groupBy("_qw_row").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["t"]), "").alias("_qw_text"))
    return rows.join(texts, "_qw_row").withColumn(text_col, F.col("_qw_text")).select(*columns)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with every span of its text overwritten by asterisks of the same length; all columns and rows stay, null text stays null.
    Texts of LONG code points or more are overwritten block by block, so that the work grows with a text's length."""
    far = F.coalesce(F.length(F.col(text_col).cast("string")) >= LONG, F.lit(False))
    short = annotate(docs.where(~far), id_col, text_col, scope)
    plain = short.withColumn(text_col, _overwritten(F.col(text_col), F.col("_qw_spans"))).select(*docs.columns)
    return plain.unionByName(_mask_long(annotate(docs.where(far), id_col, text_col, scope), text_col, docs.columns))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(table(spark, sf_dir, "documents")))
