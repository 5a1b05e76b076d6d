"""Claim ledger: reconciliation, majorities, address forms, current views, histories, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import role, sql_role


def claim_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("relation", "valid", "reject_reason").agg(F.count("*").alias("n"))


def reconcile(claims: DataFrame, doubtful: DataFrame | None = None, alias: str = "alias", cap: float = 0.6) -> DataFrame:
    """Claims to edges: distinct chapters, earliest evidence, confidence 1 from two chapters on, else 0.8 told by the narrator, else 0.5.
    Aliases of doubtful(book, subject) names, of a kind that does not merge or written small too often, have `cap` at most."""
    out = claims.where("valid").groupBy("book", "subject", "relation", "object").agg(F.countDistinct("chapter").alias("chapters"), F.max((F.col("voice") == "narrator").cast("int")).alias("_n"), F.min(F.struct("chapter", "evidence")).alias("x"))
    sure = F.when(F.col("chapters") >= 2, 1.0).when(F.col("_n") == 1, 0.8).otherwise(0.5)
    if doubtful is not None:
        out = out.join(doubtful.select("book", "subject", F.lit(True).alias("_doubt")).distinct(), ["book", "subject"], "left")
        sure = F.when((F.col("relation") == alias) & F.col("_doubt").isNotNull(), F.least(sure, F.lit(cap))).otherwise(sure)
    return out.select("book", "subject", "relation", "object", "chapters", F.col("x.chapter").alias("first"), F.col("x.evidence").alias("evidence"), sure.alias("confidence"))


def majority_kind(claims: DataFrame, at_least: int = 2, share: float = 0.7) -> DataFrame:
    """The kind most chapters give an entity, where it has two and the share; ties go to the smaller name."""
    per = claims.groupBy("book", "object", "kind").agg(F.countDistinct("chapter").alias("n"))
    of = Window.partitionBy("book", "object")
    best = per.withColumn("all", F.sum("n").over(of)).withColumn("_r", F.row_number().over(of.orderBy(F.desc("n"), "kind"))).where("_r = 1")
    return best.where((F.col("n") >= at_least) & (F.col("n") >= share * F.col("all"))).select("book", "object", "kind", "n", "all")


def address_table(claims: DataFrame, last: int = 15, at_least: int = 3, share: float = 0.8, decided: DataFrame | None = None) -> DataFrame:
    """Form of address per pair: the mode of the last forms, whatever forms there are (ties by name), stable from three on with four
    fifths. What a person has decided(book, subject, object, form) overrides the count and is stable."""
    newest = Window.partitionBy("book", "subject", "object").orderBy(F.desc("chapter"), F.desc("id"))
    recent = claims.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last)
    per = recent.groupBy("book", "subject", "object", "form").agg(F.count("*").alias("k"))
    out = per.groupBy("book", "subject", "object").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "form")).alias("top"))
    found = out.select("book", "subject", "object", "n", F.col("top.form").alias("form"), ((F.col("n") >= at_least) & (-F.col("top.k") >= share * F.col("n"))).alias("stable"))
    if decided is None:
        return found
    own = decided.select("book", "subject", "object", F.col("form").alias("_own"))
    return found.join(own, ["book", "subject", "object"], "full_outer").select("book", "subject", "object", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_own", "form").alias("form"), (F.col("_own").isNotNull() | F.col("stable")).alias("stable"))


def address_deviations(claims: DataFrame, as_of: int) -> DataFrame:
    """Later claims against the table as it stood at a chapter: only stable forms count."""
    table_ = address_table(claims.where(F.col("chapter") <= as_of)).where("stable").select("book", "subject", "object", F.col("form").alias("expected"))
    later = claims.where(F.col("chapter") > as_of)
    return later.join(table_, ["book", "subject", "object"]).groupBy("book").agg(F.count("*").alias("checked"), F.count(F.when(F.col("form") != F.col("expected"), 1)).alias("deviations"))


def entity_chapters(claims: DataFrame) -> DataFrame:
    """Per entity, by id or by lower-case name where it has none: most recent name, chapters, first chapter."""
    key = F.when(F.col("subject_id").isNull(), F.lower("subject")).alias("by_name")
    return claims.groupBy("book", "subject_id", key).agg(F.max_by("subject", F.struct("chapter", "id")).alias("name"), F.countDistinct("chapter").alias("chapters"), F.min("chapter").alias("first"))


def current_view(records: DataFrame, as_of: int) -> DataFrame:
    """A person's record beats the system's, a later one an earlier; deleted rows then hide the key."""
    by = Window.partitionBy("book", "key").orderBy(F.when(F.col("origin") == "manual", 0).otherwise(1), F.desc("first_chapter"), F.desc("id"))
    return records.where(F.col("first_chapter") <= as_of).withColumn("_r", F.row_number().over(by)).where("_r = 1 and not deleted").select("book", "key", "value", "origin", "first_chapter")


def monotone_ranks(ranks: DataFrame) -> DataFrame:
    """A rank goes if any later one is lower. The window runs from the last row on: one that grows towards the end is worked out anew
    for every row."""
    after = Window.partitionBy("book", "node").orderBy(F.desc("chapter"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    return ranks.withColumn("_low", F.min("step").over(after)).where(F.col("_low").isNull() | (F.col("_low") >= F.col("step"))).select("book", "node", "chapter", "id", "step")


def first_mentions(claims: DataFrame) -> DataFrame:
    """Where each entity first stands."""
    return claims.groupBy("book", "object").agg(F.min(F.struct("chapter", "id", "evidence")).alias("x")).select("book", "object", "x.chapter", "x.evidence")


def sampled_mentions(claims: DataFrame) -> DataFrame:
    """First, middle and last mention of each entity."""
    by = Window.partitionBy("book", "object").orderBy("chapter", "id")
    ranked = claims.withColumn("_r", F.row_number().over(by)).withColumn("_n", F.count("*").over(Window.partitionBy("book", "object")))
    place = F.when(F.col("_r") == 1, "first").when(F.col("_r") == F.col("_n"), "last").when(F.col("_r") == F.ceil(F.col("_n") / 2), "middle")
    return ranked.withColumn("place", place).where("place is not null").select("book", "object", "place", "chapter", "id")


def violations_by_model(findings: DataFrame) -> DataFrame:
    """Chapters, findings and findings per chapter of each model, worst first."""
    out = findings.groupBy("model").agg(F.countDistinct("chapter").alias("chapters"), F.sum("findings").cast("long").alias("findings"))
    return out.withColumn("rate", F.round(F.col("findings") / F.col("chapters"), 6)).orderBy(F.desc("rate"), "model")


def top_terms(claims: DataFrame, k: int = 3) -> DataFrame:
    """The k most used objects of each book; equal counts by first appearance."""
    per = claims.groupBy("book", "object").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "first_id"))).where(F.col("rank") <= k).select("book", "object", "n", F.col("rank").cast("long").alias("rank"))


def alternatives(claims: DataFrame, at_least: int = 3, share: float = 0.25) -> DataFrame:
    """Entities with a second kind strong enough to need a look: at least three chapters and a quarter of all."""
    per = claims.groupBy("book", "object", "kind").agg(F.countDistinct("chapter").alias("n"))
    of = Window.partitionBy("book", "object")
    ranked = per.withColumn("all", F.sum("n").over(of)).withColumn("_r", F.row_number().over(of.orderBy(F.desc("n"), "kind")))
    return ranked.where((F.col("_r") == 2) & (F.col("n") >= at_least) & (F.col("n") >= share * F.col("all"))).select("book", "object", "kind", "n", "all")


def _named(s, d):
    return role(s, d, "claims").withColumn("subject_id", F.when(F.col("id") % 3 > 0, F.col("subject")))


def _records(s, d):
    return role(s, d, "claims").select("id", "book", F.concat_ws("/", "subject", "relation").alias("key"), F.col("object").alias("value"), F.when(F.col("voice") == "narrator", "manual").otherwise("system").alias("origin"), F.col("chapter").alias("first_chapter"), (F.col("id") % 9 == 0).alias("deleted"))


def _ranks(s, d):
    return role(s, d, "claims").select("book", F.concat(F.col("subject"), F.col("object")).alias("node"), "chapter", "id", (F.col("id") % 7).alias("step"))


def _forms(s, d):
    """Three forms of address."""
    return role(s, d, "claims").withColumn("form", F.when(F.col("id") % 7 < 3, "efendim").otherwise(F.col("form")))


QUERIES = {
    "claim_counts": lambda s, d: claim_counts(role(s, d, "claims")),
    "claim_reconcile": lambda s, d: reconcile(role(s, d, "claims")),
    "alias_reconcile": lambda s, d: reconcile(role(s, d, "claims"), role(s, d, "claims").where("kind = 'kind1'"), "rel_A"),
    "address_decided": lambda s, d: address_table(_forms(s, d), decided=role(s, d, "claims").where("id % 50 = 0").groupBy("book", "subject", "object").agg(F.lit("hocam").alias("form"))),
    "type_majority": lambda s, d: majority_kind(role(s, d, "claims").withColumn("kind", F.when(F.col("id") % 10 < 8, F.lit("kind0")).otherwise(F.col("kind")))),
    "address_table": lambda s, d: address_table(role(s, d, "claims")),
    "address_deviation": lambda s, d: address_deviations(role(s, d, "claims").withColumn("form", F.when(F.col("id") % 10 > 0, F.lit("sen")).otherwise(F.col("form"))), 30),
    "entity_chapters": lambda s, d: entity_chapters(_named(s, d)),
    "ledger_current_view": lambda s, d: current_view(_records(s, d), 40),
    "rank_monotone": lambda s, d: monotone_ranks(_ranks(s, d)),
    "first_mentions": lambda s, d: first_mentions(role(s, d, "claims")),
    "sampled_mentions": lambda s, d: sampled_mentions(role(s, d, "claims")),
    "violations_by_model": lambda s, d: violations_by_model(role(s, d, "claims").select(F.col("kind").alias("model"), "chapter", (~F.col("valid")).cast("long").alias("findings"))),
    "top_terms": lambda s, d: top_terms(role(s, d, "claims")),
    "alternative_kinds": lambda s, d: alternatives(role(s, d, "claims").withColumn("kind", F.concat(F.lit("k"), F.col("id") % 3))),
}
_C = sql_role("claims")
_FORMED = f"(SELECT * REPLACE (CASE WHEN id % 10 > 0 THEN 'sen' ELSE form END AS form) FROM {_C} x)"
_TABLE = lambda src: f"(SELECT book, subject, object, n, CASE WHEN sen * 2 >= n THEN 'sen' ELSE 'siz' END AS form, n >= 3 AND greatest(sen, n - sen) >= 0.8 * n AS stable FROM (SELECT book, subject, object, count(*) AS n, count(CASE WHEN form = 'sen' THEN 1 END) AS sen FROM (SELECT *, row_number() OVER (PARTITION BY book, subject, object ORDER BY chapter DESC, id DESC) AS r FROM {src}) a WHERE r <= 15 GROUP BY ALL) b)"
_KINDS = lambda kind: f"(SELECT *, CAST(sum(n) OVER (PARTITION BY book, object) AS BIGINT) AS \"all\", row_number() OVER (PARTITION BY book, object ORDER BY n DESC, kind) AS r FROM (SELECT book, object, {kind} AS kind, count(DISTINCT chapter) AS n FROM {_C} x GROUP BY 1, 2, 3) a)"
_ANY_TABLE = lambda src: f"(SELECT book, subject, object, CAST(sum(k) AS BIGINT) AS n, arg_min(form, (-k, form)) AS form, sum(k) >= 3 AND max(k) >= 0.8 * sum(k) AS stable FROM (SELECT book, subject, object, form, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY book, subject, object ORDER BY chapter DESC, id DESC) AS r FROM {src}) a WHERE r <= 15 GROUP BY ALL) b GROUP BY book, subject, object)"
ORACLE = {
    "alias_reconcile": f"SELECT r.*, CASE WHEN relation = 'rel_A' AND (book, subject) IN (SELECT (book, subject) FROM {_C} k WHERE kind = 'kind1') THEN least(c, 0.6::DOUBLE) ELSE c END AS confidence FROM (SELECT book, subject, relation, object, count(DISTINCT chapter) AS chapters, min(chapter) AS first, (min((chapter, evidence)))[2] AS evidence FROM {_C} x WHERE valid GROUP BY book, subject, relation, object) r JOIN (SELECT book AS b_, subject AS s_, relation AS r_, object AS o_, CASE WHEN count(DISTINCT chapter) >= 2 THEN 1.0 WHEN bool_or(voice = 'narrator') THEN 0.8 ELSE 0.5 END::DOUBLE AS c FROM {_C} y WHERE valid GROUP BY ALL) q ON book = b_ AND subject = s_ AND relation = r_ AND object = o_".replace("SELECT r.*,", "SELECT r.*,"),
    "address_decided": f"SELECT t.book, t.subject, t.object, n, CASE WHEN m.book IS NOT NULL THEN 'hocam' ELSE form END AS form, stable OR m.book IS NOT NULL AS stable FROM {_ANY_TABLE(f"(SELECT * REPLACE (CASE WHEN id % 7 < 3 THEN 'efendim' ELSE form END AS form) FROM {_C} y) z")} t LEFT JOIN (SELECT DISTINCT book, subject, object FROM {_C} w WHERE id % 50 = 0) m ON m.book = t.book AND m.subject = t.subject AND m.object = t.object",
    "claim_counts": f"SELECT relation, valid, reject_reason, count(*) AS n FROM {_C} x GROUP BY ALL",
    "claim_reconcile": f"SELECT book, subject, relation, object, count(DISTINCT chapter) AS chapters, min(chapter) AS first, (min((chapter, evidence)))[2] AS evidence, CASE WHEN count(DISTINCT chapter) >= 2 THEN 1.0 WHEN bool_or(voice = 'narrator') THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM {_C} x WHERE valid GROUP BY book, subject, relation, object",
    "type_majority": f"SELECT book, object, kind, n, \"all\" FROM {_KINDS("CASE WHEN id % 10 < 8 THEN 'kind0' ELSE kind END")} q WHERE r = 1 AND n >= 2 AND n >= 0.7::DOUBLE * \"all\"",
    "address_table": f"SELECT * FROM {_TABLE(_C + ' y')} t",
    "address_deviation": f"SELECT c.book, count(*) AS checked, count(CASE WHEN c.form <> t.form THEN 1 END) AS deviations FROM {_FORMED} c JOIN {_TABLE('(SELECT * FROM ' + _FORMED + ' z WHERE chapter <= 30) y')} t ON c.book = t.book AND c.subject = t.subject AND c.object = t.object WHERE chapter > 30 AND stable GROUP BY c.book",
    "entity_chapters": f"SELECT book, subject_id, by_name, arg_max(subject, (chapter, id)) AS name, count(DISTINCT chapter) AS chapters, min(chapter) AS first FROM (SELECT *, CASE WHEN id % 3 > 0 THEN subject END AS subject_id, CASE WHEN id % 3 > 0 THEN NULL ELSE lower(subject) END AS by_name FROM {_C} x) y GROUP BY book, subject_id, by_name",
    "ledger_current_view": f"SELECT book, key, value, origin, first_chapter FROM (SELECT *, row_number() OVER (PARTITION BY book, key ORDER BY CASE origin WHEN 'manual' THEN 0 ELSE 1 END, first_chapter DESC, id DESC) AS r FROM (SELECT id, book, concat_ws('/', subject, relation) AS key, object AS value, CASE voice WHEN 'narrator' THEN 'manual' ELSE 'system' END AS origin, chapter AS first_chapter, id % 9 = 0 AS deleted FROM {_C} x WHERE chapter <= 40) a) b WHERE r = 1 AND NOT deleted",
    "rank_monotone": f"SELECT book, node, chapter, id, step FROM (SELECT *, min(step) OVER (PARTITION BY book, node ORDER BY chapter, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM (SELECT book, subject || object AS node, chapter, id, id % 7 AS step FROM {_C} x) a) b WHERE low IS NULL OR low >= step",
    "first_mentions": f"SELECT book, object, min(chapter) AS chapter, (min((chapter, id, evidence)))[3] AS evidence FROM {_C} x GROUP BY book, object",
    "sampled_mentions": f"SELECT book, object, place, chapter, id FROM (SELECT *, CASE WHEN r = 1 THEN 'first' WHEN r = n THEN 'last' WHEN r = ceil(n / 2) THEN 'middle' END AS place FROM (SELECT *, row_number() OVER (PARTITION BY book, object ORDER BY chapter, id) AS r, count(*) OVER (PARTITION BY book, object) AS n FROM {_C} x) a) b WHERE place IS NOT NULL",
    "violations_by_model": f"SELECT *, round(findings / chapters, 6) AS rate FROM (SELECT kind AS model, count(DISTINCT chapter) AS chapters, count(CASE WHEN NOT valid THEN 1 END) AS findings FROM {_C} x GROUP BY 1) a",
    "top_terms": f"SELECT book, object, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, first_id) AS rank FROM (SELECT book, object, count(*) AS n, min(id) AS first_id FROM {_C} x GROUP BY ALL) a) b WHERE rank <= 3",
    "alternative_kinds": f"SELECT book, object, kind, n, \"all\" FROM {_KINDS("concat('k', id % 3)")} q WHERE r = 2 AND n >= 3 AND n >= 0.25::DOUBLE * \"all\"",
}
