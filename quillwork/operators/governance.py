"""Node resolution, merges of duplicate nodes, cascading deletes, histories, and validation of proposed changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import role, sql_role

# The sections of a proposal and the fields each needs.
SECTIONS = {"new_edges": ("subject", "relation", "object", "evidence"), "new_aliases": ("subject", "alias", "kind", "evidence"), "reviews": ("category", "note")}
IMPORTANCE = ("critical", "high", "medium", "low")


def resolve(names: DataFrame, nodes: DataFrame, spellings: DataFrame) -> DataFrame:
    """names(book, name) to nodes by the folded record name, else by an approved spelling, else by the name without marks; within a
    step the smaller node id wins. Names that nothing knows have a null node."""
    keys = nodes.select("book", T.fold_term(F.col("name")).alias("key"), "node", F.lit(0).alias("p")).unionByName(spellings.select("book", T.fold_term(F.col("spelling")).alias("key"), "node", F.lit(1).alias("p"))).unionByName(nodes.select("book", T.plain_letters(F.regexp_replace("name", r"[^\p{L}\p{N}]+", "")).alias("key"), "node", F.lit(2).alias("p")))
    first = keys.groupBy("book", "key").agg(F.min(F.struct("p", "node")).alias("x")).select("book", "key", F.col("x.node").alias("node"), F.col("x.p").alias("step"))
    return names.withColumn("key", T.fold_term(F.col("name"))).join(first, ["book", "key"], "left").select("book", "name", "node", "step")


def repoint(edges: DataFrame, same: DataFrame) -> DataFrame:
    """Edges of duplicate nodes moved to the canonical one; edges that then coincide are one, with the earliest learning; an edge of
    a node to itself goes."""
    m = same.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(m, F.col(end) == F.col("_a"), "left").withColumn(end, F.coalesce("_c", end)).drop("_a", "_c")
    return out.where("src <> dst").groupBy("book", "src", "relation", "dst").agg(F.min("learned_at").alias("learned_at"), F.count("*").alias("merged"))


def cascade(children: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of a child table when its parents go."""
    return children.join(deleted.select(*keys).distinct(), keys, "left_anti")


def history(writes: DataFrame, cap: int = 100) -> DataFrame:
    """Versions of a record: the number rises only when the target changes; newest first, at most `cap` a record."""
    by = Window.partitionBy("book", "source").orderBy("at", "seq")
    changed = F.coalesce((~F.col("target").eqNullSafe(F.lag("target").over(by))).cast("int"), F.lit(1))
    numbered = writes.withColumn("_c", F.when(F.row_number().over(by) == 1, 1).otherwise(changed)).withColumn("version", F.sum("_c").over(by))
    newest = Window.partitionBy("book", "source").orderBy(F.desc("at"), F.desc("seq"))
    return numbered.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= cap).select("book", "source", "target", "at", "seq", "version")


def fill_only(mine: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """New values go only where nothing stands."""
    t = theirs.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return mine.join(t, keys, "left").select(*keys, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def replaced(stored: DataFrame, fresh: DataFrame, origin: str = "system") -> DataFrame:
    """Full recompute of one origin's rows: those stored go, the new ones come, other origins stay."""
    return stored.where(F.col("origin") != origin).unionByName(fresh.where(F.col("origin") == origin))


def _blank(field: str):
    return lambda x: F.coalesce(F.trim(x[field]), F.lit("")) == ""


def proposal_errors(proposals: DataFrame) -> DataFrame:
    """proposals(id, body json) -> (id, errors array<string>): unknown sections, sections that are no lists, missing or blank fields,
    and importances off the list. A body that is no object has one error. Nothing is mended silently."""
    sections = F.json_object_keys("body")
    unknown = F.transform(F.array_except(F.coalesce(sections, F.array().cast("array<string>")), F.array(*map(F.lit, SECTIONS))), lambda s: F.concat(F.lit("unknown section "), s))
    items = {s: F.from_json(F.get_json_object("body", f"$.{s}"), "array<map<string,string>>") for s in SECTIONS}
    errors: list[Column] = [unknown]
    for s, fields in SECTIONS.items():
        raw = F.get_json_object("body", f"$.{s}")
        errors.append(F.when(raw.isNotNull() & ~F.trim(raw).startswith("["), F.array(F.lit(f"{s} is no list"))))
        for f in fields:
            missing = F.size(F.filter(items[s], _blank(f)))
            errors.append(F.when(missing > 0, F.array(F.concat(F.lit(f"{s}.{f} missing in "), missing))))
    off = F.size(F.filter(items["reviews"], lambda x: x["importance"].isNotNull() & ~x["importance"].isin(*IMPORTANCE)))
    errors.append(F.when(off > 0, F.array(F.concat(F.lit("reviews.importance unknown in "), off))))
    none = F.array().cast("array<string>")
    return proposals.select("id", F.when(sections.isNull(), F.array(F.lit("no object"))).otherwise(reduce(F.concat, [F.coalesce(e, none) for e in errors])).alias("errors"))


def _nodes(s, d):
    return role(s, d, "terms").select("book", F.col("source").alias("name"), F.concat("book", F.lit("#"), F.col("source")).alias("node"))


def _writes(s, d):
    return role(s, d, "node_values").select("book", F.col("node").alias("source"), F.col("value").alias("target"), F.col("learned_at").alias("at"), "seq")


QUERIES = {
    "node_resolver": lambda s, d: resolve(role(s, d, "terms").select("book", F.upper("source").alias("name")), _nodes(s, d), _nodes(s, d).where("length(name) % 2 = 0").select("book", F.substring("name", 1, 6).alias("spelling"), "node")),
    "alias_repoint": lambda s, d: repoint(role(s, d, "edges"), s.range(0, 40, 4).select(F.concat(F.lit("c"), F.col("id") + 1).alias("alias"), F.concat(F.lit("c"), "id").alias("canonical"))),
    "delete_cascade": lambda s, d: cascade(role(s, d, "edges").select("book", F.col("src").alias("node"), "relation", "dst"), role(s, d, "node_values").where("seq % 50 = 0"), ["book", "node"]).groupBy("book", "relation").count(),
    "term_history": lambda s, d: history(_writes(s, d), 5),
    "recompute_origin": lambda s, d: replaced(role(s, d, "edges").select("book", "src", "dst", "origin"), role(s, d, "edges").where("learned_at > 30").select("book", "src", "dst", "origin")).groupBy("book", "origin").count(),
}
_T, _E, _V = sql_role("terms"), sql_role("edges"), sql_role("node_values")
_F = lambda x: f"lower(regexp_replace(trim({x}), '[\\s\\-_''’.·]+', '', 'g'))"
_MOVED = lambda x: f"CASE WHEN CAST(substring({x}, 2) AS INT) % 4 = 1 AND CAST(substring({x}, 2) AS INT) < 40 THEN concat('c', CAST(substring({x}, 2) AS INT) - 1) ELSE {x} END"
ORACLE = {
    "node_resolver": f"WITH t AS (SELECT * FROM {_T} a), n AS (SELECT book, source AS name, concat(book, '#', source) AS node FROM t), k AS (SELECT book, {_F('name')} AS key, node, 0 AS p FROM n UNION ALL SELECT book, {_F('substring(name, 1, 6)')}, node, 1 FROM n WHERE length(name) % 2 = 0 UNION ALL SELECT book, translate(lower(translate(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'Iİ', 'ıi')), 'ığüşöçâîû', 'igusocaiu'), node, 2 FROM n), f AS (SELECT book, key, (min((p, node)))[2] AS node, min(p) AS step FROM k GROUP BY book, key) SELECT t.book, upper(t.source) AS name, f.node, f.step FROM t LEFT JOIN f ON t.book = f.book AND {_F('upper(t.source)')} = f.key".replace("{{", "{").replace("}}", "}"),
    "alias_repoint": f"SELECT book, {_MOVED('src')} AS src, relation, dst, min(learned_at) AS learned_at, count(*) AS merged FROM {_E} e GROUP BY 1, 2, 3, 4",
    "delete_cascade": f"SELECT book, relation, count(*) AS count FROM {_E} e WHERE NOT EXISTS (SELECT 1 FROM {_V} v WHERE v.seq % 50 = 0 AND v.book = e.book AND v.node = e.src) GROUP BY ALL",
    "term_history": f"SELECT book, source, target, at, seq, version FROM (SELECT *, row_number() OVER (PARTITION BY book, source ORDER BY at DESC, seq DESC) AS r FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY book, source ORDER BY at, seq) AS BIGINT) AS version FROM (SELECT book, node AS source, value AS target, learned_at AS \"at\", seq, CASE WHEN row_number() OVER w = 1 OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS c FROM {_V} v WINDOW w AS (PARTITION BY book, node ORDER BY learned_at, seq)) a) b) c WHERE r <= 5".replace("target, at, seq", 'target, "at", seq').replace("ORDER BY at", 'ORDER BY "at"'),
    "recompute_origin": f"SELECT book, origin, count(*) AS count FROM (SELECT book, origin FROM {_E} e WHERE origin <> 'system' UNION ALL SELECT book, origin FROM {_E} f WHERE origin = 'system' AND learned_at > 30) q GROUP BY ALL",
}
