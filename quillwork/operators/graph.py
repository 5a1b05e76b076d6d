"""Entity graph with three time axes: merges, closings, refutations, as-of reads, gaps, deltas, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components, reliable
from ..sources.tables import duck, role, shared, sql_role, table

KEY = ["book", "src", "relation", "dst"]
#: Entities of a place from which on it is looked at for making no pairs.
HEAVY_PLACE = 500
ORIGINS = {"manual": 2, "system": 1, "model": 0}


def _rank(column: str = "origin"):
    return F.when(F.col(column) == "manual", 2).when(F.col(column) == "system", 1).otherwise(0)


def merge_edges(edges: DataFrame, symmetric: tuple[str, ...] = ()) -> DataFrame:
    """One edge per key: the earliest learning with its evidence (ties by the smaller text), the strongest origin, the greatest
    confidence; rejected only if no approved row is as strong. The rules commute, so input order never matters."""
    turn = F.col("relation").isin(*symmetric) & (F.col("src") > F.col("dst")) if symmetric else F.lit(False)
    e = edges.withColumn("_s", F.when(turn, F.col("dst")).otherwise(F.col("src"))).withColumn("dst", F.when(turn, F.col("src")).otherwise(F.col("dst"))).withColumn("src", F.col("_s"))
    at = F.struct(F.col("learned_at").isNull().alias("none"), "learned_at", "evidence")
    out = e.groupBy(*KEY).agg(F.min(at).alias("x"), F.max(_rank()).alias("_o"), F.max("confidence").alias("confidence"), F.max(F.struct(_rank().alias("o"), (F.col("status") == "approved").alias("a"))).alias("y"), F.count("*").alias("seen"))
    origin = F.when(F.col("_o") == 2, "manual").when(F.col("_o") == 1, "system").otherwise("model")
    return out.select(*KEY, "x.learned_at", "x.evidence", origin.alias("origin"), "confidence", F.when(F.col("y.a"), "approved").otherwise("rejected").alias("status"), "seen")


def two_ended(edges: DataFrame, nodes: DataFrame, as_of: int) -> DataFrame:
    """Edges a reader at a chapter may see (an unknown learning time hides an edge) with the names of both ends."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("name").alias("src_name")), nodes.select(F.col("node").alias("dst"), F.col("name").alias("dst_name"))
    return edges.where((F.col("learned_at") <= as_of) & (F.col("status") == "approved")).join(a, "src").join(b, "dst").groupBy("book", "relation", "src_name", "dst_name").agg(F.min("learned_at").alias("learned_at"))


def closings(edges: DataFrame) -> DataFrame:
    """A relation with one object at a time: an approved later edge closes the one before it, known from the later's chapter on. An object
    that comes back (A, B, A) counts from its first time, with the end that followed it; its return is not an edge of its own."""
    e = edges.where("status = 'approved' and learned_at is not null").groupBy("book", "src", "relation", "dst").agg(F.min("learned_at").alias("since"))
    by = Window.partitionBy("book", "src", "relation").orderBy("since", "dst")
    return e.withColumn("until", F.lead("since").over(by)).withColumn("by", F.lead("dst").over(by))


def edge_state(closed: DataFrame, as_of: int) -> DataFrame:
    """States at a chapter, by book: disproven where it was refuted by then (`refuted_at`, if the edges have it), active, ended, and
    ends the reader may not know yet."""
    refuted_by = F.coalesce(F.col("refuted_at") <= as_of, F.lit(False)) if "refuted_at" in closed.columns else F.lit(False)
    s = F.when(refuted_by, "disproven").when(F.col("until").isNull(), "active").when(F.col("until") > as_of, "active_end_hidden").otherwise("ended")
    return closed.where(F.col("since") <= as_of).groupBy("book", s.alias("state")).agg(F.count("*").alias("n"))


def support(edges: DataFrame) -> DataFrame:
    """Chapters that speak for each edge, whichever way round."""
    return edges.where("learned_at is not null").groupBy("book", F.least("src", "dst").alias("a"), "relation", F.greatest("src", "dst").alias("b")).agg(F.countDistinct("learned_at").alias("chapters"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("book", F.explode(F.array("src", "dst")).alias("node"), "relation", "learned_at")
    return ends.groupBy("book", "node").agg(F.count("*").alias("edges"), F.countDistinct("relation").alias("relations"), F.min("learned_at").alias("first"))


def changes(values: DataFrame) -> DataFrame:
    """Change-only storage: a value stays if it differs from the one before it."""
    by = Window.partitionBy("book", "node", "key").orderBy("learned_at", "seq")
    return values.withColumn("_p", F.lag("value").over(by)).withColumn("_n", F.row_number().over(by)).where((F.col("_n") == 1) | ~F.col("value").eqNullSafe(F.col("_p"))).select("book", "node", "key", "value", "learned_at", "seq")


def values_at(values: DataFrame, as_of: int) -> DataFrame:
    """The latest value per node and key no later than the chapter."""
    return values.where(F.col("learned_at") <= as_of).groupBy("book", "node", "key").agg(F.max(F.struct("learned_at", "seq", "value")).alias("x")).select("book", "node", "key", "x.value", "x.learned_at")


def refuted(values: DataFrame) -> DataFrame:
    """A confirmed value refutes earlier unlike ones: the chapter of the first confirmation after each that says otherwise.

    Whatever the values, that is the next confirmation ahead if it differs, else the one that ends its run of equal
    confirmations; both are carried along the rows from the last to the first, without a pair join. Null says nothing."""
    ahead = Window.partitionBy("book", "node", "key").orderBy(F.desc("learned_at"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    says = F.col("confirmed") & F.col("value").isNotNull()
    following = lambda when, *what: F.last(F.when(when, F.struct(*what)), ignorenulls=True).over(ahead)
    v = values.select("book", "node", "key", "value", "learned_at", "seq", "confirmed").withColumn("_n", following(says, "value", "learned_at"))
    v = v.withColumn("_ends", F.coalesce(says & (F.col("_n.value") != F.col("value")), F.lit(False)))
    v = v.withColumn("_o", F.when(F.col("_ends"), F.col("_n.learned_at")).otherwise(following(F.col("_ends"), F.col("_n.learned_at").alias("at"))["at"]))
    v = v.withColumn("_x", following(says, "value", "learned_at", "_o"))
    other = F.when(F.col("_x.value") != F.col("value"), F.col("_x.learned_at")).when(F.col("_x.value") == F.col("value"), F.col("_x._o"))
    return v.withColumn("refuted_at", other).where("not confirmed and refuted_at is not null").select("book", "node", "key", "value", "learned_at", "seq", "refuted_at")


def missing_links(mentions: DataFrame, edges: DataFrame, at_least: int = 2, heavy: int = HEAVY_PLACE) -> DataFrame:
    """Entities told in the same place that no edge of any status ties: pairs with a<b, without those the graph has. Only entities of
    `at_least` places are paired, as others cannot meet so often, and a place's pairs are counted before they are shuffled.

    A place of more than `heavy` such entities makes no pairs if it is among the `at_least` - 1 largest of its book: pairs that meet often
    enough meet in another place as well. They are found there, and what they share of the large places is counted by their sets."""
    distinct = mentions.select("book", "node", "place").distinct()
    often = distinct.groupBy("book", "node").agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select("book", "node")
    told = distinct.join(often, ["book", "node"], "left_semi")
    large = told.groupBy("book", "place").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy)
    order = Window.partitionBy("book").orderBy(F.desc("_n"), "place")
    apart = reliable(large.withColumn("_r", F.row_number().over(order)).where(F.col("_r") < at_least).select("book", "place"))
    light = told.join(apart, ["book", "place"], "left_anti")
    a, b = light.alias("a"), light.alias("b")
    met = a.join(b, (F.col("a.book") == F.col("b.book")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.node") < F.col("b.node")))
    pairs = met.groupBy(F.col("a.book").alias("book"), F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count("*").alias("places"))
    if not apart.isEmpty():
        sets = told.join(apart, ["book", "place"]).groupBy("book", "node").agg(F.collect_set("place").alias("_s"))
        of = lambda c: sets.select("book", F.col("node").alias(c), F.col("_s").alias(f"_{c}"))
        both = F.coalesce(F.size(F.array_intersect("_a", "_b")), F.lit(0))
        pairs = pairs.join(of("a"), ["book", "a"], "left").join(of("b"), ["book", "b"], "left").select("book", "a", "b", (F.col("places") + F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), both).otherwise(0)).alias("places"))
    tied = edges.select("book", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.where(F.col("places") >= at_least).join(tied, ["book", "a", "b"], "left_anti")


def without_relation(nodes: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """Nodes of a kind that should have a relation and have none."""
    return nodes.join(edges.where(F.col("relation") == relation).select("book", F.col("src").alias("node")), ["book", "node"], "left_anti")


def origin_conflicts(edges: DataFrame) -> DataFrame:
    """Unordered pairs that a model ties otherwise than a person or the system does."""
    pair = edges.select("book", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation", "origin").distinct()
    firm = pair.where("origin <> 'model'").groupBy("book", "a", "b").agg(F.collect_set("relation").alias("firm"))
    return pair.where("origin = 'model'").join(firm, ["book", "a", "b"]).where(~F.array_contains("firm", F.col("relation"))).select("book", "a", "b", "relation", F.concat_ws(",", F.array_sort("firm")).alias("firm"))


def delta_classes(proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed edges against the graph: already there, supporting later, updating, conflicting by status, in need of review, or new."""
    now = merge_edges(edges).select(*KEY, F.col("status").alias("_s"), F.col("learned_at").alias("_l"), F.col("confidence").alias("_c"))
    held = F.col("_s").isNotNull()
    cls = F.when(held & (F.col("_s") == "rejected"), "CONFLICTS").when(F.col("learned_at").isNull(), "NEEDS_REVIEW").when(held & (F.col("learned_at") == F.col("_l")), "ALREADY").when(held & (F.col("learned_at") > F.col("_l")), "SUPPORTS").when(held, "UPDATES").otherwise("NEW")
    return proposals.join(now, KEY, "left").groupBy("book", cls.alias("class")).agg(F.count("*").alias("n"))


def heavy_objects(edges: DataFrame, at_least: int) -> DataFrame:
    return edges.groupBy("book", "relation", "dst").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("subjects")).where(F.col("edges") >= at_least)


def health(edges: DataFrame, every: int = 25) -> DataFrame:
    """Edges by status at every 25th chapter, cumulative."""
    step = F.ceil(F.col("learned_at") / every).cast("int") * every
    per = edges.where("learned_at is not null").groupBy("book", step.alias("chapter"), "status").agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy("book", "status").orderBy("chapter")))


def clusters(edges: DataFrame, rules: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Nodes by ordered rules, (cluster, relations that the node must all have), the first that holds; a node without a rule of its own
    takes the least cluster of those that point to it."""
    kinds = edges.groupBy("book", F.col("src").alias("node")).agg(F.collect_set("relation").alias("r"))
    holds = [F.when(F.size(F.array_except(F.array(*map(F.lit, need)), "r")) == 0, F.lit(cluster)) for cluster, need in rules]
    own = kinds.select("book", "node", F.coalesce(*holds, F.lit(None).cast("string")).alias("cluster"))
    heads = own.where("cluster is not null").select("book", F.col("node").alias("src"), F.col("cluster").alias("_c"))
    given = edges.join(heads, ["book", "src"]).groupBy("book", F.col("dst").alias("node")).agg(F.min("_c").alias("_g"))
    return given.join(own, ["book", "node"], "full_outer").select("book", "node", F.coalesce("cluster", "_g", F.lit("none")).alias("cluster"))


def graph_cut(nodes: DataFrame, edges: DataFrame, as_of: int | None) -> tuple[DataFrame, DataFrame]:
    """nodes(book, node, first_chapter, ...) and edges(book, src, dst, learned_at, ...) as a reader at a chapter may see them: edges learned by then
    between nodes that are known and not first seen later, and the nodes that have one. Without a chapter nothing is cut by chapter."""
    seen = nodes if as_of is None else nodes.where(F.col("first_chapter").isNull() | (F.col("first_chapter") <= as_of))
    told = edges if as_of is None else edges.where(F.col("learned_at") <= as_of)
    end = lambda c: seen.select("book", F.col("node").alias(c)).distinct()
    kept = told.join(end("src"), ["book", "src"], "left_semi").join(end("dst"), ["book", "dst"], "left_semi").select(*edges.columns)
    tied = kept.select("book", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return seen.join(tied, ["book", "node"], "left_semi").select(*nodes.columns), kept


def graph_lines(nodes: DataFrame, edges: DataFrame, as_of: int | None) -> DataFrame:
    """(book, kind, line): the cut graph as a JSON object per node and edge, null fields written out."""
    shown, kept = graph_cut(nodes, edges, as_of)
    line = lambda df, kind: df.select("book", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "book"]), {"ignoreNullFields": "false"}).alias("line"))
    return line(shown, "node").unionByName(line(kept, "edge"))


def cases(edges: DataFrame) -> DataFrame:
    """Connected components of a book's edges, each named by its least member, with sizes."""
    found = components(edges.select(F.concat_ws("/", "book", "src").alias("u"), F.concat_ws("/", "book", "dst").alias("v")))
    return found.groupBy("component").agg(F.count("*").alias("members"))


def _nodes(s, d):
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_name").alias("name"))
    return c.unionByName(table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name")))


def _values(s, d):
    return role(s, d, "node_values").withColumn("confirmed", F.col("seq") % 4 == 0)


def _mentions(s, d):
    return role(s, d, "claims").select("book", F.concat("chapter", F.lit(":"), F.substring("evidence", -1, 1)).alias("place"), F.col("subject").alias("node")).distinct()


def _claim_edges(s, d):
    return role(s, d, "claims").select("book", F.col("subject").alias("src"), "relation", F.col("object").alias("dst"))


def _closed(s, d):
    refuted_at = F.when(F.length("dst") == 2, F.col("since") + 20)
    return closings(role(s, d, "edges")).withColumn("refuted_at", refuted_at)


#: Nodes with both relations are core, with the one outer.
_RULES = [("core", ("rel_R", "rel_A")), ("outer", ("rel_R",))]


def _tied(s, d):
    return role(s, d, "claims").select("book", F.col("subject").alias("src"), F.concat(F.lit("s"), (F.substring("subject", 2, 3).cast("int") + 1) % 30).alias("dst"))


_ENDS = "(SELECT book, node, min(told) AS first_chapter FROM (SELECT book, src AS node, learned_at + 9 AS told FROM {edges} UNION ALL SELECT book, dst, learned_at + 4 FROM {edges} WHERE dst <> 's7') e GROUP BY book, node)"
_TIES = "(SELECT book, src, relation, dst, min(learned_at) AS learned_at FROM {edges} WHERE status = 'approved' GROUP BY book, src, relation, dst)"

QUERIES = {
    "graph_export": lambda s, d: graph_lines(shared(s, d, _ENDS), shared(s, d, _TIES), 12),
    "edge_upsert_merge": lambda s, d: merge_edges(role(s, d, "edges")),
    "edges_two_ended": lambda s, d: two_ended(role(s, d, "edges"), _nodes(s, d), 100),
    "edge_closing": lambda s, d: closings(role(s, d, "edges")),
    "edge_states": lambda s, d: edge_state(_closed(s, d), 100),
    "edge_support": lambda s, d: support(role(s, d, "edges")),
    "degree_counts": lambda s, d: degrees(role(s, d, "edges")),
    "value_changes": lambda s, d: changes(role(s, d, "node_values")),
    "values_asof": lambda s, d: values_at(role(s, d, "node_values"), 100),
    "refutations": lambda s, d: refuted(_values(s, d)),
    "cooccurrence_antijoin": lambda s, d: missing_links(_mentions(s, d), _tied(s, d)),
    "schema_gaps": lambda s, d: without_relation(role(s, d, "node_values").select("book", "node").distinct(), role(s, d, "edges"), "rel_R"),
    "origin_conflicts": lambda s, d: origin_conflicts(role(s, d, "edges")),
    "delta_classes": lambda s, d: delta_classes(role(s, d, "edges").where("origin = 'model'"), role(s, d, "edges").where("learned_at < 100")),
    "relation_objects": lambda s, d: heavy_objects(role(s, d, "edges"), 20),
    "graph_health": lambda s, d: health(role(s, d, "edges")),
    "node_clusters": lambda s, d: clusters(_claim_edges(s, d), _RULES),
    "case_components": lambda s, d: cases(role(s, d, "edges")),
}
_E, _V, _CL = sql_role("edges"), sql_role("node_values"), sql_role("claims")
_MERGED = lambda where: f"(SELECT book, src, relation, dst, (min((learned_at IS NULL, learned_at, evidence)))[2] AS learned_at, (min((learned_at IS NULL, learned_at, evidence)))[3] AS evidence, CASE max({_O}) WHEN 2 THEN 'manual' WHEN 1 THEN 'system' ELSE 'model' END AS origin, max(confidence) AS confidence, CASE WHEN (max(({_O}, status = 'approved')))[2] THEN 'approved' ELSE 'rejected' END AS status, count(*) AS seen FROM {_E} e WHERE {where} GROUP BY book, src, relation, dst)"
_O = "CASE origin WHEN 'manual' THEN 2 WHEN 'system' THEN 1 ELSE 0 END"
_CLOSED = f"(SELECT *, lead(since) OVER w AS until, lead(dst) OVER w AS \"by\" FROM (SELECT book, src, relation, dst, min(learned_at) AS since FROM {_E} e WHERE status = 'approved' AND learned_at IS NOT NULL GROUP BY ALL) q WINDOW w AS (PARTITION BY book, src, relation ORDER BY since, dst))"
_EDGE_COMPONENTS = f"""WITH RECURSIVE e AS (SELECT DISTINCT book || '/' || src AS u, book || '/' || dst AS v FROM {_E} x), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, seen) AS (SELECT u, u FROM b UNION SELECT b.v, r.seen FROM r JOIN b ON r.node = b.u)
SELECT component, count(*) AS members FROM (SELECT node, min(seen) AS component FROM r GROUP BY node) q GROUP BY component"""
ORACLE = {
    "graph_export": f"""WITH n AS (SELECT * FROM {duck(_ENDS)} q WHERE first_chapter IS NULL OR first_chapter <= 12), e AS (SELECT * FROM {duck(_TIES)} q WHERE learned_at <= 12 AND EXISTS (SELECT 1 FROM n WHERE n.book = q.book AND n.node = q.src) AND EXISTS (SELECT 1 FROM n WHERE n.book = q.book AND n.node = q.dst))
SELECT book, 'node' AS kind, CAST(to_json({{'node': node, 'first_chapter': first_chapter}}) AS VARCHAR) AS line FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.book = n.book AND n.node IN (e.src, e.dst)) UNION ALL SELECT book, 'edge', CAST(to_json({{'src': src, 'relation': relation, 'dst': dst, 'learned_at': learned_at}}) AS VARCHAR) FROM e""",
    "edge_upsert_merge": f"SELECT * FROM {_MERGED('true')} m",
    "edges_two_ended": f"WITH n AS (SELECT concat('c', c_custkey) AS node, c_name AS name FROM customer UNION ALL SELECT concat('s', s_suppkey), s_name FROM supplier) SELECT book, relation, a.name AS src_name, b.name AS dst_name, min(learned_at) AS learned_at FROM {_E} e JOIN n a ON e.src = a.node JOIN n b ON e.dst = b.node WHERE learned_at <= 100 AND status = 'approved' GROUP BY ALL",
    "edge_closing": f"SELECT * FROM {_CLOSED} c",
    "edge_states": f"SELECT book, CASE WHEN length(dst) = 2 AND since + 20 <= 100 THEN 'disproven' WHEN until IS NULL THEN 'active' WHEN until > 100 THEN 'active_end_hidden' ELSE 'ended' END AS state, count(*) AS n FROM {_CLOSED} c WHERE since <= 100 GROUP BY ALL",
    "edge_support": f"SELECT book, least(src, dst) AS a, relation, greatest(src, dst) AS b, count(DISTINCT learned_at) AS chapters FROM {_E} e WHERE learned_at IS NOT NULL GROUP BY ALL",
    "degree_counts": f"SELECT book, node, count(*) AS edges, count(DISTINCT relation) AS relations, min(learned_at) AS first FROM (SELECT book, unnest([src, dst]) AS node, relation, learned_at FROM {_E} e) q GROUP BY ALL",
    "value_changes": f"SELECT book, node, key, value, learned_at, seq FROM (SELECT *, lag(value) OVER w AS p, row_number() OVER w AS n FROM {_V} v WINDOW w AS (PARTITION BY book, node, key ORDER BY learned_at, seq)) q WHERE n = 1 OR value IS DISTINCT FROM p",
    "values_asof": f"SELECT book, node, key, arg_max(value, (learned_at, seq)) AS value, max(learned_at) AS learned_at FROM {_V} v WHERE learned_at <= 100 GROUP BY book, node, key",
    "refutations": f"WITH v AS (SELECT *, seq % 4 = 0 AS confirmed FROM {_V} x) SELECT a.book, a.node, a.key, a.value, a.learned_at, a.seq, min(b.learned_at) AS refuted_at FROM v a JOIN v b ON a.book = b.book AND a.node = b.node AND a.key = b.key AND (b.learned_at, b.seq) > (a.learned_at, a.seq) AND b.confirmed AND b.value <> a.value WHERE NOT a.confirmed GROUP BY ALL",
    "cooccurrence_antijoin": f"WITH c AS (SELECT * FROM {_CL} x), m AS (SELECT DISTINCT book, concat(chapter, ':', right(evidence, 1)) AS place, subject AS node FROM c), t AS (SELECT DISTINCT book, least(subject, o) AS a, greatest(subject, o) AS b FROM (SELECT book, subject, concat('s', (CAST(substring(subject, 2, 3) AS INT) + 1) % 30) AS o FROM c) q) SELECT p.* FROM (SELECT x.book, x.node AS a, y.node AS b, count(DISTINCT x.place) AS places FROM m x JOIN m y ON x.book = y.book AND x.place = y.place AND x.node < y.node GROUP BY ALL) p ANTI JOIN t ON p.book = t.book AND p.a = t.a AND p.b = t.b WHERE places >= 2",
    "schema_gaps": f"SELECT DISTINCT book, node FROM {_V} v WHERE NOT EXISTS (SELECT 1 FROM {_E} e WHERE e.book = v.book AND e.src = v.node AND relation = 'rel_R')",
    "origin_conflicts": f"WITH p AS (SELECT DISTINCT book, least(src, dst) AS a, greatest(src, dst) AS b, relation, origin FROM {_E} e), f AS (SELECT book, a, b, list_sort(list(DISTINCT relation)) AS firm FROM p WHERE origin <> 'model' GROUP BY ALL) SELECT p.book, p.a, p.b, relation, array_to_string(firm, ',') AS firm FROM p JOIN f ON p.book = f.book AND p.a = f.a AND p.b = f.b WHERE origin = 'model' AND NOT list_contains(firm, relation)",
    "delta_classes": f"SELECT p.book, CASE WHEN m.status = 'rejected' THEN 'CONFLICTS' WHEN p.learned_at IS NULL THEN 'NEEDS_REVIEW' WHEN m.status IS NOT NULL AND p.learned_at = m.learned_at THEN 'ALREADY' WHEN m.status IS NOT NULL AND p.learned_at > m.learned_at THEN 'SUPPORTS' WHEN m.status IS NOT NULL THEN 'UPDATES' ELSE 'NEW' END AS class, count(*) AS n FROM {_E} p LEFT JOIN {_MERGED('learned_at < 100')} m ON p.book = m.book AND p.src = m.src AND p.relation = m.relation AND p.dst = m.dst WHERE p.origin = 'model' GROUP BY ALL",
    "relation_objects": f"SELECT book, relation, dst, count(*) AS edges, count(DISTINCT src) AS subjects FROM {_E} e GROUP BY ALL HAVING count(*) >= 20",
    "graph_health": f"SELECT *, CAST(sum(n) OVER (PARTITION BY book, status ORDER BY chapter) AS BIGINT) AS total FROM (SELECT book, CAST(ceil(learned_at / 25) AS INT) * 25 AS chapter, status, count(*) AS n FROM {_E} e WHERE learned_at IS NOT NULL GROUP BY ALL) q",
    "node_clusters": f"WITH e AS (SELECT book, subject AS src, relation, object AS dst FROM {_CL} x), o AS (SELECT book, src AS node, CASE WHEN bool_or(relation = 'rel_R') AND bool_or(relation = 'rel_A') THEN 'core' WHEN bool_or(relation = 'rel_R') THEN 'outer' END AS cluster FROM e GROUP BY ALL), g AS (SELECT e.book, e.dst AS node, min(cluster) AS g FROM e JOIN o ON e.book = o.book AND e.src = o.node WHERE cluster IS NOT NULL GROUP BY ALL) SELECT coalesce(o.book, g.book) AS book, coalesce(o.node, g.node) AS node, coalesce(cluster, g, 'none') AS cluster FROM o FULL JOIN g ON o.book = g.book AND o.node = g.node",
    "case_components": _EDGE_COMPONENTS,
}
