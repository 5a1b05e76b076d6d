"""Books that turn out to be one: what their dictionaries, histories, senses, rejections, graphs and values become under the canonical book.

Aliases resolve through chains; every table is then moved by one map of nodes. What the canonical book has already always stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.components import reliable
from ..sources.tables import duck, shared
from .chapters import _aliases, resolved


def _moved(rows: DataFrame, books: DataFrame) -> DataFrame:
    """rows with `_to`, the book they come to, and `_own`, whether it is theirs already."""
    map_ = books.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return rows.join(map_, F.col("book") == F.col("_a"), "left").withColumn("_to", F.coalesce("_c", "book")).withColumn("_own", F.col("_c").isNull()).drop("_a", "_c")


def _ranked(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Terms with `_wins`, the node that stands for each in the merged book, and `_stays`. The canonical book's terms all stay and come first; of
    other books' terms with one fold the first stays: by book, by when it was made (unknown last), by spelling."""
    same = Window.partitionBy("_to", "_fold").orderBy(F.desc("_own"), "book", F.asc_nulls_last("created_at"), "source")
    told = _moved(rows, books).withColumn("_fold", T.fold_term(F.col("source")))
    return told.withColumn("_wins", F.first("node").over(same)).withColumn("_stays", F.col("_own") | (F.row_number().over(same) == 1)).withColumn("_wins", F.when(F.col("_own"), F.col("node")).otherwise(F.col("_wins")))


def node_map(terms: DataFrame, books: DataFrame) -> DataFrame:
    """terms(book, source, node, created_at, ...) -> (book, node, to_book, to_node): where each term's node is after the merge."""
    return _ranked(terms, books).select("book", "node", F.col("_to").alias("to_book"), F.col("_wins").alias("to_node"))


def merged_terms(terms: DataFrame, books: DataFrame) -> DataFrame:
    """The merged dictionaries: all columns of the terms that stay, with their new book and the book they come from."""
    kept = _ranked(terms, books).where("_stays")
    return kept.withColumn("from_book", F.col("book")).withColumn("book", F.col("_to")).select(*terms.columns, "from_book")


def merged_owned(rows: DataFrame, terms: DataFrame, books: DataFrame) -> DataFrame:
    """rows(book, node, ...) that belong to terms, such as senses and spellings: they come along with a term that stays, and go with one that
    gives way. Rows of the canonical book stay, whatever they belong to."""
    stays = _ranked(terms, books).where("_stays").select(F.col("book").alias("_b"), F.col("node").alias("_n"))
    moved = _moved(rows, books)
    kept = moved.join(stays, (F.col("book") == F.col("_b")) & (F.col("node") == F.col("_n")), "left").where(F.col("_own") | F.col("_n").isNotNull())
    return kept.withColumn("book", F.col("_to")).select(*rows.columns)


def merged_history(history: DataFrame, books: DataFrame) -> DataFrame:
    """Every row of history moves to the canonical book and keeps its node, as it tells of what was."""
    return _moved(history, books).withColumn("book", F.col("_to")).select(*history.columns)


def _first(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of rows that clash the canonical book's own, then the first by book and by all columns."""
    order = Window.partitionBy("_to", *keys).orderBy(F.desc("_own"), "book", *[F.asc_nulls_last(c) for c in columns])
    kept = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_own") | (F.col("_r") == 1))
    return kept.withColumn("book", F.col("_to")).select(*columns)


def merged_rejections(rejected: DataFrame, books: DataFrame) -> DataFrame:
    """rejected(book, key, ...): a key that the canonical book has rejected already is not taken again."""
    return _first(_moved(rejected, books), ["key"], rejected.columns)


def _renamed(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """A column of nodes moved by the map; a node of a sense (`node#sense`) moves with its term and keeps its sense."""
    parts: Column = F.split(column, "#", 2)
    at = rows.withColumn("_base", parts[0]).withColumn("_rest", F.coalesce(F.concat(F.lit("#"), F.get(parts, F.lit(1))), F.lit("")))
    map_ = nodes.select(F.col("book").alias("_b"), F.col("node").alias("_n"), "to_node")
    return at.join(map_, (F.col("book") == F.col("_b")) & (F.col("_base") == F.col("_n")), "left").withColumn(column, F.concat(F.coalesce("to_node", "_base"), "_rest")).drop("_base", "_rest", "_b", "_n", "to_node")


def merged_edges(edges: DataFrame, nodes: DataFrame, books: DataFrame) -> DataFrame:
    """edges(book, src, relation, dst, ...) between the nodes that now stand for their ends. An edge that comes to lead from a node to itself
    goes, and of edges that coincide the canonical book's stays."""
    moved = _renamed(_renamed(_moved(edges, books), "src", nodes), "dst", nodes)
    return _first(moved.where(F.col("_own") | (F.col("src") != F.col("dst"))), ["src", "relation", "dst"], edges.columns)


def merged_values(values: DataFrame, nodes: DataFrame, books: DataFrame) -> DataFrame:
    """values(book, node, key, learned_at, ...) of the nodes that now stand for theirs; what the canonical book has for a key and chapter stays."""
    return _first(_renamed(_moved(values, books), "node", nodes), ["node", "key", "learned_at"], values.columns)


# Inputs of the queries, in SQL that both engines read.
_TERMS = "(SELECT book, source, target, concat(book, ':', source) AS node, first_chapter AS created_at FROM {terms})"
_SENSES = "(SELECT book, concat(book, ':', source) AS node, length(source) AS size FROM {terms} WHERE length(source) % 3 = 0)"
_HISTORY = "(SELECT book, concat(book, ':', source) AS node, target, chapters AS seq FROM {terms} WHERE chapters > 1)"
_REJECTED = "(SELECT book, lower(source) AS key, target FROM {terms} WHERE length(source) % 5 = 1)"
_EDGES = """(SELECT book, concat(book, ':', source, CASE WHEN length(source) % 4 = 0 THEN '#name' ELSE '' END) AS src, 'near' AS relation, concat(book, ':', min(source) OVER (PARTITION BY book, length(source))) AS dst, first_chapter AS learned_at FROM {terms})"""
_VALUES = "(SELECT book, concat(book, ':', source) AS node, 'size' AS key, length(target) + chapters AS value, CASE WHEN first_chapter IS NULL THEN 0 ELSE first_chapter % 5 END AS learned_at FROM {terms})"


def _books(s):
    return reliable(resolved(_aliases(s)))


_terms = lambda s, d: shared(s, d, _TERMS)

QUERIES = {
    "merged_terms": lambda s, d: merged_terms(_terms(s, d), _books(s)),
    "merged_nodes": lambda s, d: node_map(_terms(s, d), _books(s)),
    "merged_senses": lambda s, d: merged_owned(shared(s, d, _SENSES), _terms(s, d), _books(s)),
    "merged_history": lambda s, d: merged_history(shared(s, d, _HISTORY), _books(s)),
    "merged_rejections": lambda s, d: merged_rejections(shared(s, d, _REJECTED), _books(s)),
    "merged_edges": lambda s, d: merged_edges(shared(s, d, _EDGES), node_map(_terms(s, d), _books(s)), _books(s)),
    "merged_values": lambda s, d: merged_values(shared(s, d, _VALUES), node_map(_terms(s, d), _books(s)), _books(s)),
}
_TO = "CASE book WHEN 'src1' THEN 'src2' WHEN 'src3' THEN 'src2' WHEN 'src4' THEN 'src2' WHEN 'src5' THEN 'src2' WHEN 'src7' THEN 'src8' ELSE book END"
_MAP = f"""m AS MATERIALIZED (SELECT *, row_number() OVER w AS r, CASE WHEN own THEN node ELSE first_value(node) OVER w END AS wins FROM (SELECT *, {_TO} AS goes, {_TO} = book AS own, lower(regexp_replace(trim(source), '[\\s\\-_''’.·]+', '', 'g')) AS fold FROM {duck(_TERMS)} t) q
 WINDOW w AS (PARTITION BY goes, fold ORDER BY own DESC, book, created_at NULLS LAST, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_NEW = lambda c: f"coalesce((SELECT any_value(wins) FROM m WHERE m.book = x.book AND m.node = split_part(x.{c}, '#', 1)), split_part(x.{c}, '#', 1)) || CASE WHEN contains(x.{c}, '#') THEN '#' || split_part(x.{c}, '#', 2) ELSE '' END"
_KEPT = lambda inner, keys, columns: f"SELECT goes AS book, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY goes, {keys} ORDER BY own DESC, book, {', '.join(c + ' NULLS LAST' for c in columns.split(', '))}) AS r FROM ({inner}) a) b WHERE own OR r = 1"
ORACLE = {
    "merged_terms": f"WITH {_MAP} SELECT goes AS book, source, target, node, created_at, book AS from_book FROM m WHERE own OR r = 1",
    "merged_nodes": f"WITH {_MAP} SELECT book, node, goes AS to_book, wins AS to_node FROM m",
    "merged_senses": f"WITH {_MAP} SELECT {_TO.replace('book', 'x.book')} AS book, x.node, x.size FROM {duck(_SENSES)} x WHERE {_TO.replace('book', 'x.book')} = x.book OR EXISTS (SELECT 1 FROM m WHERE m.book = x.book AND m.node = x.node AND (own OR r = 1))",
    "merged_history": f"SELECT {_TO} AS book, node, target, seq FROM {duck(_HISTORY)} x",
    "merged_rejections": _KEPT(f"SELECT *, {_TO} AS goes, {_TO} = book AS own FROM {duck(_REJECTED)} x", "key", "key, target"),
    "merged_edges": f"WITH {_MAP} " + _KEPT(f"SELECT * FROM (SELECT x.book, {_NEW('src')} AS src, relation, {_NEW('dst')} AS dst, learned_at, {_TO.replace('book', 'x.book')} AS goes, {_TO.replace('book', 'x.book')} = x.book AS own FROM {duck(_EDGES)} x) e WHERE own OR src <> dst", "src, relation, dst", "src, relation, dst, learned_at"),
    "merged_values": f"WITH {_MAP} " + _KEPT(f"SELECT x.book, {_NEW('node')} AS node, key, value, learned_at, {_TO.replace('book', 'x.book')} AS goes, {_TO.replace('book', 'x.book')} = x.book AS own FROM {duck(_VALUES)} x", "node, key, learned_at", "node, key, value, learned_at"),
}
