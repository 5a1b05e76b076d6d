"""How the driver's tables play the library's roles. One SQL text per role, in the subset that Spark and DuckDB share, so that
queries and their oracles start from the same rows; every role is a projection or filter without a shuffle unless it says so."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ROLES = {
    # Every source is a book; the number inside it follows the id. Some numbers, translations and links are missing on purpose.
    "chapters": """SELECT concat('doc:', doc_id) AS url, source AS book, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(floor(doc_id / 20) AS INT) END AS chapter_no,
        concat('Chapter ', CAST(floor(doc_id / 20) AS INT)) AS title, text AS source_text,
        CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 31 = 5 THEN '  ' ELSE text END AS translation,
        CASE WHEN doc_id % 13 = 0 THEN 'html' END AS content_type, concat('model-', doc_id % 3) AS model,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('doc:', doc_id - 20) END AS prev_url, CAST(doc_id % 977 AS DOUBLE) * 60 AS created_at, lang, doc_id FROM {documents}""",
    "events_log": """SELECT CAST(ts AS DATE) AS day, user_id AS slug, concat(event_type, ':', {k}) AS url, ts, event_id FROM {events}""",
    # An event is a reading session that ended then.
    "sessions": """SELECT event_id AS session, CAST(ts AS DATE) AS day, concat('book-', user_id % 5) AS book, CASE WHEN event_type = 'signup' THEN 'tempo' ELSE 'free' END AS mode,
        1000 + CAST({k} AS INT) * 100 AS chars, 200 + CAST({k} AS INT) * 20 AS words, CAST(floor(30000 + value * 4000) AS BIGINT) AS active_ms, CASE WHEN CAST({k} AS INT) % 11 = 0 THEN false ELSE true END AS client_valid,
        ts, CASE WHEN CAST({k} AS INT) % 4 = 0 THEN NULL ELSE CAST({k} AS INT) % 4 END AS chunk FROM {events}""",
    # An event is a call of a model that belongs to a stage of a chapter's translation.
    "calls": """SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, user_id AS chapter, concat('key-', user_id % 4) AS api_key, concat('model-', event_type) AS model, concat('stage-', CAST({k} AS INT) % 4) AS stage,
        CASE WHEN CAST({k} AS INT) % 10 = 0 THEN 'quota' WHEN CAST({k} AS INT) % 7 = 0 THEN 'error' WHEN CAST({k} AS INT) % 13 = 0 THEN 'refused' ELSE 'success' END AS outcome,
        CAST(floor(value * 100) AS BIGINT) AS duration_ms, CAST({k} AS INT) * 100 AS tokens_in, CAST({k} AS INT) * 30 AS tokens_out FROM {events}""",
    "jobs": """SELECT event_id AS id, concat('book-', user_id % 20) AS book, CASE WHEN CAST({k} AS INT) % 5 = 0 THEN NULL ELSE concat('type-', CAST({k} AS INT) % 3) END AS type,
        CASE WHEN CAST({k} AS INT) % 6 = 0 THEN 'running' WHEN CAST({k} AS INT) % 6 = 1 THEN 'error' ELSE 'done' END AS state, ts AS updated_at FROM {events}""",
    # A user turn is a source text and the assistant turn after it its translation.
    "pairs": """SELECT u.conv_id AS book, u.turn AS chapter_no, u.text AS source_text, a.text AS translation FROM {conversations} u JOIN {conversations} a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE u.role = 'user' AND a.role = 'assistant'""",
    # An order line ties a customer to a supplier; the month of the order is the chapter that tells it.
    "edges": """SELECT concat('b', o_custkey % 3) AS book, concat('c', o_custkey % 40) AS src, concat('rel_', l_returnflag) AS relation, concat('s', l_suppkey % 25) AS dst,
        CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE CAST(year(o_orderdate) * 12 + month(o_orderdate) - 23880 AS INT) END AS learned_at, concat('line ', l_orderkey, '-', l_linenumber) AS evidence,
        CASE WHEN l_linestatus = 'F' THEN 'model' WHEN l_linenumber = 1 THEN 'manual' ELSE 'system' END AS origin,
        CASE WHEN l_orderkey % 17 = 0 THEN 'rejected' ELSE 'approved' END AS status, floor(l_discount * 100 + 0.5) / 100 AS confidence FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "node_values": """SELECT concat('b', o_custkey % 3) AS book, concat('c', o_custkey % 200) AS node, o_orderpriority AS key, o_orderstatus AS value, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 23880 AS INT) AS learned_at, o_orderkey AS seq FROM {orders}""",
    # Claims of who did what, from order lines.
    "claims": """SELECT l_orderkey * 10 + l_linenumber AS id, concat('b', l_partkey % 3) AS book, CAST(l_orderkey % 60 AS INT) AS chapter, concat('s', l_suppkey % 30) AS subject, concat('rel_', l_returnflag) AS relation, concat('p', l_partkey % 12) AS object,
        CASE WHEN l_tax >= 0.06 THEN 'narrator' ELSE 'dialogue' END AS voice, l_quantity > 3 AS valid, CASE WHEN l_quantity > 3 THEN NULL WHEN l_quantity > 2 THEN 'no_evidence' ELSE 'schema' END AS reject_reason,
        CASE WHEN l_linenumber % 2 = 0 THEN 'sen' ELSE 'siz' END AS form, concat('quote ', l_orderkey, '.', l_linenumber) AS evidence, concat('kind', l_partkey % 4) AS kind FROM {lineitem}""",
    # Dictionary: capitalised words of a book, learned where they first stand. Shuffles once, on (book, word).
    "terms": """SELECT book, source, min(chapter_no) AS first_chapter, count(DISTINCT chapter_no) AS chapters, lower(reverse(source)) AS target FROM (SELECT source AS book, {explode_words} AS source, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(floor(doc_id / 20) AS INT) END AS chapter_no FROM {documents}) w GROUP BY book, source""",
}
_SPARK = {"k": "get_json_object(props, '$.k')", "explode_words": "explode(array_distinct(regexp_extract_all(text, '[A-Z][a-z]{{4,}}', 0)))"}
_DUCK = {"k": "json_extract_string(props, '$.k')", "explode_words": "unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{4,}}')))"}
_TABLE = re.compile(r"\{(documents|events|conversations|lineitem|orders)\}")


def _fill(sql: str, parts: dict[str, str]) -> str:
    for k, v in parts.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _fill(ROLES[name], _SPARK)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(sql))})


def sql_role(name: str) -> str:
    """The role as a DuckDB subquery."""
    return "(" + _TABLE.sub(r"\1", _fill(ROLES[name], _DUCK)).replace("{{", "{").replace("}}", "}") + ")"


_ROLE = re.compile(r"\{(" + "|".join(ROLES) + r")\}")


def shared(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A FROM item over roles, in the subset of SQL that both engines read, as a DataFrame."""
    return spark.sql("SELECT * FROM " + sql, **{name: role(spark, sf_dir, name) for name in set(_ROLE.findall(sql))})


def duck(sql: str) -> str:
    """The same FROM item for DuckDB; braces that are not a role's are written twice."""
    return _ROLE.sub(lambda m: sql_role(m[1]) + f" {m[1]}_", sql).replace("{{", "{").replace("}}", "}")
