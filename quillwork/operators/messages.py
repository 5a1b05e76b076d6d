"""System-message lines in chapters: classified one by one, then accepted by their place among each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import role, sql_role

# Line shapes, credits that are no messages, the reach of a block, and the longest line.
BRACKETED = r"^(\[[^\[\]]+\]|【[^【】]+】)\s*(\([^()]{1,80}\))?[.!]?$"
BRACKETED_VALUE = r"^\[[^\[\]]+\](\s*,\s*\[[^\[\]]+\])*[.!]?$"
KEY_LINE = r"^([A-Z][A-Za-z' ]{0,30}[A-Za-z]):\s*(\S.*)$"
QUOTES = "[\"“”]"
CREDITS = ("translator", "translators", "editor", "editors", "proofreader", "proofreaders", "author", "tl", "ed", "pr", "tl note", "tl notes", "translated by", "edited by", "source", "sponsored", "patreon", "discord")
REACH, LONGEST = 3, 300


def line_kind(line: Column, key: Column, value: Column, voices: tuple[str, ...] = ()) -> Column:
    """bracket, voice, bracket_value or key of a line by itself, or null; key and value are its parts by KEY_LINE."""
    spoken = F.exists(F.array(*map(F.lit, voices)).cast("array<string>"), lambda v: F.startswith(F.lower(key), F.lower(v)))
    told = (key != "") & ~line.rlike(QUOTES) & ~F.lower(key).isin(*CREDITS)
    return F.when(F.length(line) <= LONGEST, F.when(line.rlike(BRACKETED), "bracket").when(told & spoken, "voice").when(told & value.rlike(BRACKETED_VALUE), "bracket_value").when(told, "key"))


def messages(chapters: DataFrame, voices: tuple[str, ...] = ("System",), keys: tuple[str, ...] = (), separator: str = "\n\n") -> DataFrame:
    """(url, book, line, paragraph, kind, key, value) of the accepted lines, `line` counting them within their chapter.

    All kinds but plain keys stand alone. With `keys`, a key line is accepted if it is listed. Without, it needs such a line right
    after it or an accepted one at most REACH lines before; as each accepted line carries on to the next, that is every key line
    from the first such place of a run on, a run being lines of any kind that stand at most REACH apart. Blank lines do not count."""
    paras = chapters.where("source_text is not null").select("url", "book", F.posexplode(F.split("source_text", separator)).alias("paragraph", "p"))
    lines = paras.select("url", "book", "paragraph", F.posexplode(F.split("p", "\n")).alias("k", "raw")).select("url", "book", "paragraph", "k", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    parts = lines.select("*", F.regexp_extract("text", KEY_LINE, 1).alias("key"), F.regexp_extract("text", KEY_LINE, 2).alias("value"))
    place = Window.partitionBy("url").orderBy("paragraph", "k")
    kinds = parts.withColumn("kind", line_kind(F.col("text"), F.col("key"), F.col("value"), voices)).withColumn("at", F.row_number().over(place)).withColumn("after", F.lead("kind").over(place)).where("kind is not null")
    alone = F.col("kind") != "key"
    if keys:
        accepted = kinds.where(alone | F.lower("key").isin(*[k.lower() for k in keys]))
    else:
        along = Window.partitionBy("url").orderBy("at")
        runs = kinds.withColumn("_far", F.coalesce(F.col("at") - F.lag("at").over(along) > REACH, F.lit(False)).cast("int")).withColumn("_run", F.sum("_far").over(along))
        begun = F.max((alone | F.coalesce(F.col("after") != "key", F.lit(False))).cast("int")).over(Window.partitionBy("url", "_run").orderBy("at"))
        accepted = runs.withColumn("_begun", begun).where("_begun = 1")
    bracket = F.col("kind") == "bracket"
    out = accepted.select("url", "book", "at", "paragraph", F.when(F.col("kind") == "bracket_value", "bracket").otherwise(F.col("kind")).alias("kind"), F.when(~bracket, F.col("key")).alias("key"), F.when(bracket, F.col("text")).otherwise(F.col("value")).alias("value"))
    return out.select("url", "book", (F.row_number().over(Window.partitionBy("url").orderBy("at")) - 1).cast("long").alias("line"), F.col("paragraph").cast("long").alias("paragraph"), "kind", "key", "value")


def key_frequency(found: DataFrame, top: int = 30) -> DataFrame:
    """The commonest keys, a top-k report; equal counts by name."""
    return found.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("book").alias("books")).orderBy(F.desc("n"), "key").limit(top)


def _told(s, d):
    """Chapters with a message block of their own at the end."""
    block = F.concat_ws("\n\n", "source_text", F.concat(F.lit("[Level "), F.col("doc_id") % 9, F.lit("]")), F.concat(F.lit("Name: ["), "book", F.lit("]")), F.concat(F.lit("Rank: "), "lang"), F.lit("He said: \"no\""))
    return role(s, d, "chapters").withColumn("source_text", block)


QUERIES = {"message_lines": lambda s, d: messages(_told(s, d)), "message_keys": lambda s, d: key_frequency(messages(_told(s, d)))}
_q = lambda x: "'" + x.replace("'", "''") + "'"
_TOLD = f"(SELECT url, book, concat_ws(chr(10) || chr(10), source_text, '[Level ' || (doc_id % 9) || ']', 'Name: [' || book || ']', 'Rank: ' || lang, 'He said: \"no\"') AS source_text FROM {sql_role('chapters')} c)"
_MESSAGES = f"""p AS (SELECT url, book, unnest(range(len(ps))) AS paragraph, unnest(ps) AS p FROM (SELECT url, book, string_split(source_text, chr(10) || chr(10)) AS ps FROM {_TOLD} t) a),
l AS (SELECT url, book, paragraph, unnest(range(len(ls))) AS k, regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT url, book, paragraph, string_split(p, chr(10)) AS ls FROM p) a),
k AS (SELECT *, regexp_extract(text, {_q(KEY_LINE)}, 1) AS key, regexp_extract(text, {_q(KEY_LINE)}, 2) AS value FROM l WHERE text <> ''),
c AS (SELECT *, CASE WHEN length(text) <= {LONGEST} THEN CASE WHEN regexp_matches(text, {_q(BRACKETED)}) THEN 'bracket' WHEN key <> '' AND NOT regexp_matches(text, {_q(QUOTES)}) AND lower(key) NOT IN ({', '.join(map(_q, CREDITS))}) THEN CASE WHEN starts_with(lower(key), 'system') THEN 'voice' WHEN regexp_matches(value, {_q(BRACKETED_VALUE)}) THEN 'bracket_value' ELSE 'key' END END END AS kind FROM k),
o AS (SELECT *, row_number() OVER w AS pos, lead(kind) OVER w AS after FROM c WINDOW w AS (PARTITION BY url ORDER BY paragraph, k)),
r AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY pos) AS run FROM (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY url ORDER BY pos) > {REACH}, false) AS far FROM o WHERE kind IS NOT NULL) q),
m AS (SELECT url, book, row_number() OVER (PARTITION BY url ORDER BY pos) - 1 AS line, paragraph, CASE kind WHEN 'bracket_value' THEN 'bracket' ELSE kind END AS kind, CASE WHEN kind <> 'bracket' THEN key END AS key, CASE WHEN kind = 'bracket' THEN text ELSE value END AS value
 FROM (SELECT *, bool_or(kind <> 'key' OR coalesce(after <> 'key', false)) OVER (PARTITION BY url, run ORDER BY pos) AS begun FROM r) q WHERE begun)"""
ORACLE: dict[str, str] = {
    "message_lines": f"WITH {_MESSAGES} SELECT * FROM m",
    "message_keys": f"WITH {_MESSAGES} SELECT key, count(*) AS n, count(DISTINCT book) AS books FROM m WHERE key IS NOT NULL GROUP BY key ORDER BY n DESC, key LIMIT 30",
}
