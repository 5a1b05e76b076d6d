"""Keys and cuts of running text: harmless variants of names, candidate names of a paragraph, phrases for guided reading, quota days of
another zone, and what can be read of a model's JSON answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import duck, role, shared, sql_role
from .glossary import variant_key

# Words that no name begins with, words that carry nothing of a name, endings in s that are no plurals, bounds of a
# phrase, and the zone whose midnight ends a quota's day.
OPENERS = tuple("The A An He She It They We I You His Her Its Their Our My Your But And Or Then When What Why How Who Where This That These Those There If As In On At So Yes No Was Were Did Do Does Is Are Be Of To For With After Before Still Even Now Just Not Only Once Also Well Oh Ah Hmm Perhaps Maybe All Some Every Each Instead However".split())
EMPTY_WORDS = ("the", "a", "an", "of")
NO_PLURALS = ("ss", "us", "is", "ous", "ics", "sis", "news", "corps", "series", "species")
SMALLEST_PHRASE, LARGEST_PHRASE = 2, 6
QUOTA_ZONE = "America/Los_Angeles"

# Fixed value: a run of capitalised words that can be a name.
_NAME_RUN = r"[A-Z][\p{L}\p{N}'’-]*(?:\s+(?:of\s+the\s+|of\s+|the\s+)?[A-Z][\p{L}\p{N}'’-]*)*"


def _content(source: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(T.normalise_source(source), r"(?i)['’]s\b", "")), r"[\s\-_]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*EMPTY_WORDS))


def content_key(source: Column) -> Column:
    """The words that carry a name, in any order."""
    return F.array_join(F.array_sort(_content(source)), " ")


def singular_key(source: Column) -> Column:
    """content_key with each word in the singular."""
    plural = lambda w: (F.length(w) > 3) & w.endswith("s") & ~F.exists(F.array(*map(F.lit, NO_PLURALS)), lambda e: w.endswith(e))
    one = F.transform(_content(source), lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_join(F.array_sort(one), " ")


def variants(terms: DataFrame) -> DataFrame:
    """(book, kind, key, n, first, last): names of a book that one of the three keys makes one."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col("source")).alias("key")) for k, f in (("harmless", variant_key), ("content", content_key), ("singular", singular_key))])
    each = terms.select("book", "source", F.inline(keys)).where("key <> ''")
    return each.groupBy("book", "kind", "key").agg(F.countDistinct("source").alias("n"), F.min("source").alias("first"), F.max("source").alias("last")).where("n > 1")


def rejected_variants(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates that are no harmless variant of what was rejected before."""
    known = rejected.select("book", variant_key(F.col("source")).alias("key")).distinct()
    return candidates.withColumn("key", variant_key(F.col("source"))).join(known, ["book", "key"], "left_anti").select("book", "source")


def candidate_names(paras: DataFrame) -> DataFrame:
    """(id, names): runs of capitalised words of a paragraph, also over `of the`, without words that only open a sentence before
    them; each once, in order of place."""
    runs = F.transform(F.regexp_extract_all("en", F.lit(_NAME_RUN), F.lit(0)), lambda x: F.split(x, r"\s+"))
    first = lambda ws: F.get(F.filter(F.transform(ws, lambda w, i: F.when(~w.isin(*OPENERS), i)), lambda i: i.isNotNull()), F.lit(0))
    bare = F.transform(runs, lambda ws: F.when(first(ws).isNotNull(), F.regexp_replace(F.array_join(F.slice(ws, first(ws) + 1, F.size(ws)), " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    kept = F.filter(bare, lambda x: x.isNotNull() & (F.length(x) >= 2))
    return paras.select("id", F.array_join(F.array_distinct(kept), "|").alias("names")).where("names <> ''")


def phrase_ends(paras: DataFrame, size: int) -> DataFrame:
    """(id, phrases, words): a paragraph cut for guided reading after every `size` words, or earlier where a sentence ends; the words
    of each phrase, comma-joined. A running count that sentence ends reset: within a sentence every `size`-th word ends a phrase."""
    n = min(LARGEST_PHRASE, max(SMALLEST_PHRASE, size))
    words = F.regexp_extract_all("en", F.lit(r"\S+"), F.lit(0))
    ends = lambda w: w.rlike(r"[.!?…:;][\"”’)]*$")

    def step(acc: Column, w: Column) -> Column:
        full = (acc["run"] + 1 >= n) | ends(w)
        return F.struct(F.when(full, 0).otherwise(acc["run"] + 1).alias("run"), F.when(full, F.concat(acc["out"], F.array(acc["run"] + 1))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(words, F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("out")), step, lambda acc: F.when(acc["run"] > 0, F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"]))
    return paras.select("id", folded.alias("p")).select("id", F.size("p").cast("long").alias("phrases"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("words"))


def quota_days(calls: DataFrame, zone: str = QUOTA_ZONE) -> DataFrame:
    """Calls per quota day, the zone's own with its summer time, and the seconds (UTC) at which the quota starts anew; and by the fixed
    offset that a panel is written in, three hours east, the first call of the day."""
    local = F.from_utc_timestamp("ts", zone)
    day = F.to_date(local)
    again = F.unix_timestamp(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone))
    return calls.groupBy(day.alias("quota_day")).agg(F.count("*").alias("calls"), F.min(again).alias("starts_anew"), F.date_format(F.min("ts") + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd HH:mm").alias("first_local"))


def tolerant_json(answers: DataFrame, field: str = "translation", after: str = "detected_names") -> DataFrame:
    """(id, state, value): a text field of a model's JSON answer. Fences around it do not matter; of one that is cut off or broken the
    field is read up to the field that follows, or to the end; an answer without it is taken as it is (`raw`)."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("answer"), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    whole = F.get_json_object(bare, f"$.{field}")
    upto = F.regexp_extract(bare, rf'(?s)"{field}"\s*:\s*"(.*?)"\s*,\s*"{after}"', 1)
    open_ = F.regexp_replace(F.regexp_extract(bare, rf'(?s)"{field}"\s*:\s*"(.*)$', 1), r'"\s*\}\s*$', "")
    clear = lambda x: F.replace(F.replace(F.regexp_replace(x, '"+$', ""), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    state = F.when(whole.isNotNull(), "whole").when(upto != "", "recovered").when(open_ != "", "cut_off").otherwise("raw")
    value = F.when(whole.isNotNull(), whole).when(upto != "", clear(upto)).when(open_ != "", clear(open_)).otherwise(F.col("answer"))
    return answers.select("id", state.alias("state"), value.alias("value"))


def text_sizes(chapters: DataFrame) -> DataFrame:
    """(url, letters, words, last): characters that are no white space, words, and the last two sentences."""
    words = F.size(F.filter(F.split("source_text", r"\s+"), lambda w: w != "")).cast("long")
    return chapters.where("source_text is not null").select("url", T.non_space(F.col("source_text")).cast("long").alias("letters"), words.alias("words"), F.sha2(T.last_sentences(F.col("source_text"), 2), 256).alias("last"))


# Inputs of the queries, in SQL that both engines read.
_NAMES = """(SELECT book, source FROM {terms} UNION ALL SELECT book, concat('The Gate of the ', source) FROM {terms} WHERE chapters % 2 = 0 UNION ALL SELECT book, concat('Gate of ', source) FROM {terms} WHERE chapters % 2 = 0
  UNION ALL SELECT book, concat(source, '''s Gates') FROM {terms} WHERE chapters % 3 = 0 UNION ALL SELECT book, concat(source, ' Gate') FROM {terms} WHERE chapters % 6 = 0)"""
_REJECTED = "(SELECT book, concat('Gate of the ', source) AS source FROM {terms} WHERE length(source) % 3 = 0)"
_PARAS = "(SELECT doc_id AS id, concat('But The Gate of the North fell. Then ', source_text, ' He met Mara Vell, and So on. ', regexp_extract(source_text, '[A-Z][a-z]+', 0)) AS en FROM {chapters} WHERE source_text IS NOT NULL)"
_ANSWERS = """(SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN concat('{{"translation": "', url, '", "detected_names": []}}') WHEN 1 THEN concat('```json', chr(10), '{{"translation": "', url, '"}}', chr(10), '```') WHEN 2 THEN concat('{{"translation": "', url, ' "so" he said", "detected_names": [') WHEN 3 THEN concat('{{"translation": "', url, ' and') ELSE concat('Here it is: ', url) END AS answer FROM {chapters})"""


QUERIES = {
    "name_variants": lambda s, d: variants(shared(s, d, _NAMES)),
    "rejected_variants": lambda s, d: rejected_variants(shared(s, d, _NAMES), shared(s, d, _REJECTED)),
    "candidate_names": lambda s, d: candidate_names(shared(s, d, _PARAS)),
    "phrase_ends": lambda s, d: phrase_ends(shared(s, d, _PARAS), 3),
    "quota_days": lambda s, d: quota_days(role(s, d, "calls")),
    "tolerant_json": lambda s, d: tolerant_json(shared(s, d, _ANSWERS)),
    "text_sizes": lambda s, d: text_sizes(role(s, d, "chapters")),
}
_q = lambda x: "'" + x.replace("'", "''") + "'"
_in = lambda xs: ", ".join(map(_q, xs))
_FOLD = lambda x: f"lower(regexp_replace(trim({x}), '[\\s\\-_''’.·]+', '', 'g'))"
_HARMLESS = _FOLD("regexp_replace(regexp_replace(regexp_replace(trim(source), '(?i)^(?:the|a|an)\\s+', ''), '(?i)\\bof\\s+the\\b', 'of', 'g'), '(?i)[''’]s\\b', '', 'g')")
_CONTENT = f"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(source, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '[''’]s$', ''), '(?i)[''’]s\\b', '', 'g')), '[\\s\\-_]+'), lambda w: w <> '' AND w NOT IN ({_in(EMPTY_WORDS)}))"
_ONE = f"list_transform({_CONTENT}, lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT regexp_matches(w, '({'|'.join(NO_PLURALS)})$') THEN left(w, length(w) - 1) ELSE w END)"
ORACLE = {
    "name_variants": f"""WITH n AS (SELECT * FROM {duck(_NAMES)} n), k AS (SELECT book, source, 'harmless' AS kind, {_HARMLESS} AS key FROM n UNION ALL SELECT book, source, 'content', array_to_string(list_sort({_CONTENT}), ' ') FROM n UNION ALL SELECT book, source, 'singular', array_to_string(list_sort({_ONE}), ' ') FROM n)
SELECT book, kind, key, count(DISTINCT source) AS n, min(source) AS first, max(source) AS last FROM k WHERE key <> '' GROUP BY book, kind, key HAVING count(DISTINCT source) > 1""",
    "rejected_variants": f"WITH n AS (SELECT book, source, {_HARMLESS} AS key FROM {duck(_NAMES)} n), r AS (SELECT DISTINCT book, {_HARMLESS} AS key FROM {duck(_REJECTED)} r) SELECT book, source FROM n ANTI JOIN r ON n.book = r.book AND n.key = r.key",
    "candidate_names": f"""WITH r AS (SELECT id, unnest(range(len(x))) AS k, unnest(x) AS run FROM (SELECT id, regexp_extract_all(en, {_q(_NAME_RUN)}) AS x FROM {duck(_PARAS)} p) q), w AS (SELECT id, k, regexp_split_to_array(run, '\\s+') AS ws FROM r),
f AS (SELECT id, k, ws, list_filter(range(1, len(ws) + 1), lambda i: ws[i] NOT IN ({_in(OPENERS)}))[1] AS i FROM w), c AS (SELECT id, k, regexp_replace(array_to_string(ws[i:len(ws)], ' '), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS name FROM f WHERE i IS NOT NULL),
d AS (SELECT id, name, min(k) AS k FROM c WHERE length(name) >= 2 GROUP BY ALL) SELECT id, string_agg(name, '|' ORDER BY k) AS names FROM d GROUP BY id""",
    "phrase_ends": f"""WITH w AS (SELECT id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS w FROM (SELECT id, regexp_extract_all(en, '\\S+') AS x FROM {duck(_PARAS)} p) q), s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?…:;]["”’)]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM w),
p AS (SELECT id, sentence, CAST(floor((row_number() OVER (PARTITION BY id, sentence ORDER BY i) - 1) / 3) AS BIGINT) AS part, i FROM s), g AS (SELECT id, sentence, part, min(i) AS i, count(*) AS n FROM p GROUP BY ALL) SELECT id, count(*) AS phrases, string_agg(n::VARCHAR, ',' ORDER BY i) AS words FROM g GROUP BY id""",
    "tolerant_json": f"""SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'whole' WHEN 2 THEN 'recovered' WHEN 3 THEN 'cut_off' ELSE 'raw' END AS state, CASE doc_id % 5 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN url || ' "so" he said' WHEN 3 THEN url || ' and' ELSE 'Here it is: ' || url END AS value FROM {sql_role('chapters')} c""",
    "text_sizes": rf"""SELECT url, length(regexp_replace(x, '\s+', '', 'g')) AS letters, CAST(len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) AS BIGINT) AS words, sha256(array_to_string(p[greatest(len(p) - 2, 0) + 1:], ' ')) AS last
FROM (SELECT url, source_text AS x, string_split(regexp_replace(regexp_replace(source_text, '^\s+|\s+$', '', 'g'), '([.!?…])\s+', concat('\1', chr(1)), 'g'), chr(1)) AS p FROM {sql_role('chapters')} c WHERE source_text IS NOT NULL) q""",
}
