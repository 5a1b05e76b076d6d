"""Wording of targets: foreign words, attribution of unknown names, class words in wrong places, one policy per person, review
reasons from claims, verdicts, and text ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import role, sql_role

# Capitalised English words that are no names, marks that end a sentence, and thresholds of the review reasons.
NO_NAMES = ("The", "He", "She", "It", "They", "But", "And", "Then", "His", "Her", "A", "An", "In", "On", "At", "If", "We", "You", "This", "That", "There", "What", "When")
COMMON_LEAST, ALIAS_LEAST, CLASH_LEAST = 3, 2, 2

_FOREIGN = r"[^\P{L}\p{IsLatin}]"
_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_ENDED = r"""(?:^|[.!?:…][\s"'“‘(*\[]*)\z"""


def foreign_words(paras: DataFrame) -> DataFrame:
    """Words of a translation with a letter outside the Latin script that the source paragraph does not have as a word."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)))
    known = F.transform(words(F.col("en")), F.lower)
    found = F.filter(words(F.col("tr")), lambda w: w.rlike(_FOREIGN) & ~F.array_contains(known, F.lower(w)))
    return paras.select("book", "chapter_no", "para", F.array_join(F.array_sort(found), ",").alias("words")).where("words <> ''")


def _alone(words: DataFrame, name: str) -> DataFrame:
    """Paragraphs with one distinct word left, and the word."""
    return words.groupBy("id").agg(F.countDistinct("w").alias("n"), F.min("w").alias(name)).where("n = 1").select("id", name)


def attributions(paras: DataFrame, terms: DataFrame) -> DataFrame:
    """paras(id, book, en, tr) and terms(book, source, target) -> (id, candidate, rendering): where one English name and one Turkish
    capitalised word in mid-sentence are unexplained by the dictionary, each is the other's rendering; "=" if the name was kept.
    Any other count is no evidence and gives no row."""
    capital = F.filter(F.array_distinct(T.words(F.col("en"))), lambda w: w.rlike(r"^[A-Z][a-z]{2,}\z"))
    en = paras.select("id", "book", F.explode(capital).alias("w")).where(~F.col("w").isin(*NO_NAMES)).join(terms.select("book", F.col("source").alias("w")), ["book", "w"], "left_anti")
    t = F.regexp_extract_all("tr", F.lit(_TOKENS), F.lit(0))
    seen = paras.select("id", "book", "en", t.alias("t")).select("id", "book", "en", F.explode(F.transform("t", lambda w, i: F.when(w.rlike(r"^\p{Lu}\p{L}{2,}") & (i > 0) & ~F.get("t", i - 1).rlike(_ENDED), w))).alias("w"))
    tr = seen.where("w is not null").where(~F.contains("en", "w")).select("id", "book", "w").join(terms.select("book", F.col("target").alias("w")), ["book", "w"], "left_anti")
    one = _alone(en, "candidate").join(paras.select("id", "tr"), "id").withColumn("kept", F.contains("tr", "candidate"))
    return one.join(_alone(tr, "other"), "id", "left").where("kept or other is not null").select("id", "candidate", F.when(F.col("kept"), "=").otherwise(F.col("other")).alias("rendering"))


def class_word_mixups(terms: DataFrame, classes: DataFrame) -> DataFrame:
    """terms(book, source, target) and classes(book, class, word) -> (book, source, class): a target has the word of a class that its
    source does not name, so a reader would take it for one; words that a class the source does name shares are free."""
    names = terms.where(T.fold_term(F.col("source")) != T.fold_term(F.col("target")))
    target = names.select("book", "source", F.explode(F.array_distinct(T.words(T.turkish_lower(F.col("target"))))).alias("word"))
    source = names.select("book", "source", F.explode(F.array_distinct(T.words(F.lower("source")))).alias("class"))
    c = classes.select("book", F.lower("class").alias("class"), T.turkish_lower(F.col("word")).alias("word")).distinct()
    named = source.join(c, ["book", "class"])
    used = target.join(c, ["book", "word"]).join(names.select("book", "source").distinct(), ["book", "source"])
    free = named.select("book", "source", "word").distinct()
    return used.join(free, ["book", "source", "word"], "left_anti").groupBy("book", "source").agg(F.min("class").alias("class"))


def split_policies(names: DataFrame) -> DataFrame:
    """names(book, person, name, target): persons of whose names some are kept and some translated, with the translated ones."""
    kept = T.fold_term(F.col("name")) == T.fold_term(F.col("target"))
    out = names.groupBy("book", "person").agg(F.array_sort(F.collect_set(F.when(kept, F.col("name")))).alias("k"), F.array_sort(F.collect_set(F.when(~kept, F.col("name")))).alias("t"))
    return out.where((F.size("k") > 0) & (F.size("t") > 0)).select("book", "person", F.array_join("k", ",").alias("kept"), F.array_join("t", ",").alias("translated"))


def claim_reasons(claims: DataFrame, allied: str, hostile: str) -> DataFrame:
    """claims(book, chapter, kind, subject, relation, object) -> (book, node, reason, other, chapters): a name that three chapters
    use as a common word and none as a name; a name that two chapters use for another; and two that two chapters each call
    allies and enemies, told of both."""
    per = claims.groupBy("book", "subject").agg(F.countDistinct(F.when(F.col("kind") == "common", F.col("chapter"))).alias("c"), F.count(F.when(F.col("kind") == "name", 1)).alias("n"))
    common = per.where((F.col("c") >= COMMON_LEAST) & (F.col("n") == 0)).select("book", F.col("subject").alias("node"), F.lit("common_word").alias("reason"), F.lit(None).cast("string").alias("other"), F.col("c").alias("chapters"))
    alias = claims.where((F.col("kind") == "name") & (F.col("object") != F.col("subject"))).groupBy("book", F.col("subject").alias("node"), F.lit("alias").alias("reason"), F.col("object").alias("other")).agg(F.countDistinct("chapter").alias("chapters")).where(F.col("chapters") >= ALIAS_LEAST)
    pair = claims.where((F.col("kind") == "tie") & F.col("relation").isin(allied, hostile)).groupBy("book", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"))
    both = pair.agg(F.countDistinct(F.when(F.col("relation") == allied, F.col("chapter"))).alias("x"), F.countDistinct(F.when(F.col("relation") == hostile, F.col("chapter"))).alias("y")).where((F.col("x") >= CLASH_LEAST) & (F.col("y") >= CLASH_LEAST) & (F.col("a") != F.col("b")))
    ways = F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q"))))
    clash = both.select("book", ways.alias("w"), (F.col("x") + F.col("y")).alias("chapters")).select("book", F.col("w.p").alias("node"), F.lit("clash").alias("reason"), F.col("w.q").alias("other"), "chapters")
    return common.unionByName(alias).unionByName(clash)


def verdict(suitable: Column, decision: Column, plural: Column, proven: Column, everyday: Column, mismatch: Column) -> Column:
    """What a model's answer on a record comes to: no clear answer, its own request for review, an unproven plural, a fault, or passed."""
    asked = decision.isin("review", "lacks_context")
    return F.when(suitable.isNull(), "no_answer").when(asked, decision).when(plural & ~proven & suitable, "review").when(~suitable | (everyday & mismatch), "fault").otherwise("passed")


def text_ends(chapters: DataFrame, n: int = 5) -> DataFrame:
    """Context for the next chapter and names for its files: the last words, the slug and the head word of the title; a slug taken
    by an earlier url gets a number."""
    base = T.slug(F.concat_ws(" ", "title", "lang"), "paste")
    own = chapters.select("url", T.tail_words(F.col("source_text"), n).alias("tail"), base.alias("slug"), T.head_word(F.col("title")).alias("head"))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("url"))
    return own.withColumn("_n", nth).select("url", "tail", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "_n")).alias("slug"), "head")


_PARAS = "(SELECT concat(book, '/', chapter_no) AS id, CAST(book % 5 AS STRING) AS book, source_text AS en, CASE WHEN chapter_no % 2 = 0 THEN concat('ve Mirza ', lower(source_text)) ELSE source_text END AS tr FROM {pairs})"
_KNOWN = "(SELECT DISTINCT book, source, target FROM (SELECT '0' AS book, source, target FROM {terms} WHERE chapters >= 2 UNION ALL SELECT '1' AS book, source, target FROM {terms} WHERE chapters >= 2) k1)"
_TERMS = "(SELECT book, CASE WHEN chapters % 3 = 0 THEN concat(source, ' Beast') ELSE source END AS source, CASE WHEN chapters % 2 = 0 THEN concat(target, ' Canavar') WHEN chapters % 3 = 0 THEN concat(target, ' mahluk') ELSE target END AS target FROM {terms})"
_CLASSES = "(SELECT DISTINCT book, 'Beast' AS class, 'mahluk' AS word FROM {terms} UNION ALL SELECT DISTINCT book, 'Monster', 'canavar' FROM {terms})"
_NAMES = "(SELECT book, concat('p', chapter % 20) AS person, subject AS name, CASE WHEN id % 3 = 0 THEN subject ELSE concat(subject, 'x') END AS target FROM {claims})"
_CLAIMS = "(SELECT book, chapter, CASE WHEN id % 5 = 0 THEN 'common' WHEN id % 5 = 1 AND length(subject) > 2 THEN 'name' ELSE 'tie' END AS kind, subject, relation, concat('s', id % 30) AS object FROM {claims})"
_ANSWERS = "(SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE id % 3 > 0 END AS suitable, CASE WHEN id % 13 = 0 THEN 'review' ELSE 'none' END AS decision, id % 4 = 0 AS plural, id % 8 = 0 AS proven, id % 5 = 0 AS everyday, id % 2 = 0 AS mismatch FROM {claims})"
_ROLES = ("pairs", "terms", "claims", "chapters")


def _sql(s, d, text: str) -> DataFrame:
    return s.sql("SELECT * FROM " + text, **{name: role(s, d, name) for name in _ROLES if "{" + name + "}" in text})


def _duck(text: str) -> str:
    for name in _ROLES:
        text = text.replace("{" + name + "}", sql_role(name) + f" {name}_")
    return text.replace("AS STRING)", "AS VARCHAR)")


def _scripts(s, d):
    p = role(s, d, "pairs").select("book", "chapter_no", F.lit(0).cast("long").alias("para"), F.col("source_text").alias("en"), "translation")
    mark = F.when(F.col("chapter_no") % 4 == 1, " слово, ок").when(F.col("chapter_no") % 4 == 3, " 中文a").otherwise("")
    return p.select("book", "chapter_no", "para", F.concat("en", F.when(F.col("book") % 2 == 0, " слово").otherwise("")).alias("en"), F.concat("translation", mark).alias("tr"))


QUERIES = {
    "foreign_words": lambda s, d: foreign_words(_scripts(s, d)),
    "name_attributions": lambda s, d: attributions(_sql(s, d, _PARAS), _sql(s, d, _KNOWN)),
    "class_word_mixups": lambda s, d: class_word_mixups(_sql(s, d, _TERMS), _sql(s, d, _CLASSES)),
    "split_policies": lambda s, d: split_policies(_sql(s, d, _NAMES)),
    "claim_reasons": lambda s, d: claim_reasons(_sql(s, d, _CLAIMS), "rel_A", "rel_N"),
    "answer_verdicts": lambda s, d: _sql(s, d, _ANSWERS).groupBy(verdict(*map(F.col, ("suitable", "decision", "plural", "proven", "everyday", "mismatch"))).alias("verdict")).agg(F.count("*").alias("n")),
    "text_ends": lambda s, d: text_ends(role(s, d, "chapters")),
}
_q = lambda x: "'" + x.replace("'", "''") + "'"
_FOLD = lambda x: f"lower(regexp_replace(trim({x}), '[\\s\\-_''’.·]+', '', 'g'))"
_LOW = lambda x: f"lower(translate({x}, 'Iİ', 'ıi'))"
_W = "'[\\p{L}\\p{N}_]+'"
ORACLE = {
    "foreign_words": f"WITH p AS (SELECT book, chapter_no, concat(source_text, CASE WHEN book % 2 = 0 THEN ' слово' ELSE '' END) AS en, concat(translation, CASE chapter_no % 4 WHEN 1 THEN ' слово, ок' WHEN 3 THEN ' 中文a' ELSE '' END) AS tr FROM {sql_role('pairs')} x) SELECT * FROM (SELECT book, chapter_no, CAST(0 AS BIGINT) AS para, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(tr, '\\p{{L}}+')), lambda w: regexp_matches(w, '[^\\P{{L}}\\p{{Latin}}]') AND NOT list_contains(list_transform(regexp_extract_all(en, '\\p{{L}}+'), lambda v: lower(v)), lower(w)))), ',') AS words FROM p) q WHERE words <> ''",
    "name_attributions": _duck(f"WITH p AS (SELECT * FROM {_PARAS} p0), k AS (SELECT * FROM {_KNOWN} k0), e AS (SELECT DISTINCT id, book, unnest(list_filter(regexp_extract_all(en, '[\\p{{L}}\\p{{N}}_]+'), lambda v: regexp_matches(v, '^[A-Z][a-z]{{2,}}\\z'))) AS w FROM p), e1 AS (SELECT id, min(w) AS candidate FROM e WHERE w NOT IN ({', '.join(map(_q, NO_NAMES))}) AND NOT EXISTS (SELECT 1 FROM k WHERE k.book = e.book AND k.source = e.w) GROUP BY id HAVING count(DISTINCT w) = 1), t AS (SELECT id, book, en, t, unnest(range(2, len(t) + 1)) AS i FROM (SELECT id, book, en, regexp_extract_all(tr, {_q(_TOKENS)}) AS t FROM p) a), r AS (SELECT DISTINCT id, book, t[i] AS w FROM t WHERE regexp_matches(t[i], '^\\p{{Lu}}\\p{{L}}{{2,}}') AND NOT regexp_matches(t[i - 1], {_q(_ENDED)}) AND NOT contains(en, t[i])), r1 AS (SELECT id, min(w) AS other FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.book = r.book AND k.target = r.w) GROUP BY id HAVING count(DISTINCT w) = 1) SELECT e1.id, candidate, CASE WHEN contains(tr, candidate) THEN '=' ELSE other END AS rendering FROM e1 JOIN p ON e1.id = p.id LEFT JOIN r1 ON e1.id = r1.id WHERE contains(tr, candidate) OR other IS NOT NULL"),
    "class_word_mixups": _duck(f"WITH t AS (SELECT * FROM {_TERMS} t0 WHERE {_FOLD('source')} <> {_FOLD('target')}), c AS (SELECT DISTINCT book, lower(class) AS class, {_LOW('word')} AS word FROM {_CLASSES} c0), a AS (SELECT DISTINCT book, source, unnest(regexp_extract_all({_LOW('target')}, {_W})) AS word FROM t), b AS (SELECT DISTINCT book, source, unnest(regexp_extract_all(lower(source), {_W})) AS class FROM t) SELECT a.book, a.source, min(c.class) AS class FROM a JOIN c ON a.book = c.book AND a.word = c.word WHERE NOT EXISTS (SELECT 1 FROM b JOIN c x ON b.book = x.book AND b.class = x.class WHERE b.book = a.book AND b.source = a.source AND x.word = a.word) GROUP BY ALL"),
    "split_policies": _duck(f"SELECT book, person, array_to_string(list_sort(k), ',') AS kept, array_to_string(list_sort(t), ',') AS translated FROM (SELECT book, person, list(DISTINCT name) FILTER ({_FOLD('name')} = {_FOLD('target')}) AS k, list(DISTINCT name) FILTER ({_FOLD('name')} <> {_FOLD('target')}) AS t FROM {_NAMES} n GROUP BY ALL) q WHERE len(k) > 0 AND len(t) > 0"),
    "claim_reasons": _duck(f"WITH c AS (SELECT * FROM {_CLAIMS} c0), p AS (SELECT book, least(subject, object) AS a, greatest(subject, object) AS b, count(DISTINCT CASE WHEN relation = 'rel_A' THEN chapter END) AS x, count(DISTINCT CASE WHEN relation = 'rel_N' THEN chapter END) AS y FROM c WHERE kind = 'tie' AND relation IN ('rel_A', 'rel_N') GROUP BY ALL) SELECT book, subject AS node, 'common_word' AS reason, CAST(NULL AS VARCHAR) AS other, count(DISTINCT CASE WHEN kind = 'common' THEN chapter END) AS chapters FROM c GROUP BY book, subject HAVING count(DISTINCT CASE WHEN kind = 'common' THEN chapter END) >= 3 AND count(CASE WHEN kind = 'name' THEN 1 END) = 0 UNION ALL SELECT book, subject, 'alias', object, count(DISTINCT chapter) FROM c WHERE kind = 'name' AND object <> subject GROUP BY book, subject, object HAVING count(DISTINCT chapter) >= 2 UNION ALL SELECT book, unnest([a, b]), 'clash', unnest([b, a]), x + y FROM p WHERE x >= 2 AND y >= 2 AND a <> b"),
    "answer_verdicts": _duck(f"SELECT CASE WHEN suitable IS NULL THEN 'no_answer' WHEN decision IN ('review', 'lacks_context') THEN decision WHEN plural AND NOT proven AND suitable THEN 'review' WHEN NOT suitable OR (everyday AND mismatch) THEN 'fault' ELSE 'passed' END AS verdict, count(*) AS n FROM {_ANSWERS} a GROUP BY 1"),
    "text_ends": _duck("WITH c AS (SELECT url, array_to_string(w[greatest(len(w) - 5, 0) + 1:], ' ') AS tail, concat('paste-', regexp_replace(regexp_replace(lower(concat_ws(' ', title, lang)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, regexp_extract(regexp_replace(title, '(?i)\\s+of\\s.*$', ''), '(\\S+)\\s*$', 1) AS head FROM (SELECT *, list_filter(regexp_split_to_array(coalesce(source_text, ''), '\\s+'), lambda x: x <> '') AS w FROM {chapters}) a) SELECT url, tail, CASE WHEN n = 1 THEN slug ELSE concat(slug, '-', n) END AS slug, head FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY url) AS n FROM c) q"),
}
