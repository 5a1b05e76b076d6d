"""Dictionary governance: as-of views, masking, collisions, near spellings, candidates, stamps, imports, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms, turkish
from ..functions import text as T
from ..sources.tables import duck, role, shared, sql_role


def known_at(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms known by each chapter: those of unknown origin and those learned no later. Counts come from a running sum over the
    book's learning steps, so no chapter meets every term."""
    unknown = terms.where("first_chapter is null").groupBy("book").agg(F.count("*").alias("always"))
    steps = terms.where("first_chapter is not null").groupBy("book", F.col("first_chapter").alias("chapter_no")).agg(F.count("*").alias("learned"))
    points = chapters.where("chapter_no is not null").select("book", "chapter_no", F.col("url")).unionByName(steps.select("book", "chapter_no", F.lit(None).cast("string").alias("url")))
    joined = points.join(steps, ["book", "chapter_no"], "left")
    each = joined.withColumn("learned", F.when(F.col("url").isNull(), F.col("learned")).otherwise(0))
    upto = Window.partitionBy("book").orderBy("chapter_no").rangeBetween(Window.unboundedPreceding, 0)
    running = each.withColumn("n", F.sum("learned").over(upto)).where("url is not null")
    return running.join(unknown, "book", "left").select("url", (F.coalesce("n", F.lit(0)) + F.coalesce("always", F.lit(0))).alias("known"))


def visible(terms: DataFrame, as_of: int) -> DataFrame:
    """Rows a reader at a chapter may see; fields learned later are masked, and the hidden ones are listed."""
    seen = terms.where(F.col("first_chapter").isNull() | (F.col("first_chapter") <= as_of))
    shows = F.coalesce(F.col("note_chapter") <= as_of, F.lit(False))
    hidden = F.array_compact(F.array(F.when(F.col("note").isNotNull() & ~shows, "note"), F.when(F.col("condition").isNotNull() & ~F.coalesce(F.col("condition_chapter") <= as_of, F.lit(False)), "condition")))
    return seen.select("book", "source", "target", F.when(shows, F.col("note")).alias("note"), F.when(F.coalesce(F.col("condition_chapter") <= as_of, F.lit(False)), F.col("condition")).alias("condition"), F.concat_ws(",", hidden).alias("hidden"))


def effective(terms: DataFrame, spellings: DataFrame) -> DataFrame:
    """Approved rows and their other spellings, a spelling never overriding a row of its own; held rows are out."""
    rows = terms.where("status <> 'held'").select("book", "source", "target", F.lit(0).alias("_p"))
    other = spellings.join(terms.where("status <> 'held'").select("book", "source", "target"), ["book", "source"]).select("book", F.col("spelling").alias("source"), "target", F.lit(1).alias("_p"))
    ranked = rows.unionByName(other).withColumn("_r", F.row_number().over(Window.partitionBy("book", T.fold_term(F.col("source"))).orderBy("_p", "source", "target")))
    return ranked.where("_r = 1").select("book", "source", "target")


def collisions(terms: DataFrame) -> DataFrame:
    """Targets that several sources share under the fold; targets equal to their source are not counted."""
    t, s = T.fold_term(F.col("target")), T.fold_term(F.col("source"))
    return terms.where(t != s).groupBy("book", t.alias("key")).agg(F.countDistinct("source").alias("n"), F.min("source").alias("first"), F.max("source").alias("last")).where("n > 1")


def style_splits(terms: DataFrame, min_word: int = 3) -> DataFrame:
    """Words that stand with a capital in one target and without in another. Words of the very same terms are one finding, under the
    smallest of them."""
    words = terms.select("book", "source", F.explode(F.array_distinct(F.split("target", " "))).alias("word")).where(F.length("word") >= min_word)
    upper = F.substring("word", 1, 1) != F.lower(F.substring("word", 1, 1))
    split = words.groupBy("book", F.lower("word").alias("word")).agg(F.count(F.when(upper, 1)).alias("capital"), F.count(F.when(~upper, 1)).alias("small"), F.array_sort(F.collect_set("source")).alias("members")).where("capital > 0 and small > 0")
    return split.groupBy("book", "members").agg(F.min(F.struct("word", "capital", "small")).alias("x")).select("book", "x.word", "x.capital", "x.small")


def deletion_keys(x: Column) -> Column:
    """The word and every form with one letter left out: words one edit apart share a key."""
    n = F.length(x)
    return F.array_distinct(F.concat(F.array(x), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(x, 1, i - 1), F.expr("''"), F.substring(x, i + 1, n)))))


def near_terms(terms: DataFrame) -> DataFrame:
    """Pairs of one book one edit apart, by a blocking join on deletion keys and a check; digits and plurals are no slip."""
    folded = terms.select("book", "source", T.fold_term(F.col("source")).alias("f"))
    keys = folded.select("book", "source", "f", F.explode(deletion_keys(F.col("f"))).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    pairs = a.join(b, (F.col("a.book") == F.col("b.book")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.source") < F.col("b.source")))
    near = pairs.where((F.levenshtein(F.col("a.f"), F.col("b.f")) == 1) & (F.concat(F.col("a.f"), F.lit("s")) != F.col("b.f")) & (F.concat(F.col("b.f"), F.lit("s")) != F.col("a.f")))
    return near.select(F.col("a.book").alias("book"), F.col("a.source").alias("a"), F.col("b.source").alias("b")).distinct()


def softened(terms: DataFrame) -> DataFrame:
    """Pairs that differ only by hard and soft consonants: all such letters are masked and the masks joined by count, not in pairs."""
    mask = F.translate(T.fold_term(F.col("source")), "pbtdkgc", "ppttkkk")
    return terms.groupBy("book", mask.alias("mask")).agg(F.countDistinct("source").alias("n"), F.min("source").alias("first"), F.max("source").alias("last")).where("n > 1")


def softened_members(terms: DataFrame) -> DataFrame:
    """(book, mask, source): every name whose mask another name of the book shares, so that each pair can be read off."""
    masks = softened(terms).select("book", "mask")
    return terms.select("book", F.translate(T.fold_term(F.col("source")), "pbtdkgc", "ppttkkk").alias("mask"), "source").distinct().join(masks, ["book", "mask"], "left_semi")


def origin_chapter(text: Column, origin: Column) -> Column:
    """The chapter whose knowledge a field was written with, from its origin {"chapter": n, "digest": ...}: only while the digest is that of the
    field's text today, so an edit makes the origin unknown."""
    digest = F.substring(F.sha1(text.cast("binary")), 1, 16)
    known = (text != "") & (F.get_json_object(origin, "$.digest") == digest)
    return F.when(known, F.get_json_object(origin, "$.chapter").try_cast("int"))


def masked_by_origin(terms: DataFrame, as_of: int | None) -> DataFrame:
    """(book, source, target, condition, definition, note, hidden): what a reader at a chapter may see. Terms learned later are left out, unknown
    ones stay; a condition or definition shows only if its origin is known and read by then; a checker's note never shows. `hidden`
    lists the fields that are masked, in this order. Without a chapter all is shown."""
    fields = ("condition", "definition")
    if as_of is None:
        return terms.select("book", "source", "target", *fields, "note", F.lit("").alias("hidden"))
    shown = {c: F.coalesce(origin_chapter(F.col(c), F.col(f"{c}_origin")) <= as_of, F.lit(False)) for c in fields}
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    hidden = F.array_compact(F.array(*[F.when(there(c) & ~shown[c], F.lit(c)) for c in fields], F.when(there("note"), F.lit("note"))))
    seen = terms.where(F.col("first_chapter").isNull() | (F.col("first_chapter") <= as_of))
    return seen.select("book", "source", "target", *[F.when(~there(c) | shown[c], F.col(c)).alias(c) for c in fields], F.when(~there("note"), F.col("note")).alias("note"), F.concat_ws(",", hidden).alias("hidden"))


def variant_key(source: Column) -> Column:
    """Names that differ by a leading article, by `of the` for `of` or by an inner possessive share it."""
    bare = F.regexp_replace(F.trim(source), r"(?i)^(?:the|a|an)\s+", "")
    return T.fold_term(F.regexp_replace(F.regexp_replace(bare, r"(?i)\bof\s+the\b", "of"), r"(?i)['’]s\b", ""))


def new_candidates(candidates: DataFrame, terms: DataFrame, spellings: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates whose key is neither registered, nor another spelling of what is, nor rejected or a harmless variant of what was
    rejected; of equal keys the first spelling stays."""
    key = T.fold_term(F.col("source")).alias("key")
    taken = terms.select("book", key).union(spellings.select("book", T.fold_term(F.col("spelling")).alias("key"))).union(rejected.select("book", key)).distinct()
    refused = rejected.select("book", variant_key(F.col("source")).alias("_variant")).distinct()
    open_ = candidates.select("book", "source", key, variant_key(F.col("source")).alias("_variant")).join(taken, ["book", "key"], "left_anti").join(refused, ["book", "_variant"], "left_anti")
    return open_.groupBy("book", "key").agg(F.min("source").alias("source"), F.count("*").alias("spellings"))


def stamp_differences(stamps: DataFrame, terms: DataFrame) -> DataFrame:
    """Stamped targets against today's dictionary: changed or gone, nulls compared as values."""
    now = terms.select("book", "source", F.col("target").alias("now"))
    return stamps.join(now, ["book", "source"], "left").where(~F.col("stamped").eqNullSafe(F.col("now"))).select("url", "book", "source", "stamped", "now")


def imported(mine: DataFrame, theirs: DataFrame, file_wins: bool) -> DataFrame:
    """Union by key: the file's fields win or only fill gaps. A field absent from the file is no null of the file."""
    f = theirs.select("book", "source", F.col("target").alias("_t"), F.col("note").alias("_n"), F.col("has_note").alias("_h"))
    joined = mine.select("book", "source", "target", "note").join(f, ["book", "source"], "full_outer")
    if file_wins:
        note = F.when(F.coalesce("_h", F.lit(False)), F.col("_n")).otherwise(F.col("note"))
        return joined.select("book", "source", F.coalesce("_t", "target").alias("target"), note.alias("note"))
    return joined.select("book", "source", F.coalesce("target", "_t").alias("target"), F.coalesce("note", "_n").alias("note"))


def problem_terms(findings: DataFrame, terms: DataFrame, until: int, window: int = 30, at_least: int = 2) -> DataFrame:
    """Terms with findings in at least two of the last chapters whose stored target is still today's; the newest row of a chapter counts."""
    newest = findings.groupBy("book", "chapter_no", "source").agg(F.max_by("stored", "told").alias("stored"))
    last = newest.where((F.col("chapter_no") > until - window) & (F.col("chapter_no") <= until))
    same = last.join(terms.select("book", "source", "target"), ["book", "source"]).where("stored = target")
    return same.groupBy("book", "source").agg(F.countDistinct("chapter_no").alias("chapters")).where(F.col("chapters") >= at_least)


def coverage(terms: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Share of rows whose origin is known, and whether it passes."""
    out = terms.groupBy("book").agg(F.count("*").alias("total"), F.count("first_chapter").alias("known")).withColumn("ratio", F.round(F.col("known") / F.col("total"), 6))
    return out.withColumn("enough", F.col("ratio") >= threshold)


def screened(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Cascade: the first rule that fails names the status."""
    have = terms.select("book", T.fold_term(F.col("source")).alias("key"), F.lit(True).alias("registered")).distinct()
    c = candidates.withColumn("key", T.fold_term(F.col("source"))).join(have, ["book", "key"], "left")
    status = F.when(F.length("source") < 6, "too_short").when(F.col("registered"), "registered").when(F.col("lower_uses") >= 5, "ordinary_word").when(F.col("chapters") < 2, "one_chapter").otherwise("accepted")
    return c.groupBy("book", status.alias("status")).agg(F.count("*").alias("n"))


def term_hits(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """Which registered words each chapter holds, by token equi-join instead of a pattern per term: chapters' distinct words meet
    the book's terms on the folded word."""
    tokens = chapters.select("url", "book", F.explode(F.array_distinct(T.words(F.col("source_text")))).alias("word"))
    return tokens.join(terms.select("book", F.col("source").alias("word")), ["book", "word"]).groupBy("url", "book").agg(F.count("*").alias("terms"), F.min("word").alias("first"), F.max("word").alias("last"))


def preregistered(chapters: DataFrame, terms: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(book, source, before, first, held, early): chapters before a term was registered that hold it already, the first of them, and how
    many translations of them hold its target with any ending; registered late where those are `least` or more and have the share.
    What a chapter holds comes back to its translation as one array."""
    tokens = chapters.where("chapter_no is not null").select("url", "book", "chapter_no", F.explode(F.array_distinct(T.words(F.col("source_text")))).alias("source"))
    told = tokens.join(terms, ["book", "source"]).where("chapter_no < registered_at").groupBy("url", "book", "chapter_no").agg(F.collect_list(F.struct("source", "target")).alias("found"))
    rows = forms.once(told.join(chapters.select("url", "translation"), "url"), _t=turkish.tokens(F.col("translation")))
    each = rows.select("url", "book", "chapter_no", F.inline(F.transform("found", lambda f: F.struct(f["source"].alias("source"), turkish.stands(F.col("_t"), f["target"]).alias("held")))))
    out = each.groupBy("book", "source").agg(F.countDistinct("url").alias("before"), F.min("chapter_no").alias("first"), F.countDistinct(F.when(F.col("held"), F.col("url"))).alias("held"))
    return out.withColumn("early", (F.col("before") >= least) & (F.col("held") >= share * F.col("before")))


def back_translation(pairs: DataFrame) -> DataFrame:
    """Overlap of the distinct words on both sides."""
    return pairs.select("book", "chapter_no", F.round(T.jaccard(F.array_distinct(T.words(F.lower("source_text"))), F.array_distinct(T.words(F.lower("translation")))), 6).alias("overlap"))


def folds(terms: DataFrame) -> DataFrame:
    s = F.col("source")
    return terms.select("book", "source", T.fold_term(s).alias("fold"), T.normalise_source(F.concat(F.lit("“"), s, F.lit("'s!"))).alias("clean"), T.turkish_lower(s).alias("tr"), T.plain_letters(s).alias("plain"))


def _terms(s, d):
    return role(s, d, "terms")


def _registered(s, d):
    """Where candidates meet a dictionary: the words of two chapters or more are in it."""
    return role(s, d, "terms").where("chapters >= 2")


def _rich(df):
    n = F.length("source")
    return df.select("*", F.when(n % 2 == 0, F.concat(F.lit("note on "), "source")).alias("note"), (F.col("first_chapter") + n % 5).alias("note_chapter"), F.when(n % 3 == 0, F.lit("if named")).alias("condition"), (F.col("first_chapter") + n % 7).alias("condition_chapter"), F.when(n % 6 == 5, "held").otherwise("approved").alias("status"))


def _spellings(df):
    return df.where("length(source) % 4 = 1").select("book", "source", F.concat("source", F.lit("-x")).alias("spelling"))


def _candidates(s, d):
    return role(s, d, "terms").select("book", "source", "chapters", (F.length("source") * 7 % 9).alias("lower_uses"))


def _theirs(df):
    return df.where("length(source) % 3 <> 1").select("book", "source", F.upper("target").alias("target"), F.when(F.length("source") % 2 == 1, F.lit("theirs")).alias("note"), (F.length("source") % 5 > 1).alias("has_note"))


def _findings(s, d):
    c = role(s, d, "chapters").where("chapter_no is not null")
    words = c.select("book", "chapter_no", F.col("created_at").alias("told"), F.explode(F.array_distinct(F.regexp_extract_all("source_text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))).alias("source"))
    return words.select("*", F.when(F.length("source") % 3 == 0, F.lit("old")).otherwise(F.lower(F.reverse("source"))).alias("stored"))


#: Terms with fields and their origins: of today's text, of an earlier one, without a digest, broken, or none.
_ORIGINS = """(SELECT *, concat('{{"chapter": ', CASE WHEN first_chapter IS NULL THEN 'null' ELSE CAST(first_chapter + chapters % 6 AS VARCHAR(9)) END, ', "digest": "', substring(sha1({b1}), 1, 16), '"}}') AS condition_origin,
  CASE length(source) % 4 WHEN 0 THEN concat('{{"chapter": 3, "digest": "', substring(sha1({b2}), 1, 16), '"}}') WHEN 1 THEN '{{"chapter": 3}}' WHEN 2 THEN 'not json' END AS definition_origin
  FROM (SELECT book, source, target, first_chapter, chapters, CASE WHEN length(source) % 3 > 0 THEN concat('as ', source) END AS condition, concat('one of ', target) AS definition, CASE WHEN chapters % 7 = 0 THEN 'checked' END AS note FROM {terms}) t)"""
_SPARK_BYTES = {"{b1}": "CAST(concat(coalesce(condition, ''), CASE WHEN chapters % 5 = 0 THEN '!' ELSE '' END) AS BINARY)", "{b2}": "CAST(definition AS BINARY)"}
_DUCK_BYTES = {"{b1}": "concat(coalesce(condition, ''), CASE WHEN chapters % 5 = 0 THEN '!' ELSE '' END)", "{b2}": "definition"}


def _origins(parts: dict[str, str]) -> str:
    return _ORIGINS.replace("{b1}", parts["{b1}"]).replace("{b2}", parts["{b2}"])


QUERIES = {
    "softened_members": lambda s, d: softened_members(role(s, d, "terms")),
    "origin_masked": lambda s, d: masked_by_origin(shared(s, d, _origins(_SPARK_BYTES)), 20),
    "dict_known_at": lambda s, d: known_at(role(s, d, "chapters"), _terms(s, d)),
    "spoiler_rows": lambda s, d: visible(_rich(_terms(s, d)), 20),
    "effective_dictionary": lambda s, d: effective(_rich(_terms(s, d)), _spellings(_terms(s, d))),
    "target_collisions": lambda s, d: collisions(role(s, d, "terms").withColumn("target", F.substring("target", 1, 4))),
    "sibling_style": lambda s, d: style_splits(role(s, d, "terms").withColumn("target", F.when(F.length("source") % 2 == 0, F.initcap(F.substring("target", 1, 5))).otherwise(F.substring("target", 1, 5)))),
    "near_terms": lambda s, d: near_terms(_terms(s, d)),
    "softened_pairs": lambda s, d: softened(role(s, d, "terms")),
    "candidate_antijoin": lambda s, d: new_candidates(_candidates(s, d), _registered(s, d), _spellings(role(s, d, "terms").where("length(source) % 5 = 1")), role(s, d, "terms").where("length(source) = 7")),
    "stamp_diff": lambda s, d: stamp_differences(_findings(s, d).select(F.concat("book", F.lit("/"), "chapter_no").alias("url"), "book", "source", F.col("stored").alias("stamped")), _registered(s, d)),
    "import_file_wins": lambda s, d: imported(_rich(_terms(s, d)), _theirs(role(s, d, "terms")), True),
    "import_keep_mine": lambda s, d: imported(_rich(_terms(s, d)), _theirs(role(s, d, "terms")), False),
    "problem_terms": lambda s, d: problem_terms(_findings(s, d), _terms(s, d), 40),
    "coverage_ratio": lambda s, d: coverage(role(s, d, "terms")),
    "candidate_screen": lambda s, d: screened(_candidates(s, d), role(s, d, "terms").where("chapters >= 3")),
    "term_hits": lambda s, d: term_hits(role(s, d, "chapters"), _terms(s, d)),
    "pre_registration": lambda s, d: preregistered(role(s, d, "chapters"), _terms(s, d).select("book", "source", F.when(F.length("source") % 2 == 0, F.lower(F.substring("source", 1, 4))).otherwise(F.col("target")).alias("target"), (F.col("first_chapter") + 10).alias("registered_at"))),
    "jaccard_backtranslation": lambda s, d: back_translation(role(s, d, "pairs")),
    "term_folds": lambda s, d: folds(role(s, d, "terms")),
}
_C, _ALL = sql_role("chapters"), sql_role("terms")
_T, _REGISTERED = f"(SELECT * FROM {_ALL} a)", f"(SELECT * FROM {_ALL} a WHERE chapters >= 2)"
_RICH = f"(SELECT *, CASE WHEN length(source) % 2 = 0 THEN 'note on ' || source END AS note, first_chapter + length(source) % 5 AS note_chapter, CASE WHEN length(source) % 3 = 0 THEN 'if named' END AS condition, first_chapter + length(source) % 7 AS condition_chapter, CASE WHEN length(source) % 6 = 5 THEN 'held' ELSE 'approved' END AS status FROM {_T} t)"
_F = lambda x: f"lower(regexp_replace(trim({x}), '[\\s\\-_''’.·]+', '', 'g'))"
_FIND = f"(SELECT book, chapter_no, told, source, CASE WHEN length(source) % 3 = 0 THEN 'old' ELSE lower(reverse(source)) END AS stored FROM (SELECT book, chapter_no, created_at AS told, unnest(list_distinct(regexp_extract_all(source_text, '[A-Z][a-z]{{4,}}'))) AS source FROM {_C} c WHERE chapter_no IS NOT NULL) w)".replace("{{", "{").replace("}}", "}")
_VARIANT = _F("regexp_replace(regexp_replace(regexp_replace(trim(source), '(?i)^(?:the|a|an)\\s+', ''), '(?i)\\bof\\s+the\\b', 'of', 'g'), '(?i)[''’]s\\b', '', 'g')")
_THEIRS = f"(SELECT book, source, upper(target) AS t, CASE WHEN length(source) % 2 = 1 THEN 'theirs' END AS n, length(source) % 5 > 1 AS h FROM {_ALL} a WHERE length(source) % 3 <> 1)"
_WORDS = "list_distinct(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'))"
_SHOWN = lambda c: f"({c} <> '' AND CASE WHEN json_valid({c}_origin) THEN json_extract_string({c}_origin, '$.digest') = substring(sha1({c}), 1, 16) AND TRY_CAST(json_extract_string({c}_origin, '$.chapter') AS INT) <= 20 END)"
ORACLE = {
    "softened_members": f"WITH m AS (SELECT DISTINCT book, translate({_F('source')}, 'pbtdkgc', 'ppttkkk') AS mask, source FROM {_ALL} a) SELECT * FROM m WHERE EXISTS (SELECT 1 FROM m o WHERE o.book = m.book AND o.mask = m.mask AND o.source <> m.source)",
    "origin_masked": f"""SELECT book, source, target, CASE WHEN coalesce({_SHOWN('condition')}, false) THEN condition END AS condition, CASE WHEN coalesce({_SHOWN('definition')}, false) THEN definition END AS definition, CAST(NULL AS VARCHAR) AS note,
  concat_ws(',', CASE WHEN condition <> '' AND NOT coalesce({_SHOWN('condition')}, false) THEN 'condition' END, CASE WHEN definition <> '' AND NOT coalesce({_SHOWN('definition')}, false) THEN 'definition' END, CASE WHEN note <> '' THEN 'note' END) AS hidden
  FROM {duck(_origins(_DUCK_BYTES))} t WHERE first_chapter IS NULL OR first_chapter <= 20""",
    "dict_known_at": f"WITH t AS (SELECT * FROM {_T} q) SELECT c.url, (SELECT count(*) FROM t WHERE t.book = c.book AND (t.first_chapter IS NULL OR t.first_chapter <= c.chapter_no)) AS known FROM {_C} c WHERE c.chapter_no IS NOT NULL",
    "spoiler_rows": f"SELECT book, source, target, CASE WHEN note_chapter <= 20 THEN note END AS note, CASE WHEN condition_chapter <= 20 THEN condition END AS condition, concat_ws(',', CASE WHEN note IS NOT NULL AND NOT coalesce(note_chapter <= 20, false) THEN 'note' END, CASE WHEN condition IS NOT NULL AND NOT coalesce(condition_chapter <= 20, false) THEN 'condition' END) AS hidden FROM {_RICH} r WHERE first_chapter IS NULL OR first_chapter <= 20",
    "effective_dictionary": f"WITH r AS (SELECT * FROM {_RICH} x), u AS (SELECT book, source, target, 0 AS p FROM r WHERE status <> 'held' UNION ALL SELECT book, source || '-x', target, 1 FROM r WHERE status <> 'held' AND length(source) % 4 = 1) SELECT book, source, target FROM (SELECT *, row_number() OVER (PARTITION BY book, {_F('source')} ORDER BY p, source, target) AS n FROM u) q WHERE n = 1",
    "target_collisions": f"SELECT book, {_F('target')} AS key, count(DISTINCT source) AS n, min(source) AS first, max(source) AS last FROM (SELECT book, source, substring(target, 1, 4) AS target FROM {_ALL} a) b WHERE {_F('target')} <> {_F('source')} GROUP BY 1, 2 HAVING count(DISTINCT source) > 1",
    "sibling_style": f"SELECT book, word, capital, small FROM (SELECT *, row_number() OVER (PARTITION BY book, members ORDER BY word) AS r FROM (SELECT book, lower(w) AS word, count(CASE WHEN up THEN 1 END) AS capital, count(CASE WHEN NOT up THEN 1 END) AS small, list_sort(list(DISTINCT source)) AS members FROM (SELECT book, source, w, substring(w, 1, 1) <> lower(substring(w, 1, 1)) AS up FROM (SELECT book, source, CASE WHEN length(source) % 2 = 0 THEN upper(substring(target, 1, 1)) || substring(target, 2, 4) ELSE substring(target, 1, 5) END AS w FROM {_ALL} a) b WHERE length(w) >= 3) c GROUP BY 1, 2 HAVING count(CASE WHEN up THEN 1 END) > 0 AND count(CASE WHEN NOT up THEN 1 END) > 0) d) e WHERE r = 1",
    "near_terms": f"WITH t AS (SELECT book, source, {_F('source')} AS f FROM {_T} q) SELECT DISTINCT a.book, a.source AS a, b.source AS b FROM t a JOIN t b ON a.book = b.book AND a.source < b.source WHERE levenshtein(a.f, b.f) = 1 AND a.f || 's' <> b.f AND b.f || 's' <> a.f",
    "softened_pairs": f"SELECT book, translate({_F('source')}, 'pbtdkgc', 'ppttkkk') AS mask, count(DISTINCT source) AS n, min(source) AS first, max(source) AS last FROM {_ALL} a GROUP BY 1, 2 HAVING count(DISTINCT source) > 1",
    "candidate_antijoin": f"WITH a AS (SELECT *, {_F('source')} AS key, {_VARIANT} AS v FROM {_ALL} x), taken AS (SELECT book, key FROM a WHERE chapters >= 2 UNION SELECT book, {_F("concat(source, '-x')")} FROM a WHERE length(source) % 5 = 1 AND length(source) % 4 = 1 UNION SELECT book, key FROM a WHERE length(source) = 7) SELECT book, key, min(source) AS source, count(*) AS spellings FROM a WHERE (book, key) NOT IN (SELECT (book, key) FROM taken) AND (book, v) NOT IN (SELECT (book, v) FROM a WHERE length(source) = 7) GROUP BY book, key",
    "stamp_diff": f"SELECT f.book || '/' || f.chapter_no AS url, f.book, f.source, f.stored AS stamped, t.target AS now FROM {_FIND} f LEFT JOIN {_REGISTERED} t ON f.book = t.book AND f.source = t.source WHERE f.stored IS DISTINCT FROM t.target",
    "import_file_wins": f"SELECT coalesce(m.book, f.book) AS book, coalesce(m.source, f.source) AS source, coalesce(t, target) AS target, CASE WHEN coalesce(h, false) THEN n ELSE note END AS note FROM {_RICH} m FULL JOIN {_THEIRS} f ON m.book = f.book AND m.source = f.source",
    "import_keep_mine": f"SELECT coalesce(m.book, f.book) AS book, coalesce(m.source, f.source) AS source, coalesce(target, t) AS target, coalesce(note, n) AS note FROM {_RICH} m FULL JOIN {_THEIRS} f ON m.book = f.book AND m.source = f.source",
    "problem_terms": f"SELECT n.book, n.source, count(DISTINCT chapter_no) AS chapters FROM (SELECT book, chapter_no, source, arg_max(stored, told) AS stored FROM {_FIND} f WHERE chapter_no > 10 AND chapter_no <= 40 GROUP BY ALL) n JOIN {_T} t ON n.book = t.book AND n.source = t.source WHERE stored = target GROUP BY 1, 2 HAVING count(DISTINCT chapter_no) >= 2",
    "coverage_ratio": f"SELECT *, ratio >= 0.8 AS enough FROM (SELECT book, count(*) AS total, count(first_chapter) AS known, round(count(first_chapter) / count(*), 6) AS ratio FROM {_ALL} a GROUP BY book) b",
    "candidate_screen": f"WITH a AS (SELECT *, {_F('source')} AS key FROM {_ALL} x) SELECT book, CASE WHEN length(source) < 6 THEN 'too_short' WHEN (book, key) IN (SELECT (book, key) FROM a WHERE chapters >= 3) THEN 'registered' WHEN length(source) * 7 % 9 >= 5 THEN 'ordinary_word' WHEN chapters < 2 THEN 'one_chapter' ELSE 'accepted' END AS status, count(*) AS n FROM a GROUP BY 1, 2",
    "term_hits": f"SELECT url, w.book, count(*) AS terms, min(word) AS first, max(word) AS last FROM (SELECT url, book, unnest({_WORDS.format('source_text')}) AS word FROM {_C} c) w JOIN {_T} t ON w.book = t.book AND w.word = t.source GROUP BY ALL",
    "pre_registration": f"""WITH t AS (SELECT book, source, CASE WHEN length(source) % 2 = 0 THEN lower(substring(source, 1, 4)) ELSE target END AS target, first_chapter + 10 AS at_ FROM {_T} q), h AS (SELECT w.url, w.book, w.chapter_no, w.source, t.target FROM (SELECT url, book, chapter_no, unnest({_WORDS.format('source_text')}) AS source FROM {_C} c WHERE chapter_no IS NOT NULL) w JOIN t ON w.book = t.book AND w.source = t.source WHERE chapter_no < at_),
k AS (SELECT url, unnest({turkish.sql_tokens('translation')}) AS w FROM {_C} c), p AS (SELECT DISTINCT h.url, h.source FROM h JOIN k ON k.url = h.url AND (starts_with(k.w, h.target) OR ({turkish.sql_softened('k.w', 'h.target')})))
SELECT book, source, before, first, held, before >= 2 AND held >= 0.5 * before AS early FROM (SELECT h.book, h.source, count(DISTINCT h.url) AS before, min(chapter_no) AS first, count(DISTINCT p.url) AS held FROM h LEFT JOIN p ON p.url = h.url AND p.source = h.source GROUP BY 1, 2) g""",
    "jaccard_backtranslation": f"SELECT book, chapter_no, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS overlap FROM (SELECT book, chapter_no, {_WORDS.format('lower(source_text)')} AS a, {_WORDS.format('lower(translation)')} AS b FROM {sql_role('pairs')} p) q",
    "term_folds": f"SELECT book, source, {_F('source')} AS fold, source AS clean, lower(translate(source, 'Iİ', 'ıi')) AS tr, translate(lower(translate(source, 'Iİ', 'ıi')), 'ığüşöçâîû', 'igusocaiu') AS plain FROM {_ALL} a",
}
