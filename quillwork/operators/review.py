"""Review of dictionary rows and model proposals: the gate's reasons, everyday words, nested terms, families, categories, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms
from ..functions import text as T
from ..plans.components import components, reliable
from ..sources.tables import role, sql_role
from .glossary import near_terms

# Case endings after an apostrophe, English function words that no Turkish target has, number words that a Turkish
# singular may follow, marks after which a capital letter says nothing, phrases that only suppose, and thresholds.
CASE_END = r"(?i)['’](?:[ıiuü]|[sy][ıiuü]|n[ıiuü]n|[ıiuü]n|[dt][ae]n?|[ae]|y[ae]|[dt][ae]ki|l[ae]r[ıi])\z"
ENGLISH = ("the", "and", "of", "what", "wait", "is", "are", "was", "were", "my", "your", "his", "her", "their", "with", "from")
COUNTED = r"(?i)^(?:[0-9]+|two|three|four|five|six|seven|eight|nine|ten|hundred|thousand)\s"
SAYS_NOTHING = r""".!?"“”'’:"""
SUPPOSED = r"(?:^|[^\p{L}\p{N}_])(?:if|were to|would have|could have|might|perhaps|as if|as though|suppose)(?:\z|[^\p{L}\p{N}_])"
NEAR_LENGTH, LEAST_LOWER, LEAST_QUOTE, LEAST_CONFIDENCE, BROKEN_SHARE, BROKEN_LEAST = 7, 5, 8, 0.6, 0.5, 4

_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_PLURAL_SOURCE = r"(?i)[a-z]{2}[a-rt-z]s\z"
_PLURAL_TARGET = r"(?i)l[ae]r[ıi]?\z"
_MID_A, _MID_B = r"^\s{1,2}\z", rf"[^\s{SAYS_NOTHING}]\s{{0,2}}\z"
_SMALL = r"(?<![\p{L}\p{N}_])\p{L}[\p{L}\p{N}_]*"
#: A word within a sentence: after one or two blanks that follow a word, or after a mark that ends nothing and two blanks at most.
_MID = rf"(?:(?<=[\p{{L}}\p{{N}}_]\s{{1,2}})|(?<=[^\s{SAYS_NOTHING}\p{{L}}\p{{N}}_]\s{{0,2}}))(?<![\p{{L}}\p{{N}}_])\p{{L}}[\p{{L}}\p{{N}}_]*"
_NAME = r"(?<![\p{L}\p{N}_])[A-Z][\p{L}\p{N}_]*"
#: What a text says between two names of one being, white space as one space: a naming, a statement, or a mark of apposition.
CALLED = tuple(f"{comma} {also}{word} as" for comma in ("", ",") for also in ("", "also ") for word in ("known", "called"))
STATED = (" was", " is", " had been")
MARKS = ("—", "–", "-")
CONNECTORS = frozenset((
    *(f", {the}" for the in ("", "the ")),
    *(f"{c} {the}" for c in CALLED for the in ("", "the ")),
    *(f"{s} {the}" for s in STATED for the in ("the ", "also the ")),
    *(f"{before}{mark}{after}" for mark in MARKS for before in ("", " ") for after in ("", " ", "the ", " the ")),
))
_TURKISH = r"[çğıöşüÇĞİÖŞÜ]"


def _kept() -> Column:
    return T.fold_term(F.col("source")) == T.fold_term(F.col("target"))


def nested(terms: DataFrame) -> DataFrame:
    """(book, source, within): terms whose words stand in a row inside a longer term. Every shorter run of a term's words is a key,
    so the join is an equi-join; a term of n words has n(n+1)/2 keys."""
    words = F.split(F.lower("source"), " ")
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))))
    long = terms.select("book", F.col("source").alias("within"), words.alias("w")).where(F.size("w") > 1)
    keys = long.select("book", "within", F.explode(F.array_distinct(runs(F.col("w")))).alias("key"))
    return keys.join(terms.select("book", "source", F.lower("source").alias("key")), ["book", "key"]).select("book", "source", "within").distinct()


def gate(terms: DataFrame, forbidden: DataFrame, policies: DataFrame) -> DataFrame:
    """(book, source, reasons) of the terms(book, source, target, kind) that some rule stops, reasons sorted and comma-joined.

    Rows that keep their English name are free of the rules on targets. forbidden(book, target) meets targets by fold, and
    policies(book, kind, rule) ask a kind to be kept or translated."""
    terms = reliable(terms.select("book", "source", "target", "kind"))  # ten rules read it, and what it is made of is read once
    t = terms.withColumn("kept", _kept()).withColumn("key", T.fold_term(F.col("target")))
    plural, many = F.col("source").rlike(_PLURAL_SOURCE), F.col("target").rlike(_PLURAL_TARGET)
    english = F.size(F.array_intersect(T.words(F.lower("target")), F.array(*map(F.lit, ENGLISH)))) > 0
    free = ~F.col("kept")
    rules = {
        "plural_form": plural,
        "english_possessive": free & F.col("target").rlike(r"(?i)['’]s(?:\z|[^\p{L}\p{N}_])"),
        "case_ending": free & F.col("target").rlike(CASE_END),
        "english_word": free & english,
        "number": free & ((~plural & many) | (plural & ~many & ~F.col("source").rlike(COUNTED))),
    }
    own = t.select("book", "source", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("reason"))
    shared = t.where(free).groupBy("book", "key").agg(F.countDistinct("source").alias("n")).where("n > 1").select("book", "key")
    clash = t.where(free).join(shared, ["book", "key"], "left_semi").select("book", "source", F.lit("collision").alias("reason"))
    banned = forbidden.select("book", T.fold_term(F.col("target")).alias("key")).distinct()
    barred = t.where(free).join(banned, ["book", "key"], "left_semi").select("book", "source", F.lit("forbidden").alias("reason"))
    inside = nested(terms).join(t.where(free).select("book", "source"), ["book", "source"], "left_semi").select("book", F.col("within").alias("source"))
    torn = inside.join(t.where("kept").select("book", "source"), ["book", "source"], "left_semi").select("book", "source", F.lit("part_conflict").alias("reason"))
    slips = near_terms(terms.where(F.length(T.fold_term(F.col("source"))) >= NEAR_LENGTH).select("book", "source").distinct())
    near = slips.select("book", F.explode(F.array("a", "b")).alias("source"), F.lit("near_spelling").alias("reason"))
    off = t.join(policies.select("book", "kind", "rule"), ["book", "kind"]).where((F.col("rule") == "keep") != F.col("kept")).select("book", "source", F.lit("policy").alias("reason"))
    every = own.unionByName(clash).unionByName(barred).unionByName(torn).unionByName(near).unionByName(off)
    return every.groupBy("book", "source").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def case_profile(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """(book, source, lower_uses, upper_mid, ordinary) of one-word terms: how often the book writes the word small, and how often
    with a capital in mid-sentence; ordinary words are small five times or more and no less often than not. Two patterns pick the
    words that count, so no list of all words and marks is built; they are counted map-side per book before the terms join. A
    term that no text has has none of either."""
    told = chapters.where("source_text is not null")
    found = lambda pattern: F.explode(F.regexp_extract_all("source_text", F.lit(pattern), F.lit(0))).alias("w")
    small, mid = told.select("book", found(_SMALL)), told.select("book", found(_MID))
    counted = lambda words, name: words.groupBy("book", F.lower("w").alias("key")).agg(F.count("*").alias(name))
    per = counted(small.where("w = lower(w)"), "lower_uses").join(counted(mid.where("w <> lower(w)"), "upper_mid"), ["book", "key"], "full_outer")
    asked = F.regexp_extract("source", r"^[\p{L}\p{N}_]+$", 0) != ""
    out = terms.where(asked).select("book", "source", F.lower("source").alias("key")).distinct().join(per, ["book", "key"], "left").na.fill(0, ["lower_uses", "upper_mid"])
    return out.select("book", "source", "lower_uses", "upper_mid", ((F.col("lower_uses") >= LEAST_LOWER) & (F.col("lower_uses") >= F.col("upper_mid"))).alias("ordinary"))


def family_minority(terms: DataFrame, least: int = 3, ending: int = 3) -> DataFrame:
    """Members of a family (terms of one first word) whose target begins with another form of the family's usual first word: one
    is the other with an ending. The usual one is the commonest, ties by the smaller word."""
    f = terms.where(F.col("source").contains(" ")).select("book", F.lower(F.substring_index("source", " ", 1)).alias("family"), "source", "target", F.lower(F.substring_index("target", " ", 1)).alias("head"))
    heads = f.groupBy("book", "family", "head").agg(F.count("*").alias("n"))
    usual = heads.groupBy("book", "family").agg(F.sum("n").alias("members"), F.min(F.struct((-F.col("n")).alias("n"), "head")).alias("x")).where(F.col("members") >= least).select("book", "family", "members", F.col("x.head").alias("usual"))
    alike = (F.abs(F.length("head") - F.length("usual")) <= ending) & (F.col("head").startswith(F.col("usual")) | F.col("usual").startswith(F.col("head")))
    return f.join(usual, ["book", "family"]).where((F.col("head") != F.col("usual")) & alike).select("book", "family", "source", "target", "usual", "members")


def _singular(w: Column) -> Column:
    return F.when(F.length(w) > 3, F.regexp_replace(w, r"s\z", "")).otherwise(w)


def categories(nodes: DataFrame, edges: DataFrame, profile: DataFrame, relation: str = "class", least: int = 2, at: int = 2) -> DataFrame:
    """(book, name, reason) of nodes that are kinds and not beings: listed by profile(book, name), object of the relation in `at`
    edges or more, or made of two words or more that all come from such names."""
    objects = edges.where(F.col("relation") == relation).groupBy("book", F.col("dst").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= at)
    named = profile.select("book", "name", F.lit("listed").alias("reason")).unionByName(objects.select("book", "name", F.lit("object").alias("reason"))).groupBy("book", "name").agg(F.min("reason").alias("reason"))
    split = lambda c: F.split(F.lower(c), " ")
    words = named.select("book", F.explode(split("name")).alias("w")).select("book", _singular(F.col("w")).alias("w")).distinct()
    parts = nodes.select("book", "name", split("name").alias("ws")).distinct().where(F.size("ws") >= least)
    known = parts.select("book", "name", F.size("ws").alias("n"), F.explode("ws").alias("w")).withColumn("w", _singular(F.col("w"))).join(words, ["book", "w"], "left_semi")
    made = known.groupBy("book", "name", "n").agg(F.count("*").alias("hits")).where("hits = n").select("book", "name", F.lit("compound").alias("reason"))
    direct = nodes.select("book", "name").distinct().join(named, ["book", "name"])
    return direct.unionByName(made).groupBy("book", "name").agg(F.max("reason").alias("reason"))


def same_being(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """(book, a, b, sentences, first_chapter): two registered names that a text calls the same ("A, the B", "A known as B", "A was
    the B", "A - the B"), whichever comes first. Between the two stands no other capitalised word, so a text's names in order and
    what stands between them are all that is looked at: neighbours whose connection is one of CONNECTORS."""
    told = forms.once(chapters.where("source_text is not null").select("book", "chapter_no", "source_text"), _n=F.regexp_extract_all("source_text", F.lit(_NAME), F.lit(0)), _g=F.split("source_text", _NAME, -1))
    pairs = F.arrays_zip(F.col("_n").alias("x"), F.slice("_g", 2, 1 << 30).alias("between"), F.slice("_n", 2, 1 << 30).alias("y"))
    seen = told.select("book", "chapter_no", F.inline(F.filter(pairs, lambda p: p["y"].isNotNull() & (F.length(p["between"]) <= 40)))).where(F.regexp_replace("between", r"[ \t]+", " ").isin(*sorted(CONNECTORS)) & (F.col("x") != F.col("y"))).drop("between")
    names = terms.select("book", F.col("source").alias("x")).distinct()
    both = seen.join(names, ["book", "x"], "left_semi").join(names.withColumnRenamed("x", "y"), ["book", "y"], "left_semi")
    return both.groupBy("book", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("sentences"), F.min("chapter_no").alias("first_chapter"))


def alias_groups(aliases: DataFrame, uses: DataFrame) -> DataFrame:
    """aliases(u, v) and uses(node, chapters) -> (node, representative, members): of each component of aliases the node told in most
    chapters speaks for all, ties by name."""
    found = components(aliases)
    node = next(c for c in found.columns if c != "component")
    told = found.select(F.col(node).alias("node"), "component").join(uses, "node", "left").withColumn("chapters", F.coalesce("chapters", F.lit(0)))
    best = told.groupBy("component").agg(F.min(F.struct((-F.col("chapters")).alias("c"), "node")).alias("x"), F.count("*").alias("members"))
    return told.join(best, "component").select("node", F.col("x.node").alias("representative"), "members")


def _plain(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def evidence_verdicts(proposals: DataFrame, chapters: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """proposals(id, url, subject, relation, object, quote, confidence) -> (id, reason): the first rule that fails, null if none.
    The quote has to stand in the chapter word for word, with both names in it."""
    quote, text = _plain(F.col("quote")), _plain(F.col("source_text"))
    lacks = lambda c: ~F.coalesce(F.contains(quote, F.lower(c)), F.lit(False))
    reason = (
        F.when(~F.col("relation").isin(*relations), "unknown relation")
        .when(F.coalesce(F.length(quote), F.lit(0)) < LEAST_QUOTE, "no evidence")
        .when(~F.coalesce(F.contains(text, quote), F.lit(False)), "not verbatim")
        .when(lacks(F.col("subject")), "subject absent")
        .when(lacks(F.col("object")), "object absent")
        .when(F.col("subject") == F.col("object"), "same ends")
        .when(F.coalesce("confidence", F.lit(0.0)) < LEAST_CONFIDENCE, "low confidence")
        .when(quote.rlike(SUPPOSED), "supposed")
        .when(F.col("subject").rlike(r"^[a-z]"), "common noun")
    )
    return proposals.join(chapters.select("url", "source_text"), "url", "left").select("id", reason.alias("reason"))


def extracted_names(found: DataFrame) -> DataFrame:
    """found(url, names, terms, source_text, translation) -> (url, kept, dropped, broken): names a model reported, without those that
    are terms, hold Turkish letters, or stand not in both texts; a list of four or more, half of them not in the source, is broken."""
    folded = forms.once(found, _s=T.fold_term(F.col("source_text")), _t=T.fold_term(F.col("translation")), _k=F.transform("terms", T.fold_term))
    source, target, keys = F.col("_s"), F.col("_t"), F.col("_k")
    good = lambda n: ~F.array_contains(keys, T.fold_term(n)) & ~n.rlike(_TURKISH) & F.contains(target, T.fold_term(n)) & F.contains(source, T.fold_term(n))
    outside = F.size(F.filter("names", lambda n: ~F.contains(source, T.fold_term(n))))
    kept = F.filter("names", good)
    broken = (F.size("names") >= BROKEN_LEAST) & (outside >= BROKEN_SHARE * F.size("names"))
    return folded.select("url", F.array_join(F.array_sort(kept), ",").alias("kept"), (F.size("names") - F.size(kept)).cast("long").alias("dropped"), broken.alias("broken"))


# Inputs of the queries, in SQL that both engines read.
_GATED = """(SELECT book, source, CASE WHEN length(source) % 5 = 0 THEN source WHEN length(source) % 5 = 1 THEN concat(target, chr(39), 's') WHEN length(source) % 5 = 2 THEN concat(target, 'ler') ELSE target END AS target, CASE WHEN chapters % 2 = 0 THEN 'person' ELSE 'place' END AS kind FROM {terms}
  UNION ALL SELECT book, concat(source, 's'), concat('the ', target), 'person' FROM {terms} WHERE chapters % 3 = 0
  UNION ALL SELECT book, concat(source, ' Gate'), concat(source, ' Gate'), 'place' FROM {terms} WHERE chapters % 4 = 0
  UNION ALL SELECT book, concat('Stone', length(source) % 3, ' ', source), concat('kor', CASE WHEN chapters % 4 = 0 THEN 'lu' ELSE '' END, ' ', target), 'thing' FROM {terms} WHERE chapters % 5 = 0)"""
_BANNED = "(SELECT book, target FROM {terms} WHERE length(source) % 7 = 0)"
_POLICY = "(SELECT DISTINCT book, 'person' AS kind, 'keep' AS rule FROM {terms} WHERE length(book) % 2 = 0)"
_SEEN = "(SELECT book, url AS src, 'class' AS relation, regexp_extract(source_text, '[A-Z][a-z]{{4,}}', 0) AS dst FROM {chapters})"
_PROFILE = "(SELECT DISTINCT book, concat(source, 's') AS name FROM {terms} WHERE chapters % 6 = 0)"
_PROPOSED = """(SELECT doc_id AS id, url, CASE WHEN doc_id % 8 = 1 THEN 'Nobody' ELSE regexp_extract(substring(source_text, 11, 120), '[A-Za-z]{{4,}}', 0) END AS subject, CASE WHEN doc_id % 9 = 0 THEN 'odd' ELSE 'knows' END AS relation,
  regexp_extract(substring(source_text, 60, 71), '[A-Za-z]{{3,}}', 0) AS object, CASE WHEN doc_id % 10 = 3 THEN concat('x', substring(source_text, 11, 120)) WHEN doc_id % 10 = 4 THEN NULL ELSE substring(source_text, 11, 120) END AS quote, CAST(doc_id % 20 AS DOUBLE) / 20 AS confidence FROM {chapters})"""
_USES = "(SELECT concat(book, '/', node) AS node, count(DISTINCT learned_at) AS chapters FROM (SELECT book, src AS node, learned_at FROM {edges} UNION ALL SELECT book, dst, learned_at FROM {edges}) GROUP BY 1)"
_ALIASES = "(SELECT DISTINCT concat(book, '/', src) AS u, concat(book, '/', dst) AS v FROM {edges})"


def _sql(s, d, text: str, **given: DataFrame) -> DataFrame:
    return s.sql("SELECT * FROM " + text, **{name: given.get(name) or role(s, d, name) for name in ("terms", "chapters", "edges") if "{" + name + "}" in text})


def _gate(s, d) -> DataFrame:
    terms = reliable(role(s, d, "terms"))
    return gate(*[_sql(s, d, text, terms=terms) for text in (_GATED, _BANNED, _POLICY)])


def _duck(text: str) -> str:
    for name in ("terms", "chapters", "edges"):
        text = text.replace("{" + name + "}", sql_role(name) + f" {name}_")
    return text.replace("{{", "{").replace("}}", "}")


def _reported(s, d) -> DataFrame:
    c = role(s, d, "chapters").where("translation is not null")
    names = F.array_distinct(F.regexp_extract_all("source_text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))
    made = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, ("Bilgin", "Çelik", "Xyzzyq", "Qwortl")))).otherwise(F.array(F.lit("Bilgin")))
    return c.select("url", F.concat(names, made).alias("names"), F.slice(names, 2, 2).alias("terms"), "source_text", "translation")


QUERIES = {
    "nested_terms": lambda s, d: nested(_sql(s, d, _GATED)),
    "gate_reasons": _gate,
    "case_profile": lambda s, d: case_profile(role(s, d, "chapters"), role(s, d, "terms")),
    "family_minority": lambda s, d: family_minority(_sql(s, d, _GATED)),
    "general_categories": lambda s, d: categories(_sql(s, d, _GATED).withColumnRenamed("source", "name"), _sql(s, d, _SEEN), _sql(s, d, _PROFILE)),
    "same_being": lambda s, d: same_being(role(s, d, "chapters"), role(s, d, "terms")),
    "alias_groups": lambda s, d: alias_groups(_sql(s, d, _ALIASES), _sql(s, d, _USES)),
    "evidence_verdicts": lambda s, d: evidence_verdicts(_sql(s, d, _PROPOSED), role(s, d, "chapters"), ("knows", "owns")),
    "extracted_names": lambda s, d: extracted_names(_reported(s, d)),
}
_q = lambda x: "'" + x.replace("'", "''") + "'"
_FOLD = lambda x: f"lower(regexp_replace(trim({x}), '[\\s\\-_''’.·]+', '', 'g'))"
_WORDS = f"(SELECT book, chapter_no, t, i, t[i] AS w, CASE WHEN i > 1 THEN t[i - 1] END AS sep FROM (SELECT book, chapter_no, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT book, chapter_no, regexp_extract_all(source_text, {_q(_TOKENS)}) AS t FROM {{chapters}}) a) b)"
_LIST = ", ".join(map(_q, ENGLISH))
_DSING = lambda w: f"CASE WHEN length({w}) > 3 THEN regexp_replace({w}, 's\\z', '') ELSE {w} END"
_DPLAIN = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
ORACLE = {
    "nested_terms": _duck(f"WITH t AS (SELECT * FROM {_GATED} g) SELECT DISTINCT a.book, a.source, b.source AS \"within\" FROM t a JOIN t b ON a.book = b.book AND length(a.source) < length(b.source) AND contains(concat(' ', lower(b.source), ' '), concat(' ', lower(a.source), ' '))"),
    "gate_reasons": _duck(f"""WITH t AS (SELECT *, {_FOLD('source')} = {_FOLD('target')} AS kept, {_FOLD('target')} AS key, {_FOLD('source')} AS f, regexp_matches(source, {_q(_PLURAL_SOURCE)}) AS plural, regexp_matches(target, {_q(_PLURAL_TARGET)}) AS many FROM {_GATED} g),
r AS (SELECT book, source, 'plural_form' AS reason FROM t WHERE plural
 UNION SELECT book, source, 'english_possessive' FROM t WHERE NOT kept AND regexp_matches(target, '(?i)[''’]s(?:\\z|[^\\p{{{{L}}}}\\p{{{{N}}}}_])')
 UNION SELECT book, source, 'case_ending' FROM t WHERE NOT kept AND regexp_matches(target, {_q(CASE_END)})
 UNION SELECT book, source, 'english_word' FROM t WHERE NOT kept AND list_has_any(regexp_extract_all(lower(target), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), [{_LIST}])
 UNION SELECT book, source, 'number' FROM t WHERE NOT kept AND ((NOT plural AND many) OR (plural AND NOT many AND NOT regexp_matches(source, {_q(COUNTED)})))
 UNION SELECT book, source, 'collision' FROM t WHERE NOT kept AND (book, key) IN (SELECT (book, key) FROM t WHERE NOT kept GROUP BY book, key HAVING count(DISTINCT source) > 1)
 UNION SELECT book, source, 'forbidden' FROM t WHERE NOT kept AND (book, key) IN (SELECT (book, {_FOLD('target')}) FROM {_BANNED} b)
 UNION SELECT k.book, k.source, 'part_conflict' FROM t k JOIN t p ON k.book = p.book AND k.kept AND NOT p.kept AND length(p.source) < length(k.source) AND contains(concat(' ', lower(k.source), ' '), concat(' ', lower(p.source), ' '))
 UNION SELECT x.book, unnest([x.source, y.source]), 'near_spelling' FROM (SELECT DISTINCT book, source, f FROM t WHERE length(f) >= {NEAR_LENGTH}) x JOIN (SELECT DISTINCT book, source, f FROM t WHERE length(f) >= {NEAR_LENGTH}) y ON x.book = y.book AND x.source < y.source AND abs(length(x.f) - length(y.f)) <= 1 AND levenshtein(x.f, y.f) = 1 AND concat(x.f, 's') <> y.f AND concat(y.f, 's') <> x.f
 UNION SELECT t.book, t.source, 'policy' FROM t JOIN {_POLICY} p ON t.book = p.book AND t.kind = p.kind WHERE (p.rule = 'keep') <> t.kept)
SELECT book, source, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY book, source"""),
    "case_profile": _duck(f"WITH w AS (SELECT book, lower(w) AS key, count(CASE WHEN w = lower(w) THEN 1 END) AS lower_uses, count(CASE WHEN w <> lower(w) AND (regexp_matches(sep, {_q(_MID_A)}) OR regexp_matches(sep, {_q(_MID_B.replace('{', '{{').replace('}', '}}'))})) THEN 1 END) AS upper_mid FROM {_WORDS} x WHERE regexp_matches(w, '^\\p{{{{L}}}}') GROUP BY ALL) SELECT t.book, t.source, coalesce(lower_uses, 0) AS lower_uses, coalesce(upper_mid, 0) AS upper_mid, coalesce(lower_uses >= {LEAST_LOWER} AND lower_uses >= upper_mid, false) AS ordinary FROM {{terms}} LEFT JOIN w ON t.book = w.book AND lower(t.source) = w.key".replace("{terms}", "(SELECT DISTINCT book, source FROM {terms}) t")),
    "family_minority": _duck(f"WITH f AS (SELECT book, lower(split_part(source, ' ', 1)) AS family, source, target, lower(split_part(target, ' ', 1)) AS head FROM {_GATED} g WHERE contains(source, ' ')), h AS (SELECT book, family, head, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT book, family, CAST(sum(n) AS BIGINT) AS members, arg_min(head, (-n, head)) AS usual FROM h GROUP BY ALL HAVING sum(n) >= 3) SELECT f.book, f.family, f.source, f.target, usual, members FROM f JOIN u ON f.book = u.book AND f.family = u.family WHERE head <> usual AND abs(length(head) - length(usual)) <= 3 AND (starts_with(head, usual) OR starts_with(usual, head))"),
    "general_categories": _duck(f"WITH n AS (SELECT DISTINCT book, source AS name FROM {_GATED} g), k AS (SELECT book, name, min(reason) AS reason FROM (SELECT book, name, 'listed' AS reason FROM {_PROFILE} p UNION ALL SELECT book, dst, 'object' FROM {_SEEN} e GROUP BY book, dst HAVING count(*) >= 2) q GROUP BY ALL), w AS (SELECT DISTINCT book, {_DSING('w')} AS w FROM (SELECT book, unnest(string_split(lower(name), ' ')) AS w FROM k) a), p AS (SELECT book, name, len(string_split(name, ' ')) AS n, unnest(string_split(lower(name), ' ')) AS w FROM n), m AS (SELECT p.book, p.name FROM p WHERE n >= 2 AND EXISTS (SELECT 1 FROM w WHERE w.book = p.book AND w.w = {_DSING('p.w')}) GROUP BY p.book, p.name, p.n HAVING count(*) = p.n) SELECT book, name, max(reason) AS reason FROM (SELECT n.book, n.name, k.reason FROM n JOIN k ON n.book = k.book AND n.name = k.name UNION ALL SELECT book, name, 'compound' FROM m) q GROUP BY ALL"),
    "same_being": _duck(f"WITH n AS (SELECT DISTINCT book, source FROM {{terms}}), t AS (SELECT book, chapter_no, regexp_extract_all(source_text, {_q(_TOKENS)}) AS t FROM {{chapters}}), c AS (SELECT book, chapter_no, t, list_filter(range(1, len(t) + 1), lambda i: regexp_matches(t[i], '^[A-Z]')) AS ix FROM t), p AS (SELECT book, chapter_no, t[a] AS x, t[b] AS y, regexp_replace(array_to_string(t[a + 1:b - 1], ''), '[ \\t]+', ' ', 'g') AS between_ FROM (SELECT book, chapter_no, t, unnest(ix[1:len(ix) - 1]) AS a, unnest(ix[2:len(ix)]) AS b FROM c) q) SELECT p.book, least(x, y) AS a, greatest(x, y) AS b, count(*) AS sentences, min(chapter_no) AS first_chapter FROM p SEMI JOIN n ON p.book = n.book AND p.x = n.source SEMI JOIN n m ON p.book = m.book AND p.y = m.source WHERE between_ IN ({', '.join(map(_q, sorted(CONNECTORS)))}) AND x <> y GROUP BY ALL"),
    "alias_groups": _duck(f"WITH RECURSIVE e AS (SELECT * FROM {_ALIASES} a), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, seen) AS (SELECT u, u FROM b UNION SELECT b.v, r.seen FROM r JOIN b ON r.node = b.u), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node), t AS (SELECT c.node, component, coalesce(chapters, 0) AS n FROM c LEFT JOIN {_USES} u ON c.node = u.node), x AS (SELECT component, arg_min(node, (-n, node)) AS representative, count(*) AS members FROM t GROUP BY component) SELECT node, representative, members FROM t JOIN x USING (component)"),
    "evidence_verdicts": _duck(f"SELECT id, CASE WHEN relation NOT IN ('knows', 'owns') THEN 'unknown relation' WHEN coalesce(length({_DPLAIN('quote')}), 0) < {LEAST_QUOTE} THEN 'no evidence' WHEN NOT contains({_DPLAIN('source_text')}, {_DPLAIN('quote')}) THEN 'not verbatim' WHEN NOT contains({_DPLAIN('quote')}, lower(subject)) THEN 'subject absent' WHEN NOT contains({_DPLAIN('quote')}, lower(object)) THEN 'object absent' WHEN subject = object THEN 'same ends' WHEN confidence < {LEAST_CONFIDENCE}::DOUBLE THEN 'low confidence' WHEN regexp_matches({_DPLAIN('quote')}, {_q(SUPPOSED.replace('{', '{{').replace('}', '}}'))}) THEN 'supposed' WHEN regexp_matches(subject, '^[a-z]') THEN 'common noun' END AS reason FROM {_PROPOSED} p LEFT JOIN {{chapters}} ON p.url = chapters_.url"),
    "extracted_names": _duck(f"SELECT url, array_to_string(list_sort(kept), ',') AS kept, CAST(len(names) - len(kept) AS BIGINT) AS dropped, len(names) >= {BROKEN_LEAST} AND len(list_filter(names, lambda n: NOT contains(sf, {_FOLD('n')}))) >= {BROKEN_SHARE}::DOUBLE * len(names) AS broken FROM (SELECT *, list_filter(names, lambda n: NOT list_contains(keys, {_FOLD('n')}) AND NOT regexp_matches(n, {_q(_TURKISH)}) AND contains(tf, {_FOLD('n')}) AND contains(sf, {_FOLD('n')})) AS kept FROM (SELECT url, list_concat(ns, CASE WHEN doc_id % 3 = 0 THEN ['Bilgin', 'Çelik', 'Xyzzyq', 'Qwortl'] ELSE ['Bilgin'] END) AS names, list_transform(ns[2:3], lambda n: {_FOLD('n')}) AS keys, {_FOLD('source_text')} AS sf, {_FOLD('translation')} AS tf FROM (SELECT *, list_filter(regexp_extract_all(source_text, '[A-Z][a-z]{{{{4,}}}}'), lambda x, i: list_position(regexp_extract_all(source_text, '[A-Z][a-z]{{{{4,}}}}'), x) = i) AS ns FROM {{chapters}} WHERE translation IS NOT NULL) a) b) c"),
}
