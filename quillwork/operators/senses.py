"""Words of two senses, forms of address, and records read off message lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms, turkish
from ..functions import text as T
from ..sources.tables import role, sql_role
from .chapters import paragraphs
from .messages import _MESSAGES, _told, messages

# Fixed values. Capitalised words that are no names; words that no article reaches across; articles; and of Turkish address the
# pronouns and the endings of the second person, I standing for its four vowels, with words that only look like them.
NO_NAMES = ("The", "He", "She", "It", "They", "But", "And", "Then", "His", "Her", "I", "A", "An")
PREPOSITIONS = ("to", "of", "for", "with", "at", "from", "by", "on", "in", "into", "onto", "than", "as")
INDEFINITE = ("a", "an", "another", "every", "no", "any")
DEFINITE = ("the", "that", "this", "those", "these")
LISTING = ("and", "or", "nor", "even")
SIZ, SEN = ("siz", "sizi", "size", "sizin", "sizde", "sizden", "sizinle", "sizler"), ("sen", "seni", "sana", "senin", "sende", "senden", "seninle")
SIZ_ENDINGS, SEN_ENDINGS = ("InIz", "yIn"), ("sIn", "dIn", "tIn")
NOT_SIZ, NOT_SEN = ("oyun", "koyun", "boyun", "soyun", "huyun", "suyun"), ("kadın", "altın", "yakın", "akın", "kalın", "ilkin", "yüzdün")


@dataclass(frozen=True)
class Sense:
    """A term of two senses: its base target, the target of its second sense, and what tells them apart."""

    term: str
    base: str
    second: str
    since: int = 0
    compounds: tuple[str, ...] = ()
    before_base: tuple[str, ...] = ()
    ranks: tuple[str, ...] = ()


def _said(i: Column, back: int) -> Column:
    """The word so many places before, in lower case; null where something but white space stands between the two."""
    between = [F.get("_g", i - k).rlike(r"^\s+$") for k in range(back)]
    together = between[0]
    for b in between[1:]:
        together = together & b
    return F.when(together, F.lower(F.get("_w", i - back)))


def _any(word: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False)) if words else F.lit(False)


def kinds_of_use(sense: Sense, chapter: Column) -> Column:
    """array<string> of base, second or unclear: each use of the term among the words `_w` with the gaps `_g` around them.

    Base: before the second sense is known, in the plural, as a title before a name (also stammered), after an indefinite article
    with up to two adjectives, in a listing of ranks, after a word that settles it. Unclear: after a definite article. Else the
    bare word is the name. A use that ends a compound is none."""

    def kind(i: Column) -> Column:
        one, two, three = (_said(i, k) for k in (1, 2, 3))
        free = lambda w: F.coalesce(w.rlike("^[a-z]+$") & ~w.isin(*PREPOSITIONS), F.lit(False))
        article = _any(one, INDEFINITE) | (_any(two, INDEFINITE) & free(one)) | (_any(three, INDEFINITE) & free(one) & free(two))
        ranks = tuple(f"{r.lower()}{e}" for r in sense.ranks for e in ("", "s"))
        # a rank may have a comma after it, so it is looked for by place
        listed = _any(one, LISTING[:3]) & _any(F.lower(F.get("_w", i - 2)), ranks) | _any(one, LISTING[3:]) & (_any(F.lower(F.get("_w", i - 2)), ranks) | (F.lower(F.get("_w", i - 2)) == "maybe") & _any(F.lower(F.get("_w", i - 3)), ranks))
        settles = tuple(w.lower() for w in sense.before_base)
        joined = _any(one, ("of", "and", "or", "a"))
        settled = _any(one, settles) | (joined & _any(two, settles)) | ((one == "a") & _any(two, ("of", "and", "or")) & _any(three, settles))
        pointed = _any(one, DEFINITE) | (_any(two, DEFINITE) & F.coalesce(F.get("_w", i - 1).rlike("^[A-Za-z]+$"), F.lit(False)))
        after, gap = F.get("_w", i + 1), F.get("_g", i + 1)
        spaced = lambda k: F.get("_g", i + k).rlike(r"^\s+$")
        name = lambda w, never: F.coalesce(w.rlike("^[A-Z][a-z]") & ~w.isin(*never), F.lit(False))
        titled = (spaced(1) & name(after, NO_NAMES)) | ((after == sense.term) & (F.length(gap) <= 6) & spaced(2) & name(F.get("_w", i + 2), NO_NAMES[:8]))
        plural = (F.get("_w", i) == f"{sense.term}s") & ~gap.rlike("^['’]")
        base = plural | F.coalesce(titled, F.lit(False)) | article | F.coalesce(listed, F.lit(False)) | F.coalesce(settled, F.lit(False))
        early = F.coalesce(chapter < sense.since, F.lit(False))
        return F.when(early | base, "base").when(pointed, "unclear").otherwise("second")

    places = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", i).isin(sense.term, f"{sense.term}s") & ~_any(F.when(F.get("_g", i).rlike(r"^\s+$"), F.get("_w", i - 1)), sense.compounds))
    return F.when(F.size("_w") > 0, F.transform(places, kind)).otherwise(F.array().cast("array<string>"))


def sense_faults(paras: DataFrame, senses: list[Sense]) -> DataFrame:
    """(book, chapter_no, para, term, sense, expected): a row per paragraph and term whose translation lacks the target of a sense
    that is certain, or has the base one where only the second stands: flagged, never mended. Paragraphs without a term are left
    out by a containment test first."""
    out = None
    for sense in senses:
        near = paras.where(F.contains("en", F.lit(sense.term))).select("book", "chapter_no", "para", "en", "tr")
        split = forms.once(near, _w=F.regexp_extract_all("en", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), _g=F.split("en", r"[\p{L}\p{N}_]+", -1), _t=turkish.tokens(F.col("tr")))
        rows = split.select("book", "chapter_no", "para", kinds_of_use(sense, F.col("chapter_no")).alias("kinds"), *[turkish.stands(F.col("_t"), F.lit(t)).alias(c) for c, t in (("base", sense.base), ("second", sense.second))])
        has = lambda k: F.array_contains("kinds", k)
        apart = sense.base.casefold() != sense.second.casefold()
        wrong = has("second") & (~F.col("second") | (~has("base") & F.lit(apart) & F.col("base")))
        fault = F.when(wrong, F.struct(F.lit("second").alias("sense"), F.lit(sense.second).alias("expected"))).when(has("base") & ~F.col("base"), F.struct(F.lit("base").alias("sense"), F.lit(sense.base).alias("expected")))
        found = rows.select("book", "chapter_no", "para", F.lit(sense.term).alias("term"), fault.alias("f")).where("f is not null").select("book", "chapter_no", "para", "term", "f.sense", "f.expected")
        out = found if out is None else out.unionByName(found)
    return out


def _ended(endings: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(e.replace("I", v) for e in endings for v in "ıiuü")


def address_form(tr: Column) -> Column:
    """sen, siz, both, or null: by the pronouns and personal endings of the words."""
    words = T.words(T.turkish_lower(tr))

    def has(pronouns: tuple[str, ...], endings: tuple[str, ...], but: tuple[str, ...]) -> Column:
        ended = lambda w: F.exists(F.array(*map(F.lit, _ended(endings))), lambda e: w.endswith(e) & (F.length(w) > F.length(e)))
        return F.exists(words, lambda w: w.isin(*pronouns) | (~w.isin(*but) & ended(w)))

    familiar, polite = has(SEN, SEN_ENDINGS, NOT_SEN), has(SIZ, SIZ_ENDINGS, NOT_SIZ)
    return F.when(familiar & polite, "both").when(familiar, "sen").when(polite, "siz")


def address_counts(paras: DataFrame) -> DataFrame:
    """Paragraphs by form of address, in messages (source in brackets) and in dialogue (source with quotation marks)."""
    where = F.when(F.ltrim("en").startswith("["), "message").when(F.col("en").rlike(r"[\"“”]"), "dialogue").otherwise("narration")
    return paras.select(where.alias("context"), address_form(F.col("tr")).alias("form")).where("form is not null").groupBy("context", "form").agg(F.count("*").alias("paragraphs"))


def message_claims(found: DataFrame, profile: DataFrame, name_key: str = "name") -> DataFrame:
    """(book, url, subject, relation, object) read off message lines by a profile(key, relation): a line with the name key opens a
    record, and the lines after it in the chapter speak of that subject; lines before any name have a null subject. Listed objects
    in brackets are one claim each."""
    low = F.lower("key")
    by = Window.partitionBy("url").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = found.withColumn("subject", F.last(F.when(low == name_key, F.regexp_replace("value", r"[\[\]]", "")), ignorenulls=True).over(by))
    rules = profile.select(F.lower("key").alias("_k"), "relation")
    hit = named.where(low != name_key).join(rules, low == F.col("_k"))
    listed = F.regexp_extract_all("value", F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    return hit.select("book", "url", "subject", "relation", F.explode(F.when(F.size(listed) > 0, listed).otherwise(F.array("value"))).alias("object"))


def _told_paras(s, d):
    """Answers as they are, with a mark of address here and there."""
    p = role(s, d, "pairs").withColumn("translation", F.col("source_text"))
    end = F.when(F.col("para") % 3 == 0, " siz geldiniz").when(F.col("para") % 3 == 1, " sen").otherwise(" kadın oyun")
    head = F.when(F.col("chapter_no") % 4 == 0, "[").when(F.col("chapter_no") % 4 == 1, '"').otherwise("")
    return paragraphs(p).select("book", "chapter_no", "para", F.concat(head, "en").alias("en"), F.concat("tr", end).alias("tr"))


def _titled(s, d):
    shape = F.when(F.col("para") % 4 == 0, " a Warden").when(F.col("para") % 4 == 1, " summoned Warden.").when(F.col("para") % 4 == 2, " the Warden").otherwise(" Warden Tyr")
    return _told_paras(s, d).withColumn("en", F.concat("en", shape)).withColumn("tr", F.concat("tr", F.when(F.col("chapter_no") % 3 == 0, " Bekçi").otherwise(" Warden'i")))


def _profile(s):
    return s.createDataFrame([("Rank", "has_rank"), ("Class", "has_class")], "key string, relation string")


QUERIES = {
    "sense_faults": lambda s, d: sense_faults(_titled(s, d), [Sense("Warden", "Bekçi", "Warden", 1)]),
    "address_counts": lambda s, d: address_counts(_told_paras(s, d)),
    "message_claims": lambda s, d: message_claims(messages(_told(s, d)), _profile(s)),
}
_P = f"(SELECT chapter_no, i AS para, t[i + 1] AS x FROM (SELECT chapter_no, t, unnest(range(len(t))) AS i FROM (SELECT chapter_no, string_split(source_text, chr(10)) AS t FROM {sql_role('pairs')} a) b) c)"
_q = lambda xs: ", ".join(f"'{x}'" for x in xs)
_has = lambda pronouns, endings, but: f"len(list_filter(w, lambda v: v IN ({_q(pronouns)}) OR (v NOT IN ({_q(but)}) AND len(list_filter([{_q(_ended(endings))}], lambda e: ends_with(v, e) AND length(v) > length(e))) > 0))) > 0"
ORACLE = {
    "address_counts": f"""WITH p AS (SELECT concat(CASE chapter_no % 4 WHEN 0 THEN '[' WHEN 1 THEN '"' ELSE '' END, x) AS en, regexp_extract_all(lower(translate(concat(x, CASE para % 3 WHEN 0 THEN ' siz geldiniz' WHEN 1 THEN ' sen' ELSE ' kadın oyun' END), 'Iİ', 'ıi')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {_P} p0),
f AS (SELECT CASE WHEN starts_with(ltrim(en), '[') THEN 'message' WHEN regexp_matches(en, '["“”]') THEN 'dialogue' ELSE 'narration' END AS context, {_has(SEN, SEN_ENDINGS, NOT_SEN)} AS a, {_has(SIZ, SIZ_ENDINGS, NOT_SIZ)} AS b FROM p)
SELECT context, CASE WHEN a AND b THEN 'both' WHEN a THEN 'sen' ELSE 'siz' END AS form, count(*) AS paragraphs FROM f WHERE a OR b GROUP BY ALL""",
    # the one sense of the query: since chapter 1, without compounds, ranks or words that settle it
    "sense_faults": f"""WITH p AS (SELECT book, chapter_no, para, concat(CASE chapter_no % 4 WHEN 0 THEN '[' WHEN 1 THEN '"' ELSE '' END, x, CASE para % 4 WHEN 0 THEN ' a Warden' WHEN 1 THEN ' summoned Warden.' WHEN 2 THEN ' the Warden' ELSE ' Warden Tyr' END) AS en, concat(x, CASE para % 3 WHEN 0 THEN ' siz geldiniz' WHEN 1 THEN ' sen' ELSE ' kadın oyun' END, CASE chapter_no % 3 WHEN 0 THEN ' Bekçi' ELSE ' Warden''i' END) AS tr FROM {_P.replace('SELECT chapter_no', 'SELECT book, chapter_no')} p0),
k AS (SELECT *, CASE WHEN chapter_no < 1 OR regexp_matches(en, '(^|[^\\p{{L}}\\p{{N}}_])(?i:a|an|another|every|no|any)\\s+([A-Za-z]+\\s+){{0,2}}Warden$') AND NOT regexp_matches(en, '(?i:\\s({'|'.join(PREPOSITIONS)})\\s+([a-z]+\\s+)?Warden$)') OR regexp_matches(en, 'Warden Tyr$') THEN 'base' WHEN regexp_matches(en, '(^|[^\\p{{L}}\\p{{N}}_])(?i:the|that|this|those|these)\\s+([A-Za-z]+\\s+)?Warden[.]?$') THEN 'unclear'
  WHEN regexp_matches(en, '(^|[^\\p{{L}}\\p{{N}}_])(?i:a|an|another|every|no|any)\\s+([A-Za-z]+\\s+){{0,1}}summoned\\s+Warden.$') THEN 'base' ELSE 'second' END AS kind, list_filter({turkish.sql_tokens('tr')}, lambda w: starts_with(w, 'bekçi')) <> [] AS base, list_filter({turkish.sql_tokens('tr')}, lambda w: starts_with(w, 'warden')) <> [] AS second FROM p)
SELECT book, chapter_no, para, 'Warden' AS term, kind AS sense, CASE kind WHEN 'base' THEN 'Bekçi' ELSE 'Warden' END AS expected FROM k WHERE kind = 'second' AND (NOT second OR base) OR kind = 'base' AND NOT base""",
    "message_claims": f"""WITH {_MESSAGES}, n AS (SELECT *, last_value(CASE WHEN lower(key) = 'name' THEN regexp_replace(value, '[\\[\\]]', '', 'g') END IGNORE NULLS) OVER (PARTITION BY url ORDER BY line ROWS UNBOUNDED PRECEDING) AS subject FROM m),
g AS (SELECT book, url, subject, CASE lower(key) WHEN 'rank' THEN 'has_rank' ELSE 'has_class' END AS relation, regexp_extract_all(value, '\\[([^\\[\\]]+)\\]', 1) AS listed, value FROM n WHERE lower(key) IN ('rank', 'class'))
SELECT book, url, subject, relation, unnest(CASE WHEN len(listed) > 0 THEN listed ELSE [value] END) AS object FROM g""",
}
