"""Translation-quality detectors over aligned paragraphs: ratios, residues, foreign letters, numbers, repeats, drift."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms, likeness, numbers
from ..functions import text as T
from ..sources.tables import duck, role, shared, sql_role
from .chapters import paragraphs

SHORT, ALARM = 0.70, 0.85

# English function words that are spelled like no Turkish word, and number words.
FUNCTION_WORDS = tuple("""
the and but that with was were would could should they them their your from have
had been than then there what when which who will about into over just only even
still down this these those some more most much many very such how why where
while before after again once here never always said asked replied because though
although himself herself itself themselves yourself something nothing anything
everything someone everyone another being having going upon without within through
around against between among behind toward towards already almost enough perhaps
however therefore instead rather quite really actually simply finally suddenly
slowly quickly seemed looked thought knew felt make took take came come went know
think
""".split())
NUMBER_WORDS = tuple("""
one two three four five six seven eight nine ten eleven twelve thirteen fourteen
fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty
seventy eighty ninety hundred thousand million billion first second third fourth
fifth sixth seventh eighth ninth tenth dozen twice
""".split())
_WORD = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*"
#: What closes a sentence before a word.
_CLOSED = r"[.!?:…\"“”][\s\"“”'(*\[]*$"


def length_ratios(pairs: DataFrame) -> DataFrame:
    """Characters out over characters in; the verdict is derived when read, the ratio is what is stored."""
    ratio = T.length_ratio(F.col("translation"), F.col("source_text"))
    return pairs.select("book", "chapter_no", F.round(ratio, 6).alias("ratio"), (ratio < SHORT).alias("shortened"))


def foreign_letters(paras: DataFrame, own: str = r"[^\p{L}]|[a-zA-Z]") -> DataFrame:
    """Letters outside the expected alphabet that the source paragraph does not have."""
    letters = lambda c: F.array_distinct(F.split(F.regexp_replace(c, own, ""), ""))
    found = F.array_sort(F.filter(F.array_except(letters(F.col("tr")), letters(F.col("en"))), lambda x: x != ""))
    return paras.select("book", "chapter_no", "para", F.concat_ws("", found).alias("letters")).where("letters <> ''")


def untranslated(paras: DataFrame, least: int = 5, share: float = 0.9) -> DataFrame:
    """Paragraphs of five words or more whose distinct lower-case words nearly all stand in the source: not translated."""
    small = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{Ll}\p{N}_]{2,}"), F.lit(0)))
    t, s = small(F.col("tr")), small(F.col("en"))
    both = paras.select("book", "chapter_no", "para", F.size(t).cast("long").alias("words"), F.size(F.array_intersect(t, s)).cast("long").alias("shared"))
    return both.where((F.col("words") >= least) & (F.col("shared") >= share * F.col("words")))


def residues(paras: DataFrame, function_words: tuple[str, ...] = ("the", "and", "with", "from", "that", "this")) -> DataFrame:
    """Function words of the source language left in a translation."""
    found = F.filter(T.words(F.col("tr")), lambda w: w.isin(*function_words))
    return paras.select("book", "chapter_no", "para", F.size(found).cast("long").alias("n")).where("n > 0").groupBy("book", "chapter_no").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("words"))


def english_residue(paras: DataFrame, by: list[str], terms: DataFrame) -> DataFrame:
    """paras(*by, book, en, tr) of aligned texts -> (*by, book, block, word) of the paragraphs that are English as a whole (`block`) or
    hold a function or number word of their source (`word`, the first).

    Block: five words or more that are no names of the source, nine tenths of them from the source. Word: it stands in the source, is no
    term, stands not inside a term of several words, has a capital only where a sentence opens, and, if a number, no capitalised
    word after it. Blank paragraphs are not measured. A book's terms that hold such words come to its paragraphs as one row."""
    marked = (*FUNCTION_WORDS, *NUMBER_WORDS)
    words = lambda c: F.regexp_extract_all(F.translate(c, "’", "'"), F.lit(_WORD), F.lit(0))
    low = lambda ws: F.transform(ws, F.lower)
    known = terms.select("book", low(words(F.col("source"))).alias("w")).where(F.exists("w", lambda x: x.isin(*marked)))
    own = known.groupBy("book").agg(F.collect_set(F.when(F.size("w") == 1, F.col("w")[0])).alias("_alone"), F.collect_set(F.when(F.size("w") > 1, F.col("w"))).alias("_spans"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    told = paras.where("trim(en) <> '' and trim(tr) <> ''").select(*by, "book", "en", "tr").join(own, "book", "left")
    split = forms.once(told, _t=words(F.col("tr")), _g=F.split(F.translate("tr", "’", "'"), _WORD, -1), _e=words(F.col("en")), _h=F.split(F.translate("en", "’", "'"), _WORD, -1), _one=none(F.col("_alone"), "array<string>"), _many=none(F.col("_spans"), "array<array<string>>"))
    opens = lambda gaps, i: F.get(gaps, i).rlike(_CLOSED) | ((i == 0) & F.get(gaps, i).rlike(r"^\s*$"))
    capital = lambda w: w.rlike(r"^\p{Lu}")
    names = F.filter(F.transform("_e", lambda w, i: F.when(capital(w) & ~opens(F.col("_h"), i), F.lower(w))), lambda w: w.isNotNull())
    ready = forms.once(split, _low=low(F.col("_t")), _src=F.array_distinct(low(F.col("_e"))), _names=names)
    asked = F.filter("_low", lambda w: ~F.array_contains("_names", w))
    block = (F.size(asked) >= 5) & (F.size(F.filter(asked, lambda w: F.array_contains("_src", w))) >= 0.9 * F.size(asked))

    def left(w: Column, i: Column) -> Column:
        inside = F.exists("_many", lambda m: F.exists(F.sequence(F.lit(0), F.size(m) - 1), lambda k: (i >= k) & (F.slice("_low", F.greatest(i - k, F.lit(0)) + 1, F.size(m)) == m)))
        named = F.coalesce(capital(F.get("_t", i + 1)), F.lit(False)) & w.isin(*NUMBER_WORDS)
        return w.isin(*marked) & F.array_contains("_src", w) & ~F.array_contains("_one", w) & ~inside & ~(capital(F.get("_t", i)) & ~opens(F.col("_g"), i)) & ~named

    found = ready.select(*by, "book", block.alias("block"), F.get(F.filter("_low", left), F.lit(0)).alias("word"))
    return found.where("block or word is not null")


def pronoun_signs(paras: DataFrame) -> DataFrame:
    """Paragraphs where he and she words both stand, so a pronoun without gender is ambiguous."""
    he, she = F.regexp_count("en", F.lit(r"(?i)\b(he|him|his)\b")), F.regexp_count("en", F.lit(r"(?i)\b(she|her|hers)\b"))
    return paras.select("book", "chapter_no", "para", he.cast("long").alias("he"), she.cast("long").alias("she")).where("he + she > 0")


def scorecard(paras: DataFrame) -> DataFrame:
    """Per chapter: paragraphs, short ones (less than half), sentences of both texts, characters, and the alarm below 85 percent."""
    ratio = T.length_ratio(F.col("tr"), F.col("en"))
    sentences = lambda c: F.sum(F.size(F.filter(F.split(c, r"[.!?…]+"), lambda x: F.trim(x) != ""))).cast("long")
    out = paras.groupBy("book", "chapter_no").agg(F.count("*").alias("paragraphs"), sentences(F.col("tr")).alias("tr_sentences"), sentences(F.col("en")).alias("en_sentences"), F.count(F.when(ratio < 0.5, 1)).alias("short"), F.sum(F.length("tr")).cast("long").alias("tr_chars"), F.sum(F.length("en")).cast("long").alias("en_chars"))
    return out.withColumn("alarm", (F.col("en_chars") > 0) & (F.col("tr_chars") < ALARM * F.col("en_chars")))


def number_mismatches(paras: DataFrame) -> DataFrame:
    """Values of a source paragraph that its translation lacks; paragraphs without a finding give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["missing"] = [",".join(f"{v:g}" for v in numbers.missing(e or "", t or "")) for e, t in zip(b.en, b.tr, strict=True)]
            yield b.loc[b.missing != "", ["book", "chapter_no", "para", "missing"]]

    return paras.mapInPandas(run, "book long, chapter_no long, para long, missing string")


def repeated_paragraphs(paras: DataFrame, alike: float = 0.85, least: int = 40) -> DataFrame:
    """Adjacent target paragraphs alike while their sources are not."""
    by = Window.partitionBy("book", "chapter_no").orderBy("para")
    near = paras.withColumn("_t", F.lag("tr").over(by)).withColumn("_e", F.lag("en").over(by)).where((F.length("tr") >= least) & (F.length("_t") >= least) & (F.least(F.length("tr"), F.length("_t")) * 2 >= alike * (F.length("tr") + F.length("_t"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [likeness.alike(x.t, x.tr, alike) and not likeness.alike(x.e, x.en, alike) for x in b.itertuples()]
            yield b.loc[keep, ["book", "chapter_no", "para"]]

    return near.select("book", "chapter_no", "para", "en", "tr", F.col("_t").alias("t"), F.col("_e").alias("e")).mapInPandas(run, "book long, chapter_no long, para long")


def stem_of(forms: Column, at: Column, least: int = 4) -> Column:
    """The stem of the form at this place (from 0) of an array of forms in order of length: the shortest form of `least` letters or
    more that the form begins with, which is itself if there is no shorter. That form is a stem of its own, as what it began with
    would be shorter still."""
    form = F.get(forms, at)
    shorter = F.filter(forms, lambda x: (F.length(x) >= least) & F.startswith(form, x))
    return F.coalesce(F.get(shorter, F.lit(0)), form)


def drift(renderings: DataFrame, hits: int = 5, chapters: int = 3, share: float = 0.08, second: int = 3) -> DataFrame:
    """Names rendered in two ways: enough hits in enough chapters, and a runner-up form with its share, inflected forms counted with
    their stem. Forms are counted before the shuffle; a name's row holds its distinct forms."""
    per = renderings.groupBy("book", "source", "form").agg(F.count("*").alias("n"), F.collect_set("chapter_no").alias("chs"))
    names = per.groupBy("book", "source").agg(F.collect_list("form").alias("forms"), F.collect_list("n").alias("counts"), F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("chs")))).alias("chapters"))
    wide = names.where((F.size("forms") > 1) & (F.col("n") >= hits) & (F.col("chapters") >= chapters)).select("book", "source", "n", F.array_sort(F.transform(F.arrays_zip("forms", "counts"), lambda x: F.struct(F.length(x["forms"]).alias("size"), x["forms"].alias("form"), x["counts"].alias("n")))).alias("f"))
    each = wide.select("book", "source", "n", F.posexplode("f").alias("at", "x"), F.col("f.form").alias("forms")).select("book", "source", "n", stem_of(F.col("forms"), F.col("at")).alias("stem"), F.col("x.n").alias("k"))
    stems = each.groupBy("book", "source", "n", "stem").agg(F.sum("k").alias("k"))
    ranked = stems.groupBy("book", "source", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "stem"))), 1, 2).alias("r")).where(F.size("r") > 1)
    out = ranked.select("book", "source", F.col("r")[0]["stem"].alias("main"), F.col("r")[1]["stem"].alias("runner_up"), "n", (-F.col("r")[1]["k"]).alias("n_runner_up"))
    return out.where(F.col("n_runner_up") >= F.greatest(F.lit(float(second)), share * F.col("n")))


def memory_examples(pairs: DataFrame, k: int = 10, damp: float = 0.3, talk: float = 1.2) -> DataFrame:
    """Greedy weighted cover per target chapter: the paragraphs of its book's earlier chapters whose words best cover the target's,
    rare words first (ln(1 + n / (1 + df)) over the n earlier paragraphs); a covered word keeps `damp` of its weight, ties go to
    the later chapter, then the earlier paragraph. Candidates meet their target by an equi-join on words; a group holds those of
    one target with the words they share with it."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        bags = [sorted(x) for x in rows.bag]
        seen = Counter(w for b in bags for w in b)
        weight = {w: math.log(1 + rows.n.iloc[0] / (1 + n)) for w, n in seen.items()}
        factor = [talk if x else 1.0 for x in rows.talk]
        score = lambda i: sum(weight[w] for w in bags[i]) * factor[i]
        heap = [(-score(i), -c, p, i) for i, (c, p) in enumerate(zip(rows.chapter_no, rows.para, strict=True))]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < k:
            was, c, p, i = heapq.heappop(heap)
            now = -score(i)
            if now != was:  # scores only fall, so what stands first with its present score is the best
                heapq.heappush(heap, (now, c, p, i))
                continue
            if now >= 0:
                break
            out.append((rows.book.iloc[0], rows.target.iloc[0], len(out), -c, p))
            for w in bags[i]:
                weight[w] *= damp
        return pd.DataFrame(out, columns=["book", "target", "pick", "chapter_no", "para"])

    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    own = paragraphs(pairs).select("book", "chapter_no", "para", bag("en").alias("bag"), F.col("en").startswith('"').alias("talk")).where(F.size("bag") > 0)
    targets = pairs.select("book", F.col("chapter_no").alias("target"), F.explode(bag("source_text")).alias("word")).distinct()
    earlier = pairs.select("book", "chapter_no").distinct().join(own.groupBy("book", "chapter_no").agg(F.count("*").alias("c")), ["book", "chapter_no"], "left")
    before = Window.partitionBy("book").orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = earlier.select("book", F.col("chapter_no").alias("target"), F.sum("c").over(before).alias("n"))
    told = own.select("book", "chapter_no", "para", "talk", F.explode("bag").alias("word"))
    shared = targets.join(told, ["book", "word"]).where("chapter_no < target").groupBy("book", "target", "chapter_no", "para", "talk").agg(F.collect_list("word").alias("bag"))
    return shared.join(counts, ["book", "target"]).groupBy("book", "target").applyInPandas(group, "book long, target long, pick long, chapter_no long, para long")


def aligned(pairs: DataFrame) -> DataFrame:
    """Every paragraph of both sides by its place; where one side has ended, its paragraph is empty."""
    side = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    p = pairs.select("book", "chapter_no", F.posexplode(F.arrays_zip(side(F.col("source_text")).alias("en"), side(F.col("translation")).alias("tr"))).alias("para", "x"))
    return p.select("book", "chapter_no", F.col("para").cast("long").alias("para"), F.coalesce("x.en", F.lit("")).alias("en"), F.coalesce("x.tr", F.lit("")).alias("tr"))


def _paras(s, d):
    """Every user turn against its answer, paragraph by paragraph."""
    return aligned(role(s, d, "pairs"))


def _self_paras(s, d):
    return _paras(s, d).withColumn("tr", F.when((F.col("para") % 2 == 0) & (F.col("en") != ""), F.col("en")).otherwise(F.col("tr")))


def _numbered(s, d):
    """Paragraphs with a number in words or figures at their end, every third lost or changed in the translation."""
    n = F.col("chapter_no") * 7 + F.col("para") * 13 + F.length("en")
    en = F.when(n % 4 == 0, F.concat("en", F.lit(" twenty "), F.lit("three soldiers"))).when(n % 4 == 1, F.concat("en", F.lit(" 3,5"), F.lit("00 men"))).when(n % 4 == 2, F.concat("en", F.lit(" three million stones"))).otherwise(F.concat("en", F.lit(" forty")))
    tr = F.when(n % 3 == 0, F.concat("tr", F.lit(" birkaç kişi"))).when(n % 4 == 0, F.concat("tr", F.lit(" yirmi üç asker"))).when(n % 4 == 1, F.concat("tr", F.lit(" 3.500 adam"))).when(n % 4 == 2, F.concat("tr", F.lit(" 3 milyon taş"))).otherwise(F.concat("tr", F.lit(" kırk")))
    return _paras(s, d).withColumn("_en", en).withColumn("tr", tr).withColumn("en", F.col("_en")).drop("_en")


def _echoed(s, d):
    """Chapters whose translation says one paragraph twice, with a word more, where the source says two."""
    c = role(s, d, "chapters").where("chapter_no is not null and source_text is not null").select(F.col("doc_id").alias("book"), F.col("chapter_no").cast("long").alias("chapter_no"), F.posexplode(F.split("source_text", "\n")).alias("para", "en"))
    rows = c.select("book", "chapter_no", F.col("para").cast("long").alias("para"), "en", F.col("en").alias("tr")).where(F.length("en") >= 40)
    by = Window.partitionBy("book", "chapter_no").orderBy("para")
    return rows.withColumn("tr", F.when(F.col("para") % 3 == 1, F.concat(F.lag("tr").over(by), F.lit(" yine"))).otherwise(F.col("tr"))).where("tr is not null")


def _renderings(s, d):
    words = role(s, d, "chapters").where("chapter_no is not null").select("book", "chapter_no", F.explode(F.regexp_extract_all("source_text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("source"))
    return words.select("book", "chapter_no", "source", F.concat(F.lower("source"), F.when(F.col("chapter_no") % 3 == 0, "lar").when(F.col("chapter_no") % 3 == 1, "").otherwise("x")).alias("form")).withColumn("form", F.when(F.col("chapter_no") % 5 == 0, F.concat(F.lit("z"), "form")).otherwise(F.col("form")))


# English prose left in a translation in every way there is, a line of a text each; terms that hold function and number words.
_RESIDUE = """(SELECT doc_id AS id, book, concat('The ', lang, ' gates stood, and Nine Herons met ten men. ', source_text) AS en, CASE doc_id % 6 WHEN 0 THEN concat('The ', lang, ' gates stood, and Nine Herons met ten men. ', source_text) WHEN 1 THEN 'Kapılar durdu, Nine Herons ten adam gördü.' WHEN 2 THEN 'Kapılar durdu. And Nine Herons on adam gördü.'
  WHEN 3 THEN 'Kapılar durdu, Nine Herons on adam gördü.' WHEN 4 THEN 'Orlo of the Nine geldi, the kapı durdu.' ELSE 'Orlo of the Nine geldi, kapı durdu.' END AS tr FROM {chapters} WHERE source_text IS NOT NULL)"""
_MARKED = "(SELECT DISTINCT book, CASE WHEN length(book) % 2 = 0 THEN 'Orlo of the Nine' ELSE 'Ten' END AS source FROM {terms})"
QUERIES = {
    "length_ratio": lambda s, d: length_ratios(role(s, d, "pairs")),
    "alphabet_leak": lambda s, d: foreign_letters(_paras(s, d)),
    "untranslated_blocks": lambda s, d: untranslated(_self_paras(s, d)),
    "function_word_residue": lambda s, d: residues(_self_paras(s, d)),
    "pronoun_sign": lambda s, d: pronoun_signs(_paras(s, d)),
    "scorecard": lambda s, d: scorecard(_paras(s, d)),
    "number_mismatch": lambda s, d: number_mismatches(_numbered(s, d)),
    "paragraph_repeats": lambda s, d: repeated_paragraphs(_echoed(s, d)),
    "english_residue": lambda s, d: english_residue(shared(s, d, _RESIDUE), ["id"], shared(s, d, _MARKED)),
    "drift_mining": lambda s, d: drift(_renderings(s, d)),
    "memory_greedy_topk": lambda s, d: memory_examples(role(s, d, "pairs")),
}
_PAIRS = sql_role("pairs")
_P = f"(SELECT book, chapter_no, i AS para, coalesce(s[i + 1], '') AS en, coalesce(t[i + 1], '') AS tr FROM (SELECT book, chapter_no, s, t, unnest(range(greatest(len(s), len(t)))) AS i FROM (SELECT book, chapter_no, string_split(coalesce(source_text, ''), chr(10)) AS s, string_split(coalesce(translation, ''), chr(10)) AS t FROM {_PAIRS} x) y) z)"
_SELF = f"(SELECT book, chapter_no, para, en, CASE WHEN para % 2 = 0 AND en <> '' THEN en ELSE tr END AS tr FROM {_P} p)"
_SMALL = "list_distinct(regexp_extract_all({}, '[\\p{{Ll}}\\p{{N}}_]{{2,}}'))"
_q = lambda x: "'" + x.replace("'", "''") + "'"
_W, _C = _q(_WORD), _q(_CLOSED)
_words, _numbers = (", ".join(map(_q, x)) for x in ((*FUNCTION_WORDS, *NUMBER_WORDS), NUMBER_WORDS))
_LETTERS = "list_distinct(string_split(regexp_replace({}, '[^\\p{{L}}]|[a-zA-Z]', '', 'g'), ''))"
ORACLE = {
    "length_ratio": f"SELECT book, chapter_no, CASE WHEN length(trim(source_text)) > 0 THEN round(length(translation) / length(source_text), 6) END AS ratio, CASE WHEN length(trim(source_text)) > 0 THEN length(translation) / length(source_text) < 0.7 END AS shortened FROM {_PAIRS} x",
    "alphabet_leak": f"SELECT * FROM (SELECT book, chapter_no, para, array_to_string(list_sort(list_filter({_LETTERS.format('tr')}, lambda x: x <> '' AND NOT list_contains({_LETTERS.format('en')}, x))), '') AS letters FROM {_P} p) q WHERE letters <> ''",
    "untranslated_blocks": f"SELECT * FROM (SELECT book, chapter_no, para, CAST(len(t) AS BIGINT) AS words, CAST(len(list_intersect(t, s)) AS BIGINT) AS shared FROM (SELECT book, chapter_no, para, {_SMALL.format('tr')} AS t, {_SMALL.format('en')} AS s FROM {_SELF} p) q) r WHERE words >= 5 AND shared >= 0.9::DOUBLE * words",
    "function_word_residue": f"SELECT book, chapter_no, count(*) AS paragraphs, CAST(sum(n) AS BIGINT) AS words FROM (SELECT book, chapter_no, len(list_filter(regexp_extract_all(tr, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('the', 'and', 'with', 'from', 'that', 'this'))) AS n FROM {_SELF} p) q WHERE n > 0 GROUP BY ALL".replace("{{", "{").replace("}}", "}"),
    "pronoun_sign": f"SELECT * FROM (SELECT book, chapter_no, para, CAST(len(regexp_extract_all(en, '(?i)\\b(he|him|his)\\b')) AS BIGINT) AS he, CAST(len(regexp_extract_all(en, '(?i)\\b(she|her|hers)\\b')) AS BIGINT) AS she FROM {_P} p) q WHERE he + she > 0",
    "scorecard": f"SELECT *, en_chars > 0 AND tr_chars < 0.85::DOUBLE * en_chars AS alarm FROM (SELECT book, chapter_no, count(*) AS paragraphs, CAST(sum(len(list_filter(regexp_split_to_array(tr, '[.!?…]+'), lambda x: trim(x) <> ''))) AS BIGINT) AS tr_sentences, CAST(sum(len(list_filter(regexp_split_to_array(en, '[.!?…]+'), lambda x: trim(x) <> ''))) AS BIGINT) AS en_sentences, count(CASE WHEN length(trim(en)) > 0 AND length(tr) / length(en) < 0.5 THEN 1 END) AS short, CAST(sum(length(tr)) AS BIGINT) AS tr_chars, CAST(sum(length(en)) AS BIGINT) AS en_chars FROM {_P} p GROUP BY ALL) q",
    "drift_mining": f"""WITH w AS (SELECT book, chapter_no, unnest(regexp_extract_all(source_text, '[A-Z][a-z]{{4,}}')) AS source FROM {sql_role('chapters')} c WHERE chapter_no IS NOT NULL), r AS (SELECT book, chapter_no, source, CASE WHEN chapter_no % 5 = 0 THEN 'z' ELSE '' END || lower(source) || CASE chapter_no % 3 WHEN 0 THEN 'lar' WHEN 1 THEN '' ELSE 'x' END AS form FROM w),
p AS (SELECT book, source, form, count(*) AS k FROM r GROUP BY ALL), n AS (SELECT book, source, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT chapter_no) >= 3 AND count(DISTINCT form) > 1),
s AS (SELECT p.book, p.source, n.n, p.k, coalesce((SELECT arg_min(q.form, (length(q.form), q.form)) FROM p q WHERE q.book = p.book AND q.source = p.source AND length(q.form) >= 4 AND starts_with(p.form, q.form)), p.form) AS stem FROM p JOIN n ON n.book = p.book AND n.source = p.source),
g AS (SELECT book, source, n, stem, CAST(sum(k) AS BIGINT) AS k, row_number() OVER (PARTITION BY book, source ORDER BY sum(k) DESC, stem) AS r FROM s GROUP BY book, source, n, stem)
SELECT a.book, a.source, a.stem AS main, b.stem AS runner_up, a.n, b.k AS n_runner_up FROM g a JOIN g b ON a.book = b.book AND a.source = b.source AND a.r = 1 AND b.r = 2 WHERE b.k >= greatest(3.0, 0.08::DOUBLE * a.n)""",
    "english_residue": f"""WITH t AS (SELECT book, list_transform(regexp_extract_all(source, '[\\p{{L}}]+'), lambda x: lower(x)) AS w FROM {duck(_MARKED)} m), p AS (SELECT id, book, regexp_extract_all(replace(tr, '’', chr(39)), {_W}) AS t, regexp_split_to_array(replace(tr, '’', chr(39)), {_W}) AS g, regexp_extract_all(replace(en, '’', chr(39)), {_W}) AS e, regexp_split_to_array(replace(en, '’', chr(39)), {_W}) AS h FROM {duck(_RESIDUE)} r),
l AS (SELECT *, list_transform(t, lambda x: lower(x)) AS low, list_transform(e, lambda x: lower(x)) AS src, list_transform(list_filter(range(1, len(e) + 1), lambda i: regexp_matches(e[i], '^\\p{{Lu}}') AND NOT (regexp_matches(h[i], {_C}) OR (i = 1 AND regexp_matches(h[i], '^\\s*$')))), lambda i: lower(e[i])) AS names FROM p),
x AS (SELECT *, list_filter(low, lambda w: NOT list_contains(names, w)) AS asked FROM l), y AS (SELECT id, book, t, g, low, src, unnest(range(1, len(low) + 1)) AS i FROM l),
f AS (SELECT id, min(i) AS i FROM y WHERE low[i] IN ({_words}) AND list_contains(src, low[i]) AND NOT (regexp_matches(t[i], '^\\p{{Lu}}') AND NOT (regexp_matches(g[i], {_C}) OR (i = 1 AND regexp_matches(g[i], '^\\s*$')))) AND NOT (coalesce(regexp_matches(t[i + 1], '^\\p{{Lu}}'), false) AND low[i] IN ({_numbers}))
 AND NOT EXISTS (SELECT 1 FROM t k WHERE k.book = y.book AND (k.w = [low[i]] OR (len(k.w) > 1 AND list_contains(k.w, low[i]) AND len(list_filter(range(1, len(k.w) + 1), lambda j: i - j + 1 >= 1 AND low[i - j + 1:i - j + len(k.w)] = k.w)) > 0))) GROUP BY id)
SELECT x.id, x.book, len(asked) >= 5 AND len(list_filter(asked, lambda w: list_contains(src, w))) >= 0.9::DOUBLE * len(asked) AS block, low[f.i] AS word FROM x LEFT JOIN f ON f.id = x.id WHERE (len(asked) >= 5 AND len(list_filter(asked, lambda w: list_contains(src, w))) >= 0.9::DOUBLE * len(asked)) OR f.i IS NOT NULL""",
}
