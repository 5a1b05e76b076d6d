"""Chapter store reads: lists, neighbours, windows, search, paragraphs, archives and upserts."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms
from ..functions import text as T
from ..plans.components import reliable
from ..plans.ordered import carried, ordered
from ..sources.tables import role, sql_role, table


def chapter_list(chapters: DataFrame) -> DataFrame:
    """Headers with the translated flag; html rows are other content. Ordered by book and number, missing numbers last."""
    shown = F.coalesce("content_type", F.lit("text")) != "html"
    flag = F.coalesce(F.trim("translation") != "", F.lit(False))
    return chapters.where(shown).select("book", "chapter_no", "url", "title", flag.alias("translated")).orderBy("book", F.asc_nulls_last("chapter_no"), "url")


def headers(chapters: DataFrame, urls: DataFrame) -> DataFrame:
    """Headers of the asked urls; text columns are never read."""
    return chapters.select("url", "book", "chapter_no", "title", "model").join(urls.select("url"), "url", "left_semi")


def source_coverage(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book").agg(F.count("*").alias("total"), F.count("source_text").alias("with_source"), F.count(F.when(F.trim("translation") != "", 1)).alias("translated"), F.sum(F.length("source_text")).cast("long").alias("chars"))


def newest_per_chapter(chapters: DataFrame) -> DataFrame:
    """One row per book and number, the newest; ties by the greater url."""
    return chapters.groupBy("book", "chapter_no").agg(F.max(F.struct("created_at", "url")).alias("x"), F.count("*").alias("versions")).select("book", "chapter_no", "x.url", "x.created_at", "versions")


def previous_chapter(chapters: DataFrame) -> DataFrame:
    """The chapter before: the linked one if it is there, else the greatest smaller number of the book with a text."""
    own = chapters.where("chapter_no is not null").select("book", "chapter_no", "url", "prev_url", "content_type")
    readable = F.when(F.coalesce("content_type", F.lit("text")) != "html", F.col("url"))
    near = carried(ordered(own, ["book"], ["chapter_no", "url"]), ["book"], before={"near": readable})
    there = chapters.select(F.col("url").alias("_url"), F.col("book").alias("_book"))
    return near.join(there, (F.col("prev_url") == F.col("_url")) & (F.col("book") == F.col("_book")), "left").select("url", F.coalesce("_url", "near").alias("previous"), F.col("_url").isNotNull().alias("linked"))


def window_rows(chapters: DataFrame, width: int = 30) -> DataFrame:
    """(url, earlier, chapter_no, distance): every chapter with a row for each chapter of the book in the `width` numbers before it. Numbers
    are cut into zones as wide as the window: a chapter meets its own zone and the one before, so a book of any size is many keys."""
    own = chapters.where("chapter_no is not null").select("book", "chapter_no", "url")
    zone = F.floor(F.col("chapter_no") / width)
    asked = own.select("book", "url", F.col("chapter_no").alias("_no"), F.explode(F.array(zone, zone - 1)).alias("zone"))
    near = asked.join(own.select("book", zone.alias("zone"), F.col("url").alias("earlier"), "chapter_no"), ["book", "zone"])
    return near.where((F.col("chapter_no") < F.col("_no")) & (F.col("chapter_no") >= F.col("_no") - width)).select("url", "earlier", "chapter_no", (F.col("_no") - F.col("chapter_no")).alias("distance"))


def window_before(chapters: DataFrame, width: int = 30) -> DataFrame:
    """How many chapters of the book lie in the `width` numbers before each, and their characters. Chapters are counted by number first,
    and a number's counts go to the `width` numbers after it, so no book is one task and no pairs of chapters are made."""
    own = chapters.where("chapter_no is not null").select("book", "chapter_no", "url", F.length("source_text").alias("n"))
    per = own.groupBy("book", "chapter_no").agg(F.count("*").alias("_count"), F.sum("n").alias("_chars"))
    given = per.select("book", F.explode(F.sequence(F.col("chapter_no") + 1, F.col("chapter_no") + width)).alias("chapter_no"), "_count", "_chars")
    sums = given.groupBy("book", "chapter_no").agg(F.sum("_count").alias("_count"), F.sum("_chars").alias("_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return own.join(sums, ["book", "chapter_no"], "left").select("url", zero("_count").alias("before"), zero("_chars").alias("chars_before"))


def broken_links(chapters: DataFrame) -> DataFrame:
    """Expected neighbours by number against the stored link; a link into another book is left alone."""
    told = ordered(chapters.where("chapter_no is not null").select("book", "chapter_no", "url", "prev_url"), ["book"], ["chapter_no", "url"])
    own = carried(told, ["book"], before={"expected": F.col("url")}, after={"next": F.col("url")}).drop("_block", "_at")
    inside = chapters.select(F.col("url").alias("prev_url"), F.col("book").alias("_book"))
    return own.join(inside, "prev_url", "left").where((F.col("prev_url").isNull() | (F.col("_book") == F.col("book"))) & ~F.col("prev_url").eqNullSafe(F.col("expected"))).select("book", "chapter_no", "url", "prev_url", "expected", "next")


def search(chapters: DataFrame, query: str, limit: int, context: int = 70) -> DataFrame:
    """Chapters that hold the query under the search fold: hits, and the first with its surroundings, which are cut out of the rows
    shown alone. One row above the limit is asked for, and `cut` tells whether there are more."""
    q = T.search_fold(F.lit(query))
    holding = forms.once(chapters.where("translation is not null").select("url", "translation"), _f=T.search_fold(F.col("translation"))).where(F.contains("_f", q))
    top = holding.select("url", "translation", T.occurrences(F.col("_f"), q).alias("hits"), F.position(q, F.col("_f")).alias("at")).orderBy(F.desc("hits"), "url").limit(limit + 1)
    start = F.greatest(F.lit(1), F.col("at") - context)
    shown = top.select("url", "hits", F.trim(F.regexp_replace(F.substring("translation", start, F.col("at") - start + len(query) + context), r"\s+", " ")).alias("context"))
    return shown.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("hits"), "url"))).where(F.col("_r") <= limit).select("url", "hits", "context", (F.col("_n") > limit).alias("cut"))


def paragraphs(pairs: DataFrame, separator: str = "\n") -> DataFrame:
    """Source and translation paragraphs by position, only where both have as many: a pair that does not line up is not guessed."""
    split = pairs.select("book", "chapter_no", F.split("source_text", separator).alias("s"), F.split("translation", separator).alias("t"))
    return split.where(F.size("s") == F.size("t")).select("book", "chapter_no", F.posexplode(F.arrays_zip(F.col("s").alias("en"), F.col("t").alias("tr"))).alias("para", "x")).select("book", "chapter_no", F.col("para").cast("long").alias("para"), "x.en", "x.tr")


def alignment(pairs: DataFrame, separator: str = "\n") -> DataFrame:
    """Per book: pairs, aligned ones, and their share."""
    even = F.size(F.split("source_text", separator)) == F.size(F.split("translation", separator))
    return pairs.groupBy("book").agg(F.count("*").alias("pairs"), F.count(F.when(even, 1)).alias("aligned")).withColumn("share", F.round(F.col("aligned") / F.col("pairs"), 6))


def chunks(chapters: DataFrame, max_words: int = 200, separator: str = "\n") -> DataFrame:
    """Paragraphs gathered in order into chunks of at most `max_words` words; a longer paragraph is a chunk alone."""
    sizes = F.transform(F.split("source_text", separator), lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != "")))
    start = F.array(F.lit(0)).cast("array<int>")

    def step(acc, n):
        return F.when((F.element_at(acc, -1) > 0) & (F.element_at(acc, -1) + n > max_words), F.concat(acc, F.array(n))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.element_at(acc, -1) + n)))

    return chapters.where("source_text is not null").select("url", F.posexplode(F.aggregate(sizes, start, step)).alias("chunk", "words")).select("url", F.col("chunk").cast("long").alias("chunk"), F.col("words").cast("long").alias("words"))


def keep_newest(versions: DataFrame, keep: int = 3) -> DataFrame:
    """Archive retention: the newest `keep` versions of each url."""
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("at"), F.desc("id")))).where(F.col("_r") <= keep).select("url", "id", "at")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Texts are overwritten, metadata keep their value unless a new one comes, and quality measurements survive only if both
    texts are the same, nulls compared as values."""
    n = new.select("url", *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != "url"], F.lit(True).alias("_new"))
    same = F.col("source_text").eqNullSafe(F.col("_n_source_text")) & F.col("translation").eqNullSafe(F.col("_n_translation"))
    is_new = F.col("_new").isNotNull()
    joined = old.join(n, "url", "full_outer")
    return joined.select("url", *[F.when(is_new, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in ("source_text", "translation")], F.coalesce("_n_model", "model").alias("model"), F.coalesce("_n_prev_url", "prev_url").alias("prev_url"), F.when(is_new & ~same, F.lit(None)).otherwise(F.col("quality")).alias("quality"))


def archived(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an overwrite sends to the archive: versions that are not blank and differ from what comes."""
    n = new.select("url", F.col("translation").alias("_t"))
    return old.join(n, "url").where((F.trim("translation") != "") & ~F.col("translation").eqNullSafe(F.col("_t"))).select("url", F.sha2("translation", 256).alias("digest"), "created_at")


def conflicts(edits: DataFrame, current: DataFrame) -> DataFrame:
    """Optimistic writes: an edit names the version it saw; it is applied when that still stands, else returned as a conflict."""
    c = current.select("url", F.col("version").alias("_v"))
    return edits.join(c, "url", "left").select("url", F.when(F.col("_v").isNull(), "missing").when(F.col("_v").eqNullSafe(F.col("expected")), "applied").otherwise("conflict").alias("result"))


def resolved(aliases: DataFrame) -> DataFrame:
    """aliases(alias, canonical) with every canonical that is an alias itself replaced by what it stands for, until none is: each round
    doubles the steps taken. A ring of aliases has no end and stays as it is after as many rounds as there are aliases."""
    now = reliable(aliases.select("alias", "canonical").where("alias <> canonical").dropDuplicates(["alias"]))
    for _ in range(max(1, now.count().bit_length())):
        further = now.select(F.col("alias").alias("canonical"), F.col("canonical").alias("_c"))
        after = reliable(now.join(further, "canonical", "left").select("alias", F.coalesce("_c", "canonical").alias("canonical"), F.col("_c").isNotNull().alias("_moved")))
        now = after.select("alias", "canonical")
        if after.where("_moved").isEmpty():
            break
    return now


def merge_books(chapters: DataFrame, aliases: DataFrame) -> DataFrame:
    """Book aliases resolve to their canonical book through chains of any length, and numbers that then collide keep the newest row."""
    a = resolved(aliases).select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    moved = chapters.join(a, F.col("book") == F.col("_a"), "left").withColumn("book", F.coalesce("_c", "book"))
    return moved.groupBy("book", "chapter_no").agg(F.max_by("url", F.struct("created_at", "url")).alias("url"), F.count("*").alias("merged"))


def page_records(pages: DataFrame) -> DataFrame:
    """Web page to chapter record: title, first heading, paragraphs of the body, number in the url, links of the navigation."""
    body = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    number = F.regexp_extract(path, r"([0-9]+)/?$", 1)
    return pages.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all(body, F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"), F.size(F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.when(number != "", number.cast("long")).alias("number"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


def _versions(s, d):
    return role(s, d, "calls").select(F.concat(F.lit("ch-"), F.col("chapter").cast("string")).alias("url"), "id", F.col("ts").alias("at"))


def _old(s, d):
    return role(s, d, "chapters").where("doc_id % 3 <> 0").select("url", "source_text", "translation", F.when(F.col("doc_id") % 4 > 0, F.col("model")).alias("model"), "prev_url", (F.col("doc_id") % 100 / 100).alias("quality"), "created_at")


def _new(s, d):
    change = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("translation"), F.lit("!"))).otherwise(F.col("translation"))
    return role(s, d, "chapters").where("doc_id % 5 <> 0").select("url", "source_text", change.alias("translation"), F.when(F.col("doc_id") % 6 > 0, F.lit("model-new")).alias("model"), "prev_url")


def _digested(df):
    return df.withColumn("source_text", F.sha2("source_text", 256)).withColumn("translation", F.sha2("translation", 256))


def _aliases(s):
    return s.createDataFrame([("src1", "src2"), ("src3", "src1"), ("src4", "src3"), ("src5", "src4"), ("src7", "src8")], "alias string, canonical string")


QUERIES = {
    "chapter_list_nulls_last": lambda s, d: chapter_list(role(s, d, "chapters")),
    "chapter_headers": lambda s, d: headers(role(s, d, "chapters"), role(s, d, "chapters").where("doc_id % 9 = 0 or lang = 'en'").select("url")),
    "source_coverage": lambda s, d: source_coverage(role(s, d, "chapters")),
    "latest_per_chapter": lambda s, d: newest_per_chapter(role(s, d, "chapters")),
    "prev_chapter_asof": lambda s, d: previous_chapter(role(s, d, "chapters")),
    "window30_rows": lambda s, d: window_rows(role(s, d, "chapters")),
    "window30_before": lambda s, d: window_before(role(s, d, "chapters")),
    "chain_neighbours": lambda s, d: broken_links(role(s, d, "chapters")),
    "search_context": lambda s, d: search(role(s, d, "chapters"), "idiot", 20),
    "paragraph_explode": lambda s, d: paragraphs(role(s, d, "pairs")),
    "alignment_share": lambda s, d: alignment(role(s, d, "pairs")),
    "chunk_by_words": lambda s, d: chunks(role(s, d, "chapters")),
    "archive_keep3": lambda s, d: keep_newest(_versions(s, d)),
    "upsert_chapters": lambda s, d: _digested(upsert(_old(s, d), _new(s, d))),
    "archive_on_change": lambda s, d: archived(_old(s, d), _new(s, d)),
    "optimistic_conflicts": lambda s, d: conflicts(role(s, d, "chapters").select("url", (F.col("doc_id") % 3).alias("expected")), role(s, d, "chapters").where("doc_id % 11 <> 0").select("url", (F.col("doc_id") % 4).alias("version"))),
    "merge_books": lambda s, d: merge_books(role(s, d, "chapters"), _aliases(s)),
    "page_records": lambda s, d: page_records(table(s, d, "pages")),
}
_C, _PAIRS = sql_role("chapters"), sql_role("pairs")
_FOLD = "translate(lower(translate(translation, 'Iİ', 'ıi')), 'ı', 'i')"
_OLD = f"(SELECT url, source_text, translation, CASE WHEN doc_id % 4 > 0 THEN model END AS model, prev_url, doc_id % 100 / 100 AS quality, created_at FROM {_C} x WHERE doc_id % 3 <> 0)"
_NEW = f"(SELECT url, source_text, CASE WHEN doc_id % 2 = 0 THEN translation || '!' ELSE translation END AS translation, CASE WHEN doc_id % 6 > 0 THEN 'model-new' END AS model, prev_url FROM {_C} x WHERE doc_id % 5 <> 0)"
ORACLE = {
    "chunk_by_words": f"""WITH n AS (SELECT url, list_transform(string_split(source_text, chr(10)), lambda p: [CAST(len(list_filter(string_split(p, ' '), lambda w: w <> '')) AS BIGINT)]) AS n FROM {_C} x WHERE source_text IS NOT NULL),
c AS (SELECT url, list_reduce(list_prepend([0::BIGINT], n), lambda a, x: CASE WHEN a[-1] > 0 AND a[-1] + x[1] > 200 THEN list_concat(a, x) ELSE list_append(a[1:len(a) - 1], a[-1] + x[1]) END) AS c FROM n)
SELECT url, unnest(range(len(c))) AS chunk, unnest(c) AS words FROM c""",
    "chapter_list_nulls_last": f"SELECT book, chapter_no, url, title, coalesce(trim(translation) <> '', false) AS translated FROM {_C} x WHERE coalesce(content_type, 'text') <> 'html'",
    "chapter_headers": f"SELECT url, book, chapter_no, title, model FROM {_C} x WHERE doc_id % 9 = 0 OR lang = 'en'",
    "source_coverage": f"SELECT book, count(*) AS total, count(source_text) AS with_source, count(CASE WHEN trim(translation) <> '' THEN 1 END) AS translated, CAST(sum(length(source_text)) AS BIGINT) AS chars FROM {_C} x GROUP BY book",
    "latest_per_chapter": f"SELECT book, chapter_no, arg_max(url, (created_at, url)) AS url, max(created_at) AS created_at, count(*) AS versions FROM {_C} x GROUP BY book, chapter_no",
    "prev_chapter_asof": f"WITH c AS (SELECT * FROM {_C} x), o AS (SELECT *, last_value(CASE WHEN coalesce(content_type, 'text') <> 'html' THEN url END IGNORE NULLS) OVER (PARTITION BY book ORDER BY chapter_no, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM c WHERE chapter_no IS NOT NULL) SELECT o.url, coalesce(t.url, near) AS previous, t.url IS NOT NULL AS linked FROM o LEFT JOIN c t ON o.prev_url = t.url AND o.book = t.book",
    "window30_rows": f"WITH c AS (SELECT * FROM {_C} x WHERE chapter_no IS NOT NULL) SELECT a.url, b.url AS earlier, b.chapter_no, a.chapter_no - b.chapter_no AS distance FROM c a JOIN c b ON a.book = b.book AND b.chapter_no >= a.chapter_no - 30 AND b.chapter_no < a.chapter_no",
    "window30_before": f"WITH c AS (SELECT * FROM {_C} x WHERE chapter_no IS NOT NULL) SELECT a.url, count(b.url) AS before, CAST(coalesce(sum(length(b.source_text)), 0) AS BIGINT) AS chars_before FROM c a LEFT JOIN c b ON a.book = b.book AND b.chapter_no >= a.chapter_no - 30 AND b.chapter_no < a.chapter_no GROUP BY a.url",
    "chain_neighbours": f"WITH c AS (SELECT * FROM {_C} x), o AS (SELECT *, lag(url) OVER w AS expected, lead(url) OVER w AS next FROM c WHERE chapter_no IS NOT NULL WINDOW w AS (PARTITION BY book ORDER BY chapter_no, url)) SELECT o.book, o.chapter_no, o.url, o.prev_url, expected, next FROM o LEFT JOIN c t ON o.prev_url = t.url WHERE (o.prev_url IS NULL OR t.book = o.book) AND o.prev_url IS DISTINCT FROM expected",
    "search_context": f"WITH f AS (SELECT url, translation, CAST((length({_FOLD}) - length(replace({_FOLD}, 'idiot', ''))) / 5 AS BIGINT) AS hits, instr({_FOLD}, 'idiot') AS p FROM {_C} x WHERE translation IS NOT NULL), t AS (SELECT url, hits, trim(regexp_replace(substring(translation, greatest(1, p - 70), p - greatest(1, p - 70) + 75), '\\s+', ' ', 'g')) AS context FROM f WHERE hits > 0 ORDER BY hits DESC, url LIMIT 21) SELECT url, hits, context, (SELECT count(*) FROM t) > 20 AS cut FROM t ORDER BY hits DESC, url LIMIT 20",
    "paragraph_explode": f"SELECT book, chapter_no, i AS para, s[i + 1] AS en, t[i + 1] AS tr FROM (SELECT book, chapter_no, s, t, unnest(range(len(s))) AS i FROM (SELECT book, chapter_no, string_split(source_text, chr(10)) AS s, string_split(translation, chr(10)) AS t FROM {_PAIRS} x) y WHERE len(s) = len(t)) z",
    "alignment_share": f"SELECT *, round(aligned / pairs, 6) AS share FROM (SELECT book, count(*) AS pairs, count(CASE WHEN len(string_split(source_text, chr(10))) = len(string_split(translation, chr(10))) THEN 1 END) AS aligned FROM {_PAIRS} x GROUP BY book) y",
    "archive_keep3": f"SELECT url, id, ts AS at FROM (SELECT concat('ch-', chapter) AS url, id, ts, row_number() OVER (PARTITION BY chapter ORDER BY ts DESC, id DESC) AS r FROM {sql_role('calls')} x) y WHERE r <= 3",
    "upsert_chapters": f"SELECT coalesce(o.url, n.url) AS url, sha256(CASE WHEN n.url IS NOT NULL THEN n.source_text ELSE o.source_text END) AS source_text, sha256(CASE WHEN n.url IS NOT NULL THEN n.translation ELSE o.translation END) AS translation, coalesce(n.model, o.model) AS model, coalesce(n.prev_url, o.prev_url) AS prev_url, CASE WHEN n.url IS NOT NULL AND (o.source_text IS DISTINCT FROM n.source_text OR o.translation IS DISTINCT FROM n.translation) THEN NULL ELSE quality END AS quality FROM {_OLD} o FULL JOIN {_NEW} n ON o.url = n.url",
    "archive_on_change": f"SELECT o.url, sha256(o.translation) AS digest, created_at FROM {_OLD} o JOIN {_NEW} n ON o.url = n.url WHERE trim(o.translation) <> '' AND o.translation IS DISTINCT FROM n.translation",
    "optimistic_conflicts": f"WITH c AS (SELECT * FROM {_C} x) SELECT e.url, CASE WHEN v.url IS NULL THEN 'missing' WHEN v.doc_id % 4 = e.doc_id % 3 THEN 'applied' ELSE 'conflict' END AS result FROM c e LEFT JOIN (SELECT * FROM c WHERE doc_id % 11 <> 0) v ON e.url = v.url",
    "merge_books": f"WITH b AS (SELECT CASE book WHEN 'src1' THEN 'src2' WHEN 'src3' THEN 'src2' WHEN 'src4' THEN 'src2' WHEN 'src5' THEN 'src2' WHEN 'src7' THEN 'src8' ELSE book END AS book, chapter_no, url, created_at FROM {_C} x) SELECT book, chapter_no, arg_max(url, (created_at, url)) AS url, count(*) AS merged FROM b GROUP BY book, chapter_no",
    "page_records": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS BIGINT) AS links, TRY_CAST(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([0-9]+)/?$', 1) AS BIGINT) AS number, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages",
}
