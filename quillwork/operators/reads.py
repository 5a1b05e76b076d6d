"""Reads of the chapter store: single chapters, rows with texts, exact predecessors, selections for export, backfills, page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import numbered
from ..sources.tables import duck, role, shared, sql_role

#: Finished jobs that are kept.
KEPT_JOBS = 50


def chapter(chapters: DataFrame, url: str) -> DataFrame:
    """The full row of a translated chapter: a filter on the key, which reaches the scan."""
    return chapters.where((F.col("url") == url) & (F.trim("translation") != ""))


def staged(chapters: DataFrame, url: str) -> DataFrame:
    """The full row whatever the state of its translation."""
    return chapters.where(F.col("url") == url)


def with_source(chapters: DataFrame) -> DataFrame:
    """What a change of a term can be measured on: rows with a source text."""
    return chapters.where("source_text is not null and trim(source_text) <> ''").select("book", "chapter_no", "url", "title", "source_text", "translation")


def with_both(chapters: DataFrame, book: str | None = None) -> DataFrame:
    """Rows with both texts, of all books or of one."""
    both = chapters.where("trim(source_text) <> '' and trim(translation) <> ''").select("book", "chapter_no", "url", "model", "source_text", "translation")
    return both if book is None else both.where(F.col("book") == book)


def exact_previous(chapters: DataFrame) -> DataFrame:
    """(url, previous, linked): the chapter of the number before that has a source text; of several the linked one, else the newest,
    ties by url."""
    own = chapters.where("chapter_no is not null").select("book", "chapter_no", "url", "prev_url")
    before = chapters.where("trim(source_text) <> ''").select("book", (F.col("chapter_no") + 1).alias("chapter_no"), F.col("url").alias("previous"), "created_at")
    linked = F.coalesce(F.col("previous") == F.col("prev_url"), F.lit(False))
    best = own.join(before, ["book", "chapter_no"]).groupBy("url").agg(F.max(F.struct(linked.alias("linked"), "created_at", "previous")).alias("x"))
    return best.select("url", "x.previous", "x.linked")


def matching_events(events: DataFrame, **given: object) -> DataFrame:
    """The conjunction of the conditions that are given, by column; a pair is a closed range, and what is None asks nothing."""
    test = F.lit(True)
    for column, value in given.items():
        if isinstance(value, tuple):
            test = test & F.col(column).between(*value)
        elif value is not None:
            test = test & (F.col(column) == value)
    return events.where(test)


def export_selection(chapters: DataFrame, start: int, count: int) -> DataFrame:
    """(book, url, place): of each book the first `count` numbered chapters from `start` on; a book without numbers gives all, by url."""
    told = chapters.where("trim(translation) <> ''").select("book", "chapter_no", "url")
    ends = told.groupBy("book").agg(F.max("chapter_no").alias("last"))
    asked = told.join(ends, "book").where("last is null or chapter_no >= " + str(int(start)))
    ranked = numbered(asked, ["book"], ["chapter_no", "url"])
    return ranked.where(F.col("last").isNull() | (F.col("place") <= count)).select("book", "url", F.col("place").cast("long").alias("place"))


def backfill(chapters: DataFrame, shelf: DataFrame) -> DataFrame:
    """Books that have chapters and no place on the shelf, with their newest chapter (ties by url)."""
    newest = chapters.groupBy("book").agg(F.max(F.struct("created_at", "url", "title", "chapter_no")).alias("x"))
    return newest.join(shelf.select("book"), "book", "left_anti").select("book", "x.url", "x.title", "x.chapter_no", "x.created_at")


def page_paragraphs(html: Column) -> Column:
    """array<struct<at, text>>: a page's paragraphs by their style's order or data attribute, then as written; advertisements
    (an ad class) are left out."""
    written = F.regexp_extract_all(html, F.lit(r"(?s)<p\b[^>]*>.*?</p>"), F.lit(0))
    honest = F.filter(written, lambda p: ~p.rlike(r"""^<p\b[^>]*class=["'][^"']*\b(?:ads?|advert|sponsor)\b"""))
    order = lambda p: F.regexp_extract(p, r"""^<p\b[^>]*?(?:order:\s*|data-order=["'])(-?[0-9]+)""", 1)
    body = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?s)<[^>]*>", ""), r"\s+", " "))
    placed = F.transform(honest, lambda p, i: F.struct(F.when(order(p) != "", order(p).cast("int")).otherwise(i).alias("at"), i.alias("k"), body(p).alias("text")))
    return F.transform(F.array_sort(placed), lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text")))


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, paragraphs, text): the page's paragraphs in reading order."""
    found = pages.select("page_id", page_paragraphs(F.col("html")).alias("p"))
    return found.select("page_id", F.size("p").cast("long").alias("paragraphs"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, previous, next): the links whose text or rel names the chapter before and after; the first of each counts."""
    links = F.regexp_extract_all("html", F.lit(r"(?s)<a\b[^>]*>.*?</a>"), F.lit(0))
    said = lambda word: F.get(F.filter(links, lambda a: F.lower(a).rlike(rf"""rel=["']{word}|>[^<]*\b{word}""")), F.lit(0))
    href = lambda a: F.nullif(F.regexp_extract(a, r"""href=["']([^"']*)""", 1), F.lit(""))
    return pages.select("page_id", href(said("prev")).alias("previous"), href(said("next")).alias("next"))


def pruned_jobs(jobs: DataFrame, keep: int = KEPT_JOBS) -> DataFrame:
    """Per book the jobs that stay: all that run, and of the finished the newest, so that `keep` are left where so many are finished."""
    running = F.col("state") == "running"
    busy = jobs.groupBy("book").agg(F.count(F.when(running, 1)).alias("_n"))
    counted = jobs.withColumn("_running", running).join(busy, "book")
    ranked = numbered(counted, ["book", "_running"], [F.desc("updated_at"), F.desc("id")], "_r")
    return ranked.where(running | (F.col("_r") + F.col("_n") <= keep)).select("id", "book", "state", "updated_at")


_digest = lambda df: df.select(*[F.sha2(F.col(c), 256).alias(c) if c in ("source_text", "translation") else F.col(c) for c in df.columns])
#: Chapters in two versions of one number, so that predecessors are not unique.
_DOUBLED = "(SELECT * FROM {chapters} UNION ALL SELECT concat(url, ':b'), book, chapter_no, title, source_text, translation, content_type, model, prev_url, created_at + 7, lang, doc_id FROM {chapters} WHERE doc_id % 4 = 0)"
_UNNUMBERED = "(SELECT book, CASE WHEN length(book) = 4 THEN NULL ELSE chapter_no END AS chapter_no, url, translation FROM {chapters})"
_PAGES = "concat('<p style=\"order: 3\">third ', page_id, '</p><p class=\"x ads\">buy</p><p data-order=\"1\">first <b>', page_id % 7, '</b></p><p style=\"order:2\"> second </p>', CASE WHEN page_id % 3 = 0 THEN '<p>last</p>' ELSE '' END, '<a href=\"/c/', page_id - 1, '\" rel=\"prev\">back</a><a class=\"n\" href=\"/c/', page_id + 1, '\">Next chapter</a><a href=\"/toc\">index</a>')"


def _pages(s, d):
    from ..sources.tables import table

    return table(s, d, "pages").select("page_id", F.expr(_PAGES).alias("html"))


QUERIES = {
    "chapter_by_url": lambda s, d: _digest(chapter(role(s, d, "chapters"), "doc:8")),
    "staged_by_url": lambda s, d: _digest(staged(role(s, d, "chapters"), "doc:10")),
    "rows_with_source": lambda s, d: _digest(with_source(role(s, d, "chapters"))),
    "rows_with_both": lambda s, d: _digest(with_both(role(s, d, "chapters"))),
    "book_rows_with_both": lambda s, d: _digest(with_both(role(s, d, "chapters"), "src2")),
    "exact_previous": lambda s, d: exact_previous(shared(s, d, _DOUBLED)),
    "optional_filters": lambda s, d: matching_events(role(s, d, "calls"), outcome="error", model=None, duration_ms=(100, 9000), stage="stage-1"),
    "export_selection": lambda s, d: export_selection(shared(s, d, _UNNUMBERED), 5, 12),
    "shelf_backfill": lambda s, d: backfill(role(s, d, "chapters"), role(s, d, "chapters").where("length(book) = 4").select("book").distinct()),
    "page_reordered": lambda s, d: page_text(_pages(s, d)),
    "page_neighbours": lambda s, d: page_links(_pages(s, d)),
    "pruned_jobs": lambda s, d: pruned_jobs(role(s, d, "jobs")),
}
_C, _J = sql_role("chapters"), sql_role("jobs")
_ALL = "url, book, chapter_no, title, sha256(source_text) AS source_text, sha256(translation) AS translation, content_type, model, prev_url, created_at, lang, doc_id"
_BOTH = f"SELECT book, chapter_no, url, model, sha256(source_text) AS source_text, sha256(translation) AS translation FROM {_C} c WHERE trim(source_text) <> '' AND trim(translation) <> ''"
ORACLE = {
    "chapter_by_url": f"SELECT {_ALL} FROM {_C} c WHERE url = 'doc:8' AND trim(translation) <> ''",
    "staged_by_url": f"SELECT {_ALL} FROM {_C} c WHERE url = 'doc:10'",
    "rows_with_source": f"SELECT book, chapter_no, url, title, sha256(source_text) AS source_text, sha256(translation) AS translation FROM {_C} c WHERE trim(source_text) <> ''",
    "rows_with_both": _BOTH,
    "book_rows_with_both": _BOTH + " AND book = 'src2'",
    "exact_previous": f"WITH c AS (SELECT * FROM {duck(_DOUBLED)} q), j AS (SELECT a.url, b.url AS previous, coalesce(b.url = a.prev_url, false) AS linked, row_number() OVER (PARTITION BY a.url ORDER BY coalesce(b.url = a.prev_url, false) DESC, b.created_at DESC, b.url DESC) AS r FROM c a JOIN c b ON a.book = b.book AND b.chapter_no = a.chapter_no - 1 AND trim(b.source_text) <> '') SELECT url, previous, linked FROM j WHERE r = 1",
    "optional_filters": f"SELECT * FROM {sql_role('calls')} c WHERE outcome = 'error' AND duration_ms BETWEEN 100 AND 9000 AND stage = 'stage-1'",
    "export_selection": f"WITH t AS (SELECT book, chapter_no, url, max(chapter_no) OVER (PARTITION BY book) AS last FROM {duck(_UNNUMBERED)} q WHERE trim(translation) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chapter_no NULLS FIRST, url) AS place FROM t WHERE last IS NULL OR chapter_no >= 5) SELECT book, url, place FROM r WHERE last IS NULL OR place <= 12",
    "shelf_backfill": f"SELECT book, url, title, chapter_no, created_at FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY created_at DESC, url DESC) AS r FROM {_C} c WHERE length(book) <> 4) q WHERE r = 1",
    "page_reordered": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 4 ELSE 3 END AS paragraphs, concat('first ', page_id % 7, chr(10), chr(10), 'second', chr(10), chr(10), 'third ', page_id, CASE WHEN page_id % 3 = 0 THEN concat(chr(10), chr(10), 'last') ELSE '' END) AS text FROM pages".replace("CASE WHEN page_id % 3 = 0 THEN 4 ELSE 3 END", "CAST(CASE WHEN page_id % 3 = 0 THEN 4 ELSE 3 END AS BIGINT)"),
    "page_neighbours": "SELECT page_id, concat('/c/', page_id - 1) AS previous, concat('/c/', page_id + 1) AS next FROM pages",
    "pruned_jobs": f"SELECT id, book, state, updated_at FROM (SELECT *, count(CASE WHEN state = 'running' THEN 1 END) OVER (PARTITION BY book) AS n, row_number() OVER (PARTITION BY book, state = 'running' ORDER BY updated_at DESC, id DESC) AS r FROM {_J} j) q WHERE state = 'running' OR r + n <= {KEPT_JOBS}",
}
