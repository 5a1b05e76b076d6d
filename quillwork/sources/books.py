"""Readers and writers of books and dictionaries: EPUB files, pasted texts, wiki pages with footnotes, JSON dictionaries."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages
from ..operators.graph import graph_cut

TERMS_SCHEMA = "book string, source string, target string, note string, condition string, first_chapter int"
_TAG, _BLOCK = re.compile(r"<[^>]+>"), re.compile(r"</(?:p|div|h[1-6]|li|blockquote)>|<br\s*/?>", re.IGNORECASE)


def plain_text(html: str) -> str:
    """Paragraphs of a page body, blank-line separated."""
    body = re.sub(r"(?is)<(script|style|head)\b.*?</\1>", "", html)
    parts = [unescape(_TAG.sub("", p)).strip() for p in _BLOCK.split(body)]
    return "\n\n".join(re.sub(r"\s+", " ", p) for p in parts if p)


_NO_BOOK = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError)


def _package(book: zipfile.ZipFile) -> tuple[dict[str, tuple[str, str]], list[str]]:
    """The manifest, id -> (path in the archive, media type), and the ids of the spine in reading order."""
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    root = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
    package = ElementTree.fromstring(book.read(root))
    items = {e.get("id"): (posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(e.get("href")))), e.get("media-type") or "") for e in package.iter() if e.tag.endswith("}item")}
    return items, [e.get("idref") for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]


def epub_documents(data: bytes) -> list[tuple[int, str, str]]:
    """(number, path, text) of an EPUB's spine documents in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        items, spine = _package(book)
        return [(i, p, plain_text(book.read(p).decode("utf-8", "replace"))) for i, p in enumerate((items[k][0] for k in spine), 1) if p in book.namelist()]


def epub_images(data: bytes) -> list[tuple[str, str, int, str, list[int]]]:
    """(path, media type, bytes, digest, numbers of the spine documents that show it) of an EPUB's images, by path."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        items, spine = _package(book)
        names, shown = set(book.namelist()), {}
        for i, page in enumerate((items[k][0] for k in spine), 1):
            if page in names:
                root = pages.tree(book.read(page).decode("utf-8", "replace"))
                for node in pages.select(root, "img[src], image[href], image[xlink:href]"):
                    ref = node.attrs.get("src") or node.attrs.get("href") or node.attrs.get("xlink:href") or ""
                    at = posixpath.normpath(posixpath.join(posixpath.dirname(page), unquote(ref.split("#")[0])))
                    shown.setdefault(at, set()).add(i)
        found = sorted({(p, kind) for p, kind in items.values() if kind.startswith("image/") and p in names})
        return [(p, kind, len(image := book.read(p)), hashlib.sha256(image).hexdigest(), sorted(shown.get(p, ()))) for p, kind in found]


def _epubs(spark: SparkSession, folder: str, read, columns: list[str], schema: str) -> DataFrame:
    """read(bytes) -> rows, of every EPUB under a folder; a file that is no EPUB gives none. A file is one row of the binary source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b.path, b.content, strict=True):
                try:
                    rows = read(data)
                except _NO_BOOK:
                    rows = []
                yield pd.DataFrame([(path, *r) for r in rows], columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(folder).select("path", "content")
    return files.mapInPandas(run, schema)


def read_epubs(spark: SparkSession, folder: str) -> DataFrame:
    """(file, chapter_no, path, source_text): the spine documents of every EPUB under a folder."""
    return _epubs(spark, folder, epub_documents, ["file", "chapter_no", "path", "source_text"], "file string, chapter_no int, path string, source_text string")


def read_epub_images(spark: SparkSession, folder: str) -> DataFrame:
    """(file, path, media_type, bytes, digest, chapters): the images of every EPUB under a folder and the chapters that show them."""
    return _epubs(spark, folder, epub_images, ["file", "path", "media_type", "bytes", "digest", "chapters"], "file string, path string, media_type string, bytes long, digest string, chapters array<int>")


def read_pasted(spark: SparkSession, path: str, book: str) -> DataFrame:
    """Text files, one chapter each, numbered by natural order of their names."""
    from pyspark.sql import Window

    from ..functions.text import natural_key

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("source_text"))
    return files.select(F.lit(book).alias("book"), F.row_number().over(Window.orderBy(natural_key(F.col("file")))).alias("chapter_no"), "file", "source_text")


def footnoted_sentences(pages: DataFrame) -> DataFrame:
    """pages(page, wikitext) -> (page, sentence, chapters): templates out, links to their text, and of each sentence the chapters
    its footnotes name."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("wikitext", r"\{\{[^{}]*\}\}", ""), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), r"'{2,}", "")
    sentence = F.split(clean, r"(?<=[.!?])(?=\s|<ref)(?!<ref)\s+|(?<=</ref>)\s+")
    rows = pages.select("page", F.posexplode(sentence).alias("at", "raw"))
    notes = F.transform(F.regexp_extract_all("raw", F.lit(r"(?i)<ref[^>]*>[^<]*?chapter\s+([0-9]+)[^<]*</ref>"), F.lit(1)), lambda x: x.cast("int"))
    return rows.select("page", "at", F.trim(F.regexp_replace("raw", r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", "")).alias("sentence"), F.array_sort(F.array_distinct(notes)).alias("chapters")).where("sentence <> ''")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A JSON dictionary, an object per line; `has_note` tells a note that is null in the file from one that is absent."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    fields = F.json_object_keys("value")
    return raw.select(F.from_json("value", TERMS_SCHEMA).alias("t"), fields.alias("fields")).select("t.*", F.coalesce(F.array_contains("fields", "note"), F.lit(False)).alias("has_note"))


def write_terms(terms: DataFrame, path: str) -> None:
    terms.select(F.to_json(F.struct(*terms.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, as_of: int | None) -> None:
    """The graph as `graph_cut` leaves it, nodes and edges as JSON lines."""
    for name, part in zip(("nodes", "edges"), graph_cut(nodes, edges, as_of), strict=True):
        part.write.mode("overwrite").json(f"{path}/{name}")
