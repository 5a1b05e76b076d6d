"""Pages by hand, and the tables' pages against patterns that know how they are made."""

import html as entities
import re

from quillwork.functions import pages as H
from quillwork.operators import pages
from quillwork.operators.pages import Site, chapter

SITE = [Site("x.org", "#content, div.text", title=(".none", "h1.t", "h2"), previous=("a.prev", "a[rel=prev]"), next=("a[title*='Next']",))]


def texts(html, selector="p"):
    return [n.text() for n in H.select(H.tree(html), selector)]


def test_broken_markup():
    assert texts("<p>a<p>b <b>c<p>d</b></p></div>e<p>f") == ["a", "b c", "d", "f"]
    assert texts("<div><p>a<div><p>b</p></div>c</p></div>") == ["a", "b"]
    assert texts("<p>a<br>b<img src=x>c</p>") == ["a b c"]
    assert texts("<p>1 &lt; 2 &amp; <!-- no --> 3</p><script>var t='</p><p>no';</script><p>x</p>") == ["1 < 2 & 3", "x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li") == ["a", "b c", "c", "d"]
    assert texts("<p") == [] and texts("") == [] and texts("</p></p>x") == []
    deep = "<div>" * 20_000 + "<p>deep</p>"
    assert texts(deep) == ["deep"]


def test_selectors():
    page = "<div id=a class='x y'><p class=x>1</p><span><a href='/n/1' title='Go Next'>2</a></span></div><p>3</p><a data-k>4</a>"
    for selector, found in (("p", ["1", "3"]), ("#a p", ["1"]), (".x.y span a", ["2"]), ("div.x > p", []), ("a[href^='/n']", ["2"]), ("a[title*='Next']", ["2"]), ("[data-k]", ["4"]), ("p.x, span", ["1", "2"]), ("#a[class='x y'] *", ["1", "2", "2"]), ("span p", [])):
        assert texts(page, selector) == found, selector


def test_order():
    page = lambda body, more="": f"<h2>Chapter 12: On</h2><div id=content {more}>{body}</div>"
    read = lambda html: chapter(html, "https://m.x.org/b/7/", SITE)[:4]
    assert read(page('<p style="order: 2">b</p><p data-reader-order-index="1">a</p><p style="order:10"> c <i>d</i></p>')) == ("read", "Chapter 12: On", 3, "a\n\nb\n\nc d")
    assert read(page('<p style="order:2">b</p><p>a</p>'))[0] == "order unknown"  # half are marked
    assert read(page('<p style="order:2">b</p><p>a</p><p>c</p>')) == ("read", "Chapter 12: On", 3, "b\n\na\n\nc")
    assert read(page("<p>b</p><p>a</p>", "data-reader-order-count=2"))[0] == "order unknown"
    assert read(page('<p style="order:1">b</p><p style="order:1">a</p>'))[0] == "order unknown"
    assert read(page("plain <script>no</script><div class='ads'>no</div>text")) == ("read", "Chapter 12: On", 0, "plain\ntext")


def test_record():
    html = "<title>T</title><h1 class=t> A tale </h1><a class=prev href='#'>x</a><a rel=prev href='6'>p</a><a title='Go Next' href='/b/8'>n</a><div class=text><p>one<ins>no</ins></p></div>"
    assert chapter(html, "https://x.org/b/7", SITE) == ("read", "A tale", 1, "one", "https://x.org/b/6", "https://x.org/b/8", 7)
    assert chapter(html, "https://y.org/b/7", SITE)[0] == "unknown site" and chapter(html, "https://notx.org/", SITE)[0] == "unknown site"
    assert chapter("<title>T</title>", "https://x.org/b", SITE) == ("no content", "T", None, None, None, None, None)


def test_on_tables(spark, data):
    given = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = pages.QUERIES["site_chapters"](spark, data).collect()
    assert len(found) == len(given) and {r.status for r in found} >= {"read"}
    for r in found:
        page = given[r.page_id]
        host = re.match(r"[a-z]+://([^/?#]+)", page.url)[1]
        if not host.endswith(("example.com", "example.net")):
            assert r.status == "unknown site"
            continue
        body = re.search(r"(?s)<article>(.*?)</article>", page.html)
        if not body:
            continue
        plain = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"<p>|</p>", re.sub(r"(?s)<h1>.*?</h1>", "", body[1]))]
        assert r.status == "read" and re.sub(r"\s+", "", r.text) == re.sub(r"\s+", "", "".join(plain)) and r.paragraphs == len([p for p in plain if p])
    empty = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert [r.status for r in pages.site_chapters(empty, pages.SITES).collect()] == ["unknown site"]
