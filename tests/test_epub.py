"""Images of EPUB files and the chapters that show them."""

import hashlib
import io
import zipfile

from quillwork.sources import books


def test_image_index(spark, tmp_path):
    files = {
        "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
        "O/p.opf": """<package xmlns="o"><manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/>
          <item id="i" href="img/one%20two.png" media-type="image/png"/><item id="j" href="img/j.jpg" media-type="image/jpeg"/><item id="k" href="img/gone.png" media-type="image/png"/><item id="c" href="s.css" media-type="text/css"/></manifest>
          <spine><itemref idref="b"/><itemref idref="a"/><itemref idref="x"/></spine></package>""",
        "O/t/a.xhtml": "<p>first <img src='../img/one%20two.png'><p>x<svg><image xlink:href='../img/j.jpg#v'/></svg>",
        "O/t/b.xhtml": "<p>second</p><img src='../img/one two.png'/><img src='http://x.org/y.png'/><img/>",
        "O/img/one two.png": b"PNG",
        "O/img/j.jpg": b"",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    (tmp_path / "a.epub").write_bytes(out.getvalue())
    (tmp_path / "b.epub").write_bytes(b"none")
    found = [tuple(r)[1:] for r in books.read_epub_images(spark, f"file://{tmp_path}").orderBy("path").collect()]
    assert found == [("O/img/j.jpg", "image/jpeg", 0, hashlib.sha256(b"").hexdigest(), [2]), ("O/img/one two.png", "image/png", 3, hashlib.sha256(b"PNG").hexdigest(), [1, 2])]
    told = [tuple(r)[1:] for r in books.read_epubs(spark, f"file://{tmp_path}").orderBy("chapter_no").collect()]
    assert [(n, p) for n, p, _ in told] == [(1, "O/t/b.xhtml"), (2, "O/t/a.xhtml")]
