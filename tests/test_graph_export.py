"""What of a graph is written for a reader at a chapter."""

import json

from quillwork.sources import books


def test_written_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("x", "a", "Ann", 1), ("x", "b", "Bo", None), ("x", "c", "later", 9), ("x", "d", "alone", 1), ("y", "a", "other book", 1)], "book string, node string, name string, first_chapter int")
    edges = spark.createDataFrame([("x", "a", "knows", "b", 5), ("x", "a", "knows", "c", 2), ("x", "b", "knows", "a", 6), ("x", "a", "knows", "nobody", 1), ("y", "a", "knows", "b", 1), ("x", "b", "likes", "a", None)], "book string, src string, relation string, dst string, learned_at int")
    read = lambda part: sorted((json.loads(line) for f in (tmp_path / "g" / part).glob("*.json") for line in f.read_text().splitlines()), key=str)
    books.write_graph(nodes, edges, f"file://{tmp_path}/g", 5)
    assert read("edges") == [{"book": "x", "src": "a", "relation": "knows", "dst": "b", "learned_at": 5}]
    assert read("nodes") == [{"book": "x", "node": "a", "name": "Ann", "first_chapter": 1}, {"book": "x", "node": "b", "name": "Bo"}]
    books.write_graph(nodes, edges, f"file://{tmp_path}/g", None)
    assert len(read("edges")) == 4 and [n["node"] for n in read("nodes")] == ["a", "b", "c"]
