"""Books merged with what they own: hand cases of each clash."""

from quillwork.operators import merging
from quillwork.operators.chapters import resolved


def books(spark):
    return resolved(spark.createDataFrame([("a", "b"), ("c", "a")], "alias string, canonical string"))


def terms(spark):
    rows = [
        ("b", "Iron Wolf", "Demir", "b1", 1), ("b", "Moon", "Ay", "b2", 2), ("b", "moon", "Ay'ım", "b3", 3),  # the canonical book's own variants both stay
        ("a", "iron-wolf", "Kurt", "a1", 1), ("a", "Star", "Yıldız", "a2", 5), ("c", "STAR", "Necm", "c1", 1), ("a", "Sun", "Gün", "a3", None), ("a", "sun", "Güneş", "a4", 9), ("z", "Moon", "Mah", "z1", 1),
    ]
    return spark.createDataFrame(rows, "book string, source string, target string, node string, created_at int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms_and_nodes(spark):
    found = rows(merging.merged_terms(terms(spark), books(spark)).select("book", "node", "from_book"))
    assert found == sorted([("b", "b1", "b"), ("b", "b2", "b"), ("b", "b3", "b"), ("b", "a2", "a"), ("b", "a4", "a"), ("z", "z1", "z")], key=repr)
    to = {r.node: (r.to_book, r.to_node) for r in merging.node_map(terms(spark), books(spark)).collect()}
    assert to == {"b1": ("b", "b1"), "b2": ("b", "b2"), "b3": ("b", "b3"), "a1": ("b", "b1"), "a2": ("b", "a2"), "c1": ("b", "a2"), "a3": ("b", "a4"), "a4": ("b", "a4"), "z1": ("z", "z1")}


def test_edges_values_and_owned(spark):
    t, b = terms(spark), books(spark)
    nodes = merging.node_map(t, b)
    edges = spark.createDataFrame([("b", "b1", "near", "b2", "own"), ("a", "a1", "near", "b2", "clash of another id"), ("a", "a1#x", "near", "a2", "sense"), ("c", "c1", "near", "c9", "unknown end"), ("a", "a3", "near", "a4", "becomes a loop"), ("b", "b2", "near", "b2", "own loop"), ("z", "z1", "near", "z1", "z")], "book string, src string, relation string, dst string, evidence string")
    assert rows(merging.merged_edges(edges, nodes, b)) == sorted([("b", "b1", "near", "b2", "own"), ("b", "b1#x", "near", "a2", "sense"), ("b", "a2", "near", "c9", "unknown end"), ("b", "b2", "near", "b2", "own loop"), ("z", "z1", "near", "z1", "z")], key=repr)
    values = spark.createDataFrame([("b", "b1", "k", 1, "own"), ("a", "a1", "k", 1, "gives way"), ("a", "a1", "k", 2, "later"), ("c", "c1", "k", None, "x")], "book string, node string, key string, learned_at int, value string")
    assert rows(merging.merged_values(values, nodes, b)) == sorted([("b", "b1", "k", 1, "own"), ("b", "b1", "k", 2, "later"), ("b", "a2", "k", None, "x")], key=repr)
    senses = spark.createDataFrame([("a", "a1", "gives way"), ("a", "a2", "comes along"), ("b", "nobody", "own"), ("a", "nobody", "goes")], "book string, node string, sense string")
    assert rows(merging.merged_owned(senses, t, b)) == [("b", "a2", "comes along"), ("b", "nobody", "own")]
    rejected = spark.createDataFrame([("b", "k", "own"), ("a", "k", "again"), ("c", "m", "1"), ("a", "m", "2")], "book string, key string, target string")
    assert rows(merging.merged_rejections(rejected, b)) == [("b", "k", "own"), ("b", "m", "2")]
    assert rows(merging.merged_history(senses, b)) == sorted((("b", n, s) for _, n, s in map(tuple, senses.collect())), key=repr)
