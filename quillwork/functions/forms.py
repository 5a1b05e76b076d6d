"""Dictionary terms in source texts, by keys. A term's key is the letters of its words run together; a use of a term is a run of a
text's words whose key is one of the term's forms. An index of the forms, by the words they can begin with, goes to the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..plans.components import reliable
from ..plans.spread import spread
from . import text as T

WORD = r"[\p{L}\p{N}]+"
#: What may stand between two words of one use.
JOINT = r"^[\s_'’-]*$"
#: What a text has before a word that opens a sentence.
OPENING = r"[.!?:…][\s\"'“‘(*\[]*$"
#: Pieces that a term may be written apart in: its words, and the humps of camel case.
PIECE = r"\p{Lu}*[\p{Ll}\p{Lo}\p{Lm}]+|\p{Lu}+|\p{N}+"

#: Terms that one index may hold, some 150 MB of a worker; a larger dictionary is dealt out by book.
INDEX_TERMS = 250_000
#: Letters of a book's texts that one slice of a dealt dictionary reads.
SLICE_CHARS = 32_000_000
_WORDS, _JOINT, _OPENING, _START = re.compile(r"([^\W_]+)"), re.compile(r"(?a)[\s_'’-]*\Z"), re.compile(OPENING), re.compile(r"[\s\"'“‘(*\[]*\Z")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are worked out once per row, however often later expressions name them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def key(term: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(term, F.lit(WORD), F.lit(0)), ""))


def kept(source: Column, target: Column) -> Column:
    """Whether a term keeps its English name."""
    return T.fold_term(source) == T.fold_term(target)


def _places(pieces: Column) -> Column:
    """Letters up to the end of each piece."""
    return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.length(F.array_join(F.slice(pieces, 1, k), "")))


def term_bodies(terms: DataFrame) -> DataFrame:
    """terms(book, source, target, ...) -> its columns, `kept`, `body`, `short` and `joints`. A term's forms are its body alone and with s
    or es after it, and, where `short`, with ies for its y. The body is the key; a plural whose singular is not registered has the
    singular's, unless the name is kept. joints are the places where the term may be written apart: between its pieces, and before
    an ending."""
    last = F.element_at(F.regexp_extract_all("source", F.lit(WORD), F.lit(0)), -1)
    named = terms.withColumn("_key", key(F.col("source"))).where("_key <> ''").withColumn("kept", kept(F.col("source"), F.col("target")))
    plural = last.rlike("(?i)s$") & (F.length(last) > 3) & ~F.col("kept")
    asked = named.withColumn("_one", F.when(plural, F.expr("left(_key, length(_key) - 1)")))
    known = named.select("book", F.col("_key").alias("_one"), F.lit(True).alias("_known")).distinct()
    body = F.when(F.col("_one").isNotNull() & F.col("_known").isNull(), F.col("_one")).otherwise(F.col("_key"))
    own = asked.join(known, ["book", "_one"], "left").withColumn("body", body)
    joints = F.concat(_places(F.regexp_extract_all("source", F.lit(PIECE), F.lit(0))), F.array(F.length("body")))
    short = (F.length(last) >= 3) & F.col("body").rlike("[^aeiou]y$")
    return own.select(*terms.columns, "kept", "body", short.alias("short"), joints.alias("joints"))


def _bodies(form: str) -> Iterator[tuple[str, bool]]:
    """The bodies that a form can have, and whether it is one's short form."""
    yield form, False
    if form.endswith("s"):
        yield form[:-1], False
        if form.endswith("es"):
            yield form[:-2], False
            if form.endswith("ies"):
                yield form[:-3] + "y", True


class TermIndex:
    """Terms of a dictionary by book and body. Each word of a text is looked up as a form; runs of words are put together only from a
    word that a term of several pieces begins with, or before a detached ending. So a text costs some lookups a word, whatever the
    dictionary."""

    def __init__(self, table: pa.Table):
        self.table, self._ready = table, False

    def __getstate__(self):
        return self.table

    def __setstate__(self, table: pa.Table):
        self.__init__(table)

    def prepare(self) -> None:
        """Lookup tables, built once a worker: a row for each body, further rows of the same body, of what begins a longer run its most
        words, and by book all words that a use can begin with."""
        if self._ready:
            return
        names, bodies, self.short = (self.table.column(c).to_pylist() for c in ("book", "body", "short"))
        keys = [f"{book}\0{body}" for book, body in zip(names, bodies, strict=True)]
        self.row = dict(zip(keys, range(len(keys)), strict=True))
        self.others: dict[str, list[int]] = {}
        for k, key_ in enumerate(keys) if len(self.row) < len(keys) else ():
            if self.row[key_] != k:
                self.others.setdefault(key_, []).append(k)
        self.starts: dict[str, int] = {}
        self.joints: dict[int, frozenset] = {}
        parted = pc.list_value_length(self.table.column("joints"))
        for k in np.flatnonzero(parted.to_numpy() > 2).tolist():
            self.joints[k] = frozenset(self.table.column("joints")[k].as_py())
            cuts = sorted(j for j in self.joints[k] if j < len(bodies[k]))
            for n, cut in enumerate(cuts):
                first = f"{names[k]}\0{bodies[k][:cut]}"
                self.starts[first] = max(self.starts.get(first, 0), len(cuts) + 2 - n)
        self.first: dict[str, set[str]] = {name: set() for name in set(names)}
        for name, body, short in zip(names, bodies, self.short, strict=True):
            self.first[name].update((body, f"{body}s", f"{body}es", *((f"{body[:-1]}ies", f"{body[:-1]}i") if short else ())))
        for key_ in self.starts:
            name, _, word = key_.partition("\0")
            self.first[name].add(word)
        #: By book, of words met: the rows of the word alone, and the most words a use from it on can have.
        self.met: dict[str, dict[str, tuple[tuple[int, ...], int]]] = {name: {} for name in self.first}
        self._ready = True

    def _rows(self, book: str, form: str, cuts: list[int]) -> Iterator[int]:
        for body, shortened in _bodies(form):
            key_ = f"{book}\0{body}"
            row = self.row.get(key_)
            if row is not None:
                for k in (row, *self.others.get(key_, ())):
                    if (not shortened or self.short[k]) and all(c == len(body) or c in self.joints.get(k, ()) for c in cuts):
                        yield k

    def find(self, book: str, text: str) -> Iterator[tuple[int, int, int, bool, bool, str | None]]:
        """(row of the table, place, words, capital, whether it opens a sentence, the word before) of every use."""
        first = self.first.get(book)
        if not first:
            return
        parts = _WORDS.split(text)  # gaps and words in turn
        gaps, words = parts[::2], parts[1::2]
        low, met = [w.lower() for w in words], self.met[book]
        for at in [i for i, w in enumerate(low) if w in first]:
            told = met.get(low[at])
            if told is None:
                told = met[low[at]] = (tuple(self._rows(book, low[at], [])), self.starts.get(f"{book}\0{low[at]}", 0))
            found, most = [(row, 1) for row in told[0]], told[1]
            if at + 1 < len(low) and low[at + 1] in ("s", "es"):
                most = max(most, 2)
            if most > 1:
                form, cuts = low[at], []
                for n in range(2, min(most, len(low) - at) + 1):
                    if not _JOINT.match(gaps[at + n - 1]):
                        break
                    cuts.append(len(form))
                    form += low[at + n - 1]
                    found += [(row, n) for row in self._rows(book, form, cuts)]
            if found:
                opens = (gaps[at] != " " and bool(_OPENING.search(gaps[at]))) or (at == 0 and bool(_START.match(gaps[0])))
                own = (words[at][0].isupper(), opens, low[at - 1] if at else None)
                for row, n in found:
                    yield (row, at, n, *own)


class Dictionary:
    """Terms made ready for texts: one index that is broadcast, or of more than `most` terms a table of their bodies, which `uses` deals out
    by book together with the texts."""

    def __init__(self, terms: DataFrame, most: int = INDEX_TERMS):
        # terms without a book are no book's; columns are named anew, so that texts made of the same terms share none with them
        self.bodies, self.most = reliable(term_bodies(terms.select(*[F.col(c).alias(c) for c in terms.columns])).where("book is not null")), most
        self.fields = [f for f in self.bodies.schema.fields if f.name not in ("book", "body", "short", "joints")]
        whole = self.bodies.count() <= most
        self.index = terms.sparkSession.sparkContext.broadcast(TermIndex(self.bodies.toArrow())) if whole else None


def uses(units: DataFrame, column: str, terms: DataFrame | Dictionary) -> DataFrame:
    """units(book, ...) -> (its columns but the text, the terms' columns, kept, at, n, capital, opens, before), a row per use of a term of the
    book: its place and number of words, whether it begins with a capital and opens a sentence, and the word before it.

    Texts stay where they are, but for tables of few files: the dictionary goes to them. Beyond one index, texts and terms meet by book."""
    dictionary = terms if isinstance(terms, Dictionary) else Dictionary(terms)
    own, names = [c for c in units.columns if c != column], [f.name for f in dictionary.fields]
    found = (("at", T_.IntegerType()), ("n", T_.IntegerType()), ("capital", T_.BooleanType()), ("opens", T_.BooleanType()), ("before", T_.StringType()))
    schema = T_.StructType([*(units.schema[c] for c in own), *dictionary.fields, *(T_.StructField(*f) for f in found)])
    texts = units.select(*own, F.coalesce(F.col(column), F.lit("")).alias("_text"))
    book = own.index("book")

    def held(index: TermIndex, units_: list[pa.Array], text: pa.Array) -> pa.RecordBatch:
        index.prepare()
        of, hits = [], []
        for i, (name, x) in enumerate(zip(units_[book].to_pylist(), text.to_pylist(), strict=True)):
            now = list(index.find(name, x))
            of += [i] * len(now)
            hits += now
        place, rows = pa.array(of, pa.int64()), pa.array([h[0] for h in hits], pa.int64())
        columns = [c.take(place) for c in units_] + [c.combine_chunks() for c in index.table.select(names).take(rows).columns]
        columns += [pa.array([h[k] for h in hits], t) for k, t in zip(range(1, 6), (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def broadcast_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield held(sent.value, b.columns[: len(own)], b.column(len(own)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices one after the other, of each the terms and then the texts."""
        at, terms_, index = None, [], None
        for b in batches:
            keys = [b.column(k) for k in range(4)]
            same = np.ones(b.num_rows, bool)
            for k in keys:
                codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy()
                same[1:] &= codes[1:] == codes[:-1]
            starts = [0, *(np.flatnonzero(~same[1:]) + 1).tolist(), b.num_rows] if b.num_rows else []
            for start, end in zip(starts, starts[1:], strict=False):
                slice_, run = tuple(k[start].as_py() for k in keys[:3]), b.slice(start, end - start)
                if slice_ != at:
                    at, terms_, index = slice_, [], None
                if not keys[3][start].as_py():
                    terms_.append(pa.RecordBatch.from_struct_array(run.column(4)))
                    continue
                if terms_:
                    index, terms_ = TermIndex(pa.Table.from_batches(terms_).combine_chunks()), []
                if index:
                    yield held(index, run.column(5).flatten(), run.column(6))

    if dictionary.index is not None:
        sent = dictionary.index
        return spread(texts).mapInArrow(broadcast_index, schema)
    return _dealt(texts, dictionary).mapInArrow(met, schema)


def _dealt(texts: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(book, _part, _salt, _of_text, _term, _unit, _text): texts and terms by book, terms first. A book of more than `most` terms is in parts, each
    of which reads all texts of the book, and one of more than SLICE_CHARS letters is dealt out in as many slices, each with a copy
    of its terms. Only such books come to the driver, whose number is bounded by terms and letters over these limits."""
    own, bodies = [c for c in texts.columns if c != "_text"], dictionary.bodies
    counts = bodies.groupBy("book").agg(F.count("*").alias("_n")).join(texts.groupBy("book").agg(F.sum(F.length("_text")).alias("_c")), "book")
    upwards = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    large = counts.select("book", upwards("_n", dictionary.most).alias("_parts"), F.greatest(F.lit(1), upwards("_c", SLICE_CHARS)).alias("_salts")).where("_parts > 1 or _salts > 1")
    large = texts.sparkSession.createDataFrame(large.collect(), large.schema)
    one = lambda df: df.join(F.broadcast(large), "book", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_parts", "_salts")})
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    row = lambda *columns: F.struct(*columns)
    term, unit = row(*bodies.columns), row(*own)
    types = {c: df.select(x.alias("x")).schema["x"].dataType for c, df, x in (("_term", bodies, term), ("_unit", texts, unit))}
    left = one(bodies).select("book", F.pmod(F.xxhash64("source"), "_parts").cast("int").alias("_part"), each("_salts").alias("_salt"), F.lit(False).alias("_of_text"), term.alias("_term"), F.lit(None).cast(types["_unit"]).alias("_unit"), F.lit(None).cast("string").alias("_text"))
    right = one(texts).select("book", each("_parts").alias("_part"), F.pmod(F.xxhash64(*own, "_text"), "_salts").cast("int").alias("_salt"), F.lit(True).alias("_of_text"), F.lit(None).cast(types["_term"]).alias("_term"), unit.alias("_unit"), "_text")
    slices = ("book", "_part", "_salt")
    return left.unionByName(right).repartition(*slices).sortWithinPartitions(*slices, "_of_text")


# The same in DuckDB SQL, for oracles.
_DUCK_JOINT, _DUCK_OPENING, _DUCK_START = (p.replace("'", "''") for p in (JOINT, OPENING, r"^[\s\"'“‘(*\[]*$"))


def sql_fold(x: str) -> str:
    return f"lower(regexp_replace(trim({x}), '[\\s\\-_''’.·]+', '', 'g'))"


def sql_forms(terms: str) -> str:
    """terms: a FROM item with (book, source, target, ...)."""
    pieces = f"regexp_extract_all(source, '{PIECE}')"
    joints = f"list_append(list_transform(range(1, len({pieces}) + 1), lambda k: length(array_to_string({pieces}[1:k], ''))), length(_body))"
    return f"""(SELECT * EXCLUDE (_key, _one, _last, _body), {joints} AS joints, unnest(list_distinct(list_concat([_body, _body || 's', _body || 'es'], CASE WHEN length(_last) >= 3 AND regexp_matches(_body, '[^aeiou]y$') THEN [left(_body, length(_body) - 1) || 'ies'] ELSE [] END))) AS form FROM (
  SELECT a.*, CASE WHEN _one IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {terms} k WHERE k.book = a.book AND lower(array_to_string(regexp_extract_all(k.source, '{WORD}'), '')) = a._one) THEN _one ELSE _key END AS _body
  FROM (SELECT *, CASE WHEN regexp_matches(_last, '(?i)s$') AND length(_last) > 3 AND NOT kept THEN left(_key, length(_key) - 1) END AS _one FROM (
    SELECT t.*, lower(array_to_string(regexp_extract_all(source, '{WORD}'), '')) AS _key, regexp_extract_all(source, '{WORD}')[-1] AS _last, {sql_fold('source')} = {sql_fold('target')} AS kept FROM {terms} t) x WHERE _key <> '') a) b)"""


def sql_runs(units: str, column: str, longest: int) -> str:
    """units: a FROM item; the text stays out of the result."""
    runs = " UNION ALL ".join(f"SELECT * EXCLUDE (_w, _g), unnest(range(len(_w) - {n - 1})) AS _i, {n} AS n, _w, _g FROM s{n}" for n in range(1, longest + 1))
    split = f"SELECT * EXCLUDE ({column}), regexp_extract_all(coalesce({column}, ''), '{WORD}') AS _w, regexp_split_to_array(coalesce({column}, ''), '{WORD}') AS _g FROM {units} u"
    stages = ", ".join(f"s{n} AS (SELECT * FROM (SELECT * FROM s WHERE len(_w) >= {n}) q)" for n in range(1, longest + 1))
    return f"""(WITH s AS ({split}), {stages} SELECT * EXCLUDE (_w, _g, _i), CAST(_i AS INT) AS at, list_transform(range(1, n), lambda k: length(array_to_string(_w[_i + 1:_i + k], ''))) AS cuts, lower(array_to_string(_w[_i + 1:_i + n], '')) AS form, regexp_matches(_w[_i + 1], '^\\p{{Lu}}') AS capital,
  regexp_matches(_g[_i + 1], '{_DUCK_OPENING}') OR (_i = 0 AND regexp_matches(_g[1], '{_DUCK_START}')) AS opens, CASE WHEN _i > 0 THEN lower(_w[_i]) END AS before
  FROM ({runs}) r WHERE len(list_filter(_g[_i + 2:_i + n], lambda g: NOT regexp_matches(g, '{_DUCK_JOINT}'))) = 0)"""
