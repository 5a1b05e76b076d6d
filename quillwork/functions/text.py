"""Column functions on text: folds, search, ratios, sentence and word splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\s\-_'’.·]+"
WORD = r"[\p{L}\p{N}_]+"


def fold_term(x: Column) -> Column:
    """Comparison key: separators out, lower case; never shown."""
    return F.lower(F.regexp_replace(F.trim(x), SEPARATORS, ""))


def normalise_source(x: Column) -> Column:
    """Outer punctuation and a possessive ending out."""
    return F.regexp_replace(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"['’]s$", "")


def turkish_lower(x: Column) -> Column:
    """Dotted and dotless i keep apart, and the length stays."""
    return F.lower(F.translate(x, "Iİ", "ıi"))


def search_fold(x: Column) -> Column:
    """As turkish_lower, then both i are one, so that a search finds either."""
    return F.translate(turkish_lower(x), "ı", "i")


def plain_letters(x: Column) -> Column:
    return F.translate(turkish_lower(x), "ığüşöçâîû", "igusocaiu")


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping count."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(0)


def length_ratio(translation: Column, source: Column) -> Column:
    """Null where there is nothing to measure against: not measured is not the same as zero."""
    return F.when(F.length(F.trim(source)) > 0, F.length(translation) / F.length(source))


def jaccard(a: Column, b: Column) -> Column:
    """Null when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both)


def natural_key(x: Column) -> Column:
    """Sort key by which page10 follows page9: digit runs padded to equal width."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"([0-9]+)", "000000000000$1"), r"0*([0-9]{12})(?![0-9])", "$1")


def non_space(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"\s+", ""))


def tail_words(x: Column, n: int) -> Column:
    """The last n words, single-spaced; null and blank texts give an empty one."""
    found = F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(found, F.greatest(F.size(found) - n, F.lit(0)) + 1, n), " ")


def last_sentences(x: Column, n: int) -> Column:
    parts = F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"(?<=[.!?…])\s+")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n, F.lit(0)) + 1, n), " ")


def marked_parts(x: Column, n: Column) -> Column:
    """The texts after the markers [[1]] to [[n]], in order of number; null unless the numbers are 1 to n, each once, and every
    text has something in it."""
    marker = r"\[\[([0-9]+)\]\]"
    numbers = F.transform(F.regexp_extract_all(x, F.lit(marker), F.lit(1)), lambda k: k.cast("int"))
    texts = F.transform(F.slice(F.split(x, marker, -1), 2, 1 << 30), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    ordered = F.array_sort(F.arrays_zip(numbers.alias("k"), texts.alias("t")))
    whole = (n > 0) & (F.array_sort(numbers) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))) & ~F.exists(texts, lambda t: t == "")
    return F.when(whole, F.transform(ordered, lambda p: p["t"]))


def slug(x: Column, prefix: str) -> Column:
    """Lower-case letters and digits with hyphens between, after a prefix; null where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s != "", F.concat(F.lit(f"{prefix}-"), s))


def head_word(x: Column) -> Column:
    """Of "X of Y" the last word of X, else the last word."""
    return F.regexp_extract(F.regexp_replace(x, r"(?i)\s+of\s.*$", ""), r"(\S+)\s*$", 1)
