"""Numbers in running text, in digits or words, with scale words, endings and vague magnitudes: what an English and a Turkish
paragraph should share."""

from __future__ import annotations

import re
from functools import lru_cache

from . import turkish

# Number words, scale words and words for an uncounted many of the two languages.
EN_UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
EN_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
EN_SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
TR_UNITS = {w: i for i, w in enumerate("sıfır bir iki üç dört beş altı yedi sekiz dokuz".split())}
TR_TENS = {w: 10 * i for i, w in enumerate("on yirmi otuz kırk elli altmış yetmiş seksen doksan".split(), 1)}
TR_SCALES = {"yüz": 100, "bin": 10**3, "milyon": 10**6, "milyar": 10**9, "trilyon": 10**12}
EN_VAGUE = {"hundreds": 100, "thousands": 10**3, "millions": 10**6, "billions": 10**9}
TR_VAGUE = {"yüzlerce": 100, "binlerce": 10**3, "milyonlarca": 10**6, "milyarlarca": 10**9}

_TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)?")
_PAUSE = re.compile(r"[^\s\-–]")
_SENTENCE_END = re.compile(r"[.!?…]")


def _figure(token: str, thousands: str) -> float | None:
    decimal = "," if thousands == "." else "."
    if re.fullmatch(rf"[0-9]{{1,3}}(?:\{thousands}[0-9]{{3}})+(?:\{decimal}[0-9]+)?", token) or re.fullmatch(rf"[0-9]+(?:\{decimal}[0-9]+)?", token):
        return float(token.replace(thousands, "").replace(decimal, "."))
    return None


@lru_cache(maxsize=1 << 16)
def _read_word(word: str, turkish_: bool) -> tuple[str, float, bool] | None:
    """(unit, ten, scale or vague; its value; whether it has an ending, after which no number goes on)."""
    tables = (("unit", TR_UNITS), ("ten", TR_TENS), ("scale", TR_SCALES)) if turkish_ else (("unit", EN_UNITS), ("ten", EN_TENS), ("scale", EN_SCALES))
    for kind, table in tables:
        if word in table:
            return kind, float(table[word]), False
    for name, size in (TR_VAGUE if turkish_ else EN_VAGUE).items():
        if word == name or turkish_ and word.startswith(name):
            return "vague", float(size), True
    if not turkish_:
        return None
    bare = word.replace("’", "'")
    for kind, table in tables:
        for name, value in table.items():
            if len(word) > len(name) > 2 or "'" in bare:
                if turkish.parse(name, bare, "'" in bare) and bare != name:
                    return kind, float(value), True
    return None


class _Reader:
    """What has been read of the number that stands open, and all that are closed."""

    def __init__(self) -> None:
        self.found: list[float] = []
        self.vague: set[float] = set()
        self.total = self.part = 0.0
        self.open = self.range = False
        self.last: tuple[str, float] | None = None

    def close(self) -> None:
        if self.open and not self.range:
            self.found.append(self.total + self.part)
        self.total, self.part, self.open, self.range, self.last = 0.0, 0.0, False, False, None

    def word(self, kind: str, value: float) -> None:
        before = self.last
        if kind == "scale":
            if not self.open and value not in (100.0, 1000.0):
                return  # a bare scale word from a million on counts nothing
            self.part = (self.part or 1.0) * value
            if value >= 1000:
                self.total, self.part = self.total + self.part, 0.0
        elif before and before[0] == "ten" and kind == "ten":
            self.range = True  # "sixty seventy" lies between, and what follows scales no value
        elif before and (before[0] == kind == "unit" or before[0] == "unit" and kind == "ten"):
            self.close()
            self.part = value
        else:
            self.part += value
        self.open, self.last = True, (kind, value)


def read(text: str, turkish_: bool) -> tuple[list[float], set[float]]:
    """All values from left to right, and the magnitudes of an uncounted many ("thousands", "binlerce").

    "3 milyon", "three million" and "3.000.000" are one value, also with Turkish endings on it; a figure that fits neither separator
    style (a version, a date) gives none; two tens in a row are a range and no value; a capitalised English number word within a
    sentence is part of a name. Marks between words end a number, but for the comma after thousands."""
    reader, end = _Reader(), 0
    for m in _TOKEN.finditer(text):
        gap, raw = text[end : m.start()], m[0]
        begins = end == 0 or bool(_SENTENCE_END.search(gap))
        end = m.end()
        if reader.open and _PAUSE.search(gap) and not (gap.strip() == "," and reader.last and reader.last[0] == "scale" and reader.last[1] >= 1000):
            reader.close()
        if raw[0].isdigit():
            reader.close()
            value = _figure(raw, "." if turkish_ else ",")
            if value is not None:
                reader.part, reader.open, reader.last = value, True, ("unit", value)
            continue
        word = turkish.lower(raw) if turkish_ else raw.lower()
        known = _read_word(word, turkish_)
        if known is None:
            if not (word == ("ve" if turkish_ else "and") and reader.open):
                reader.close()
        elif known[0] == "vague":
            reader.close()
            reader.vague.add(known[1])
        elif not turkish_ and raw[0].isupper() and not begins:
            reader.close()
        else:
            reader.word(known[0], known[1])
            if known[2]:
                reader.close()
    reader.close()
    return reader.found, reader.vague


def values(text: str, turkish_: bool) -> list[float]:
    return read(text, turkish_)[0]


def missing(source: str, translation: str, least: float = 10) -> list[float]:
    """Values of the source from `least` on that the translation does not have, and its vague magnitudes that the translation has
    neither as such nor as a value of the same scale. A round magnitude may be told as the uncounted many of its size."""
    wanted, many = read(source, False)
    there, loose = (x | y for x, y in zip(*[(set(v), w) for v, w in (read(translation, True), read(translation, False))], strict=True))
    lost = {v for v in wanted if v >= least and v not in there and v not in loose}
    return sorted(lost | {b for b in many if b not in loose and not any(b <= v < 10 * b for v in there)})
