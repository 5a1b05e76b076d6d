"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by a keyed Feistel network within their
format, so that equal values stay linked across documents however they are written."""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, table

ROUNDS = 10
#: The setting of the session that holds the key, in hexadecimal, as a secret store hands it out.
KEY_SETTING = "spark.quillwork.pseudonym.key"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): a balanced network on the next even number of bits, walked until it falls inside."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, width = (1 << half) - 1, -(-half // 8)
    digest = min(64, max(8, width))
    x = value
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            out = b"".join(hashlib.blake2b(bytes([r, i]) + tweak + right.to_bytes(width, "big"), key=key, digest_size=digest).digest() for i in range(-(-width // digest)))
            left, right = right, left ^ (int.from_bytes(out, "big") & mask)
        x = left << half | right
        if x < size:
            return x


def luhn_digit(payload: str) -> str:
    total = sum((x * 2 - 9 * (x > 4) if i % 2 == 0 else x) for i, x in enumerate(int(c) for c in reversed(payload)))
    return str(-total % 10)


def _digits(value: str, key: bytes, tweak: str) -> str:
    return str(feistel(int(value), 10 ** len(value), key, f"{tweak}{len(value)}".encode())).zfill(len(value))


def card(digits: str, key: bytes) -> str | None:
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = _digits(digits[:-1], key, "card")
    return payload + luhn_digit(payload)


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def iban(value: str, key: bytes) -> str | None:
    """The account part is permuted character class by character class; the check digits are made anew."""
    country, check, account = value[:2], value[2:4], value[4:]
    if not 15 <= len(value) <= 34 or int("".join(str(int(c, 36)) for c in account + country + check)) % 97 != 1:
        return None
    new = characters(account, key, "iban")
    return f"{country}{_iban_check(country, new):02d}{new}"


def ssn(digits: str, key: bytes) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if len(digits) != 9 or not valid(digits):
        return None
    out = _digits(digits, key, "ssn")
    while not valid(out):
        out = _digits(out, key, "ssn")
    return out


def phone(digits: str, key: bytes) -> str | None:
    """The country code (given apart) stays; the subscriber's digits are permuted, a leading 0 or 1 only among such."""
    if not 7 <= len(digits) <= 14:
        return None
    low = digits[0] in "01"
    out = _digits(digits, key, "phone")
    while (out[0] in "01") != low:
        out = _digits(out, key, "phone")
    return out


def ipv4(value: int, key: bytes) -> int | None:
    """Addresses that name no host of their own (this network, loopback, multicast and above) stay."""
    own = lambda x: x >> 24 not in (0, 127) and x >> 24 < 224
    if not own(value):
        return None
    out = feistel(value, 1 << 32, key, b"ipv4")
    while not own(out):
        out = feistel(out, 1 << 32, key, b"ipv4")
    return out


def day(value: date, key: bytes) -> date | None:
    if not FIRST_DAY <= value.toordinal() <= LAST_DAY:
        return None
    return date.fromordinal(FIRST_DAY + feistel(value.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date"))


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_CLASS = {c: a for a in _ALPHABETS for c in a}


def characters(value: str, key: bytes, tweak: str) -> str:
    """A permutation of all strings of one shape: each character moves within its class, other characters stay."""
    number, size, shape = 0, 1, []
    for c in value:
        alphabet = _CLASS.get(c)
        shape.append(alphabet or c)
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    number = feistel(number, size, key, f"{tweak}{'/'.join(str(len(a)) for a in shape)}".encode())
    out = []
    for a in reversed(shape):
        if len(a) == 1:
            out.append(a)
        else:
            number, k = divmod(number, len(a))
            out.append(a[k])
    return "".join(reversed(out))


def email_local(local: str, key: bytes) -> str:
    """Addresses are linked whatever their case: the permutation runs on the lower-case form, capitals are put back in place."""
    low = local.lower()
    if len(low) != len(local):
        return characters(local, key, "email")
    out = characters(low, key, "email")
    while out == low and any(c in _CLASS for c in low):
        out = characters(out + "a", key, "email")[:-1]
    return "".join(o.upper() if c.isupper() and len(o.upper()) == 1 else o for o, c in zip(out, local, strict=True))


# A run of an address's characters is looked at once, from its start: marks before the first letter or digit are not part of it.
_EMAIL = r"(?<![\w.+-])[_.+-]*+(?P<local>[^\W_][\w.+-]*+)@(?P<domain>[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"
_PHONE = r"(?<![\w.+-])(?P<country>\+\d{1,3})[ .-]?(?P<phone>\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4})(?![\w]|[.-]\d)"
_NANP = r"(?<![\w.+-])(?P<nanp>\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w]|[.-]\d)"
_DATE = r"(?<![\w./-])(?P<date>(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{2})(?P=s1)(?P<d1>\d{2})|(?P<a2>\d{1,2})(?P<s2>[-/.])(?P<b2>\d{1,2})(?P=s2)(?P<y2>(?:19|20)\d{2}))(?:(?=[Tt]\d{2})|(?![\w]|[./-]\d))"
_SSN = r"(?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w]|[.-]\d)"
_IPV4 = r"(?<![\w.])(?P<ipv4>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)"
_IBAN = r"(?<![\w])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w])"
_CARD = r"(?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w]|[.-]\d)"
PATTERN = re.compile("|".join((_EMAIL, _PHONE, _NANP, _SSN, _DATE, _IPV4, _IBAN, _CARD)).replace(r"\d", "[0-9]"))
KINDS = ("email", "phone", "card", "iban", "ssn", "ipv4", "date")


def _refill(shape: str, characters_: str) -> str:
    new = iter(characters_)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def _bare(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


# The lengths of the IBAN registry.
_IBAN_LENGTHS = "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HN28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in _IBAN_LENGTHS.split()}


def _card_length(digits: str) -> int:
    """The length that the issuer's cards nearly always have, 0 where there is no usual one."""
    return 15 if digits[:2] in ("34", "37") else 16 if digits[0] == "4" or "51" <= digits[:2] <= "55" or "2221" <= digits[:4] <= "2720" else 0


def _starts(value: str, usual: int) -> list[str]:
    """The value and what it begins with up to a separator, since words and numbers beside a value may match with it: those of
    the usual length first, then the longer first."""
    cuts = [value, *(value[:i] for i in range(len(value) - 1, 0, -1) if value[i] in " -")]
    return sorted(cuts, key=lambda x: len(_bare(x)) != usual)


def _first_valid(kind, permute, values, fits, key):
    for value in values:
        new = permute(_bare(value), key) if fits(value) else None
        if new:
            return kind, _refill(value, new)
    return None


def replacement(m: re.Match, key: bytes) -> tuple[str, str] | None:
    """(kind, pseudonym) of a match whose value is valid in its format; None leaves the text as it is. A card or an IBAN that is
    only the first part of the match gives a pseudonym of that part's length."""
    g = m.groupdict()
    if g["local"]:
        return "email", f"{m[0][: m.start('local') - m.start()]}{email_local(g['local'], key)}@{g['domain']}"
    if g["country"]:
        new = phone(_bare(g["phone"]), key)
        return new and ("phone", m[0][: len(m[0]) - len(g["phone"])] + _refill(g["phone"], new))
    if g["nanp"]:
        new = phone(_bare(g["nanp"]), key)
        return new and ("phone", _refill(g["nanp"], new))
    if g["ssn"]:
        new = ssn(_bare(g["ssn"]), key)
        return new and ("ssn", _refill(g["ssn"], new))
    if g["date"]:
        return _dated(g, key)
    if g["ipv4"]:
        parts = [int(x) for x in g["ipv4"].split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in g["ipv4"].split(".")):
            return None
        new = ipv4(int.from_bytes(bytes(parts), "big"), key)
        return new and ("ipv4", ".".join(map(str, new.to_bytes(4, "big"))))
    if g["iban"]:
        usual = IBAN_LENGTHS.get(g["iban"][:2], 0)
        return _first_valid("iban", iban, _starts(g["iban"], usual), lambda x: x == g["iban"] or not usual or len(_bare(x)) == usual, key)
    return _first_valid("card", card, _starts(g["card"], _card_length(_bare(g["card"]))), lambda x: True, key)


def _dated(g: dict[str, str], key: bytes) -> tuple[str, str] | None:
    """Year first, or day and month before the year; the order that is valid counts, day first when both are. Dashes and dots read
    day first, slashes month first, where either order is valid."""
    try:
        if g["y1"]:
            new = day(date(int(g["y1"]), int(g["m1"]), int(g["d1"])), key)
            return new and ("date", f"{new.year:04d}{g['s1']}{new.month:02d}{g['s1']}{new.day:02d}")
        a, b, y, s = int(g["a2"]), int(g["b2"]), int(g["y2"]), g["s2"]
        month_first = b > 12 or (s == "/" and a <= 12)
        new = day(date(y, a, b) if month_first else date(y, b, a), key)
        first, second = (new.month, new.day) if month_first else (new.day, new.month)
        wide = len(g["a2"]) == 2 and len(g["b2"]) == 2
        return "date", f"{first:02d}{s}{second:02d}{s}{new.year:04d}" if wide else f"{first}{s}{second}{s}{new.year:04d}"
    except ValueError:
        return None


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms and the (kind, start, end) of each replaced value in the original, in code points."""
    if "@" not in text and not any(c in text for c in "0123456789"):
        return text, []
    out, spans, at = [], [], 0
    m = PATTERN.search(text)
    while m:
        new = replacement(m, key)
        after = m.start() + 1
        if new:
            after = m.start() + len(new[1]) if new[0] in ("card", "iban") else m.end()
            out += [text[at : m.start()], new[1]]
            spans.append((new[0], m.start("local") if new[0] == "email" else m.start(), after))
            at = after
        m = PATTERN.search(text, after)
    return ("".join([*out, text[at:]]), spans) if spans else (text, [])


def session_key(spark: SparkSession) -> bytes:
    """The key of the session; without one a fresh key, by which pseudonyms link within this run and are reversible by nobody."""
    given = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_email, ..., n_date, spans) per input row: the text with pseudonyms, counts by kind, and kind:start:end
    of the originals in code points, comma-joined.

    Null and empty texts give the empty text and no spans; values that fail their format's check (Luhn, mod 97, calendar, octets)
    stay; equal values get equal pseudonyms in every row and document under one key, so repeated rows give equal rows; very long
    texts take time in proportion to their length; an empty table gives no rows; other columns are ignored."""
    names = ["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pseudonymise(t, key) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in spans) for _, spans in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([t for t, _ in found], pa.string()), *counts, pa.array([",".join(f"{k}:{a}:{e}" for k, a, e in s) for _, s in found], pa.string())], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, text string, {', '.join(f'n_{k} long' for k in KINDS)}, spans string")


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(table(spark, sf_dir, "documents"), session_key(spark))
