"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digit cues for
addresses and numbers, URL schemes, and words that announce an account, a
secret or a street. From each anchor a local parser expands to the boundaries
of the whole item and validates it. Anchors are rare, so nearly all of the
text is read once, by the automaton only.

Positions are code points, ends exclusive. A null or empty text has no spans.
Every row is judged by itself: repeated rows, null ids and further columns stay
as they are; a column of the input named ``spans`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In this order among spans that start together. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret", "address")
BASE_KINDS = KINDS[:4]
SPANS = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"

# The words and signs that announce an item.
CUES = {
    "url": ("http://", "https://", "ftp://"),
    "account": ("account", "acct", "iban", "konto", "cuenta"),
    "secret": ("token", "password", "passwd", "api_key", "api key", "secret"),
    "address": (" street", " avenue", " road", " lane", " boulevard", " drive"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?i:https?|ftp)://[^\s\"'<>|\\^`{}]+")
_ACCOUNT = re.compile(r"(?:[\x20]?(?:number|no\.?|nr\.?|#))?[\x20]?[:=#]?[\x20]?([A-Z0-9][A-Z0-9\x20-]{4,32}[A-Z0-9])(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\x20]?[:=][\x20]?[\"']?([A-Za-z0-9_+/.-]{16,})")
_STREET_BEFORE = re.compile(r"(?<![\w])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][\w'.-]*\x20){0,3}[A-Z][\w'.-]*$")
_STREET_AFTER = re.compile(r"(?:,\x20[A-Z][\w-]+(?:\x20[A-Z][\w-]+)?)?(?:,?\x20[A-Z]{2})?(?:,?\x20[0-9]{5})?")
_UPPER = {ord(upper): upper.lower() for upper in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    patterns: dict[str, list[tuple[str, int]]] = {"@": [("email", 1)]}
    for first in "0123456789":
        patterns[f"+{first}"] = [("phone", 2)]
        for second in "0123456789":
            patterns[f"{first}.{second}"] = [("ip", 3)]
            for between in ("", " ", "-"):
                patterns[first + between + second] = [("card", 2 + len(between))]
    for kind, cues in CUES.items():
        for cue in cues:
            patterns[cue] = [(kind, len(cue))]
    for pattern, value in patterns.items():
        found.add_word(pattern, value[0])
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _email(text: str, at: int, stop: int, done: int):
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, stop) if start < at else None
    return (domain.end(), [(start, domain.end())]) if domain else (done, [])


def _ip(text: str, at: int, stop: int, done: int):
    start = at
    while start > done and text[start - 1].isascii() and text[start - 1].isdigit():
        start -= 1
    chain = _DOTTED.match(text, start)
    spans, begin = [], start
    parts = chain.group().split(".")
    for index in range(0, len(parts) - 3, 4):
        four = parts[index : index + 4]
        end = begin + sum(map(len, four)) + 3
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in four):
            spans.append((begin, end))
        begin = end + 1
    return chain.end(), spans


def _card(text: str, at: int, stop: int, done: int):
    chain = _CARD.match(text, at)
    digits = chain.group().replace(" ", "").replace("-", "")
    return chain.end(), [chain.span()] if 12 <= len(digits) <= 19 and _luhn(digits) else []


def _phone(text: str, at: int, stop: int, done: int):
    found = _PHONE.match(text, at)
    if not found:
        return done, []
    digits = sum(map(str.isdigit, found.group()))
    return found.end(), [found.span()] if 9 <= digits <= 15 else []


def _url(text: str, at: int, stop: int, done: int):
    found = _URL.match(text, at)
    if not found:
        return done, []
    end = at + len(found.group().rstrip(".,;:!?)]"))
    return (end, [(at, end)]) if end > stop else (done, [])


def _iban(value: str) -> bool:
    compact = value.replace(" ", "").replace("-", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", compact):
        return False
    return int("".join(str(int(sign, 36)) for sign in compact[4:] + compact[:4])) % 97 == 1


def _account(text: str, at: int, stop: int, done: int):
    found = _ACCOUNT.match(text, stop)
    if not found or (at and text[at - 1].isalnum()):
        return done, []
    value = found.group(1)
    digits = sum(map(str.isdigit, value))
    named_iban = text[at:stop].lower() == "iban"
    return found.end(), [found.span(1)] if (_iban(value) if named_iban else 6 <= digits <= 34) else []


def _secret(text: str, at: int, stop: int, done: int):
    found = _SECRET.match(text, stop)
    if not found or (at and text[at - 1].isalnum()):
        return done, []
    value = found.group(1)
    return found.end(), [found.span(1)] if any(map(str.isdigit, value)) else []


def _address(text: str, at: int, stop: int, done: int):
    if stop < len(text) and text[stop].isalnum():
        return done, []
    from_ = max(done, at - 80)
    before = _STREET_BEFORE.search(text[from_:at])
    if not before:
        return done, []
    end = _STREET_AFTER.match(text, stop).end()
    return end, [(from_ + before.start(), end)]


_PARSERS = {
    "email": _email,
    "ip": _ip,
    "card": _card,
    "phone": _phone,
    "url": _url,
    "account": _account,
    "secret": _secret,
    "address": _address,
}


def find_spans(text: str | None) -> list[dict]:
    """Spans of one text, by start, then kind."""
    if not text:
        return []
    done = dict.fromkeys(KINDS, 0)
    spans = []
    for last, (kind, size) in _automaton().iter(text.translate(_UPPER)):
        start, stop = last - size + 1, last + 1
        if start < done[kind]:
            continue
        done[kind], found = _PARSERS[kind](text, start, stop, done[kind])
        spans += [(begin, KINDS.index(kind), end) for begin, end in found]
    return [
        {"kind": KINDS[kind], "start": begin, "stop": end, "value": text[begin:end]} for begin, kind, end in sorted(spans)
    ]


def _spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series([find_spans(text) for text in series], dtype=object)


def find_personal_data(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``spans``: kind, start, stop and value of each item found."""

    def spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _spans_of(texts)

    spans_of.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("spans", F.pandas_udf(spans_of, SPANS)(F.col(f"`{text_column}`")))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"], span["stop"])), ",")


def personal_data_digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query, from ``find_personal_data``."""
    base = F.filter("spans", lambda span: span["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
