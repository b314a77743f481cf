"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, scheme marks, plus-digit
pairs, joined digits and identifier cues. Small deterministic parsers then expand
each anchor to its boundaries and validate it. A parser gives, kind by kind, the
leftmost non-overlapping matches; a match that fails validation is dropped, and
its characters are not tried again.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "login")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[Ii][Bb][Aa][Nn][\x20:]{1,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:account|acct)\.?\x20(?:no\.?|number|#):?\x20?([0-9]{6,17})(?![0-9A-Za-z])", re.IGNORECASE | re.ASCII)
_LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@")


def _luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _cased(word: str, what: str) -> list[tuple[str, str]]:
    """The word in every spelling of upper and lower case, as its parser takes them all."""
    return [("".join(x), what) for x in product(*[(c, c.upper()) for c in word])]


@cache
def _anchors() -> ahocorasick.Automaton:
    """Anchor text -> (kind of anchor, its length)."""
    out = ahocorasick.Automaton()
    for word, what in (("@", "at"), ("://", "scheme"), *_cased("iban", "iban"), *_cased("account", "account"), *_cased("acct", "account")):
        out.add_word(word, (what, len(word)))
    for a in "0123456789":
        out.add_word(f"+{a}", ("plus", 2))
        for b in "0123456789":
            out.add_word(f"{a}.{b}", ("dot", 3))
            out.add_word(f"{a}{b}", ("run", 2))
            out.add_word(f"{a} {b}", ("run", 3))
            out.add_word(f"{a}-{b}", ("run", 3))
    out.make_automaton()
    return out


def _leftwards(text: str, at: int, least: int, chars: frozenset[str]) -> int:
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points, end exclusive."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (what, n) in _anchors().iter(text):
        at = last - n + 1
        if what == "run":
            if at >= done["card"]:
                m = _RUN.match(text, at)
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(m.span())
        elif what == "at":
            start = _leftwards(text, at, done["email"], _LOCAL)
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif what == "dot":
            if at >= done["ip"]:
                start = _leftwards(text, at, done["ip"], _DIGITS)
                if m := _QUAD.match(text, start):
                    done["ip"] = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                        found["ip"].append(m.span())
        elif what == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "scheme":
            start = _leftwards(text, at, done["login"], _SCHEME)
            if start < at and (m := _LOGIN.match(text, at)):
                done["login"] = m.end()
                found["login"].append((start, m.end()))
        elif at >= done[what] and (m := (_IBAN if what == "iban" else _ACCOUNT).match(text, at)):
            done[what] = m.end()
            if what == "account" or _mod97(m[1].replace(" ", "")):
                found[what].append(m.span(1))
    return [(k, *s) for k in KINDS for s in found[k]]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """text with spans replaced by <KIND>; overlapping spans are one, named by the first."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in texts], dtype=object)


def redact_all(text: str | None) -> str | None:
    """Redacts until nothing is found: a span that goes can set its neighbour free, e.g. a card after an address."""
    while spans := find_spans(text):
        text = redact(text, spans)
    return text


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redact_all(t) for t in texts], dtype=object)


def pii_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a whole text; null and empty texts have none."""
    return _spans(text)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with personal data replaced by its kind, e.g. <EMAIL>; a column `length` follows the new text.

    Null texts stay null; other columns of any name stay as they are; rows are
    treated one by one, so repeated rows and empty tables need no care.
    """
    out = docs.withColumn(text, _redacted(F.col(text)))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out
