"""Personal identifiers, found also where they are disguised.

A chain of transducers rewrites a text into a normal form, and every character
of the normal form keeps the span of source characters it came from:

1. characters: compatibility forms (full width, mathematical, circled) and Cyrillic or
   Greek look-alikes become plain letters, digits and signs; invisible characters go
2. spelled digits: three or more digit words in a row (English, German, French,
   Spanish) become digits, with "plus", "double" and "triple" applied
3. at and dot: bracketed, underscored and bare "at" / "dot" words become @ and . where an
   address surrounds them

Identifiers are then detected in the normal form and their spans mapped back, so
a finding always points at whole characters of the original text.

Kinds: email, iban (checksum), card (13 to 19 digits: Luhn checksum, or 16 digits that
start like a payment card), ssn, ipv4, phone (10 to 15 digits, or 7 and more after +).
Overlapping findings: the earlier kind in that list wins, then the earlier start.

Defined cases
* null or empty text: no findings; redaction leaves it as it is
* null doc_id: findings carry null; repeated rows: findings for each
* very long texts: scanned whole
* empty table: no findings; extra columns pass through redaction untouched
* a text without findings is returned by redaction unchanged, byte for byte
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "card", "ssn", "ipv4", "phone")
SCHEMA = "doc_id bigint, kind string, start bigint, end bigint, surface string, value string"

_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝмтвнкАВЕКМНОРСТХІЈЅУΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρνυχικτ",
        "aeopcyxijshdqwmtbhkABEKMHOPCTXIJSYABEZHIKMNOPTYXoapvuxikt",
        strict=True,
    )
) | {"–": "-", "—": "-", "‐": "-", "‑": "-", "‒": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".", "٠": "0", "ı": "i", "ⅼ": "l"}
_INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: What step 1 may have to rewrite, digits that are not ASCII included.
_SPECIAL = re.compile(
    "[" + re.escape("".join(_LOOKALIKES) + _INVISIBLE) + " ²³¹٠-٩۰-۹०-९ - ⁰-₟℀-⅏①-⓿❶-➓！-～\U0001d400-\U0001d7ff]"
)
_DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate(
        ("zero oh null zéro cero", "one eins un une uno una", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf funf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
    )
    for w in words.split()
}
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + r"|[0-9])"
_TIMES = r"(?:(?:double|triple)\s++)?"
#: White space with up to two separators in it.  Possessive, so that a gap is read once.
_GAP = r"(?=[-.,/\s])[ \t\xa0]*+(?:[-.,/\n][ \t\xa0]*+){0,2}"
_SPELLED = re.compile(rf"(?<![\w])(?:plus\s++)?{_TIMES}{_WORD}(?![\w])(?:{_GAP}{_TIMES}{_WORD}(?![\w])){{2,}}", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>plus)\s++|(?:(?P<times>double|triple)\s++)?(?P<word>{_WORD})(?![\w])|(?P<gap>{_GAP})", re.I)
_SPELLED_HINTS = sorted({w for w in _DIGIT_WORDS if len(w) > 3 or w in ("two", "six", "dos")} | {"double", "triple"})

_AT_WORD, _DOT_WORD = r"(?:at|@|arroba|arobase|ät)", r"(?:dot|\.|punkt|punto|point)"
_OPEN, _CLOSE = r"[\[({<]\s*+", r"\s*+[\])}>]"
#: Every character belongs to one token, and no alternative reads a run of white space more than once.
_TOKEN = re.compile(
    rf"(?P<at>\s*+{_OPEN}{_AT_WORD}{_CLOSE}\s*+|\s++(?:at|arroba|arobase)\s++|\s*+@\s*+)"
    rf"|(?P<dot>\s*+{_OPEN}{_DOT_WORD}{_CLOSE}\s*+|\s++(?:dot|punkt|punto|point)\s++|\s++\.\s++|\.)"
    r"|(?P<label>[\w+%-]++)|\s++|.",
    re.I | re.S,
)
_JOINED = re.compile(r"_(at|dot)_|-(at|dot)-", re.I)
_DOMAIN_LABEL = re.compile(r"[^\W_](?:[\w-]*\w)?")
_LAST_LABEL = re.compile(r"[^\W\d_]{2,24}(?![\w@])")
_BRACKETED_AT = re.compile(r"[\[({<_-]\s*+(?:at|ät|arroba|arobase|@)\s*+[\])}>_-]", re.I)
#: Some of it stands in every disguised address that has a plain @.
_LOOSE = re.compile(r"\s@|@\s|[\[({<]\s*+(?:dot|\.|punkt|punto|point)|[_-]dot[_-]|\s(?:dot|punkt|punto|point|\.)\s", re.I)
_BARE_AT = re.compile(r"\s(?:at|arroba|arobase)\s++[\w-]+(?:\.\w|\s*[\[({<_-]\s*(?:dot|punkt|punto|point|\.)|\s+(?:dot|punkt|punto|point|\.)\s)", re.I)


_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![\w@])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d(?:[ -]\d){12,18})(?![\w-])")
_SSN = re.compile(r"(?<![\w.-])(?!000|666|9\d\d)\d{3}([- ])(?!00)\d{2}\1(?!0000)\d{4}(?![\w-])")
_IPV4 = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w)")
_PHONE = re.compile(r"(?<![\w+])(?<!\w\.)(?:(?:\+\s?\d{1,3}|00\d{1,3})[ .-]*+)?(?:\(\d{1,4}\)|0\d{2,4} ?/ ?|\d{1,4})(?:[ .-]{0,2}\d{2,4}){1,5}(?!\w)")


class Normal:
    """A text in normal form; character i of it comes from source characters start[i] to end[i]."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace spans (from, to, new), in order and apart; new characters share the span of what they replace."""
        if not pieces:
            return
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in pieces:
            texts += [self.text[at:a], new]
            starts.append(self.start[at:a])
            ends.append(self.end[at:a])
            if new:
                starts.append(np.full(len(new), self.start[a]))
                ends.append(np.full(len(new), self.end[b - 1]))
            at = b
        texts.append(self.text[at:])
        self.text = "".join(texts)
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _plain_character(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    folded = unicodedata.normalize("NFKC", c)
    return "".join(_LOOKALIKES.get(x, x if x.isascii() or not x.isdigit() else str(unicodedata.digit(x))) for x in folded)


def _characters(n: Normal) -> None:
    n.rewrite([(m.start(), m.end(), _plain_character(m.group())) for m in _SPECIAL.finditer(n.text)])


def _spelled_digits(n: Normal) -> None:
    pieces = []
    for run in _SPELLED.finditer(n.text):
        parts = [m for m in _SPELLED_PART.finditer(n.text, run.start(), run.end())]
        if not any(m["word"] and not m["word"].isdigit() for m in parts):
            continue
        for m in parts:
            if m["plus"]:
                pieces.append((m.start(), m.end(), "+"))
            elif m["gap"]:
                kept = re.sub(r"\s+", "", m.group())
                pieces.append((m.start(), m.end(), "" if kept in ("", ",") else kept))
            else:
                digit = _DIGIT_WORDS.get(m["word"].lower(), m["word"])
                pieces.append((m.start(), m.end(), digit * {"double": 2, "triple": 3}.get((m["times"] or "").lower(), 1)))
    n.rewrite(pieces)


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, from, to): labels, at and dot signs, and x for what parts them."""
    for m in _TOKEN.finditer(text):
        kind, at = m.lastgroup or "x", m.start()
        if kind == "label":
            for j in _JOINED.finditer(text, m.start(), m.end()):
                if at < j.start():
                    yield "label", at, j.start()
                yield (j[1] or j[2]).lower(), j.start(), j.end()
                at = j.end()
        if at < m.end():
            yield kind, at, m.end()


def _addresses(text: str) -> Iterator[tuple[tuple[int, int], tuple[int, int], tuple[int, int], list[tuple[int, int]]]]:
    """(local part, at sign, domain, dots) of what reads as an address, in order and apart.  Each token is looked at once a side."""
    kinds = list(_tokens(text))
    free = 0  # tokens before belong to an address already
    for k, (kind, a, b) in enumerate(kinds):
        if kind != "at" or k <= free - 1:
            continue
        i, dots = k, []
        while i - 1 >= free and kinds[i - 1][0] == "label":
            i -= 1
            if not (i - 2 >= free and kinds[i - 1][0] == "dot" and kinds[i - 2][0] == "label"):
                break
            dots.append(kinds[i - 1][1:])
            i -= 1
        if i == k or kinds[i][1] and re.match(r"[\w.+%-]", text[kinds[i][1] - 1]):
            continue
        j, passed, end, used = k + 1, [], None, 0
        while j < len(kinds) and kinds[j][0] == "label":
            x, y = kinds[j][1:]
            if passed and (m := _LAST_LABEL.match(text, x)):
                end, used = m.end(), len(passed)
                last = j
            if not _DOMAIN_LABEL.fullmatch(text, x, y) or not (j + 1 < len(kinds) and kinds[j + 1][0] == "dot"):
                break
            passed.append(kinds[j + 1][1:])
            j += 2
        if end is not None:
            free = last + 1
            yield (kinds[i][1], a), (a, b), (b, end), dots[::-1] + passed[:used]


def _at_and_dot(n: Normal) -> None:
    pieces = []
    for (a, b), (c, d), (e, f), dots in _addresses(n.text):
        local, at, domain = n.text[a:b], n.text[c:d], n.text[e:f]
        if at == "@" and not re.search(r"\s|[\[({<]|_dot_|-dot-", domain + local, re.I):
            continue  # nothing is disguised
        bare = re.fullmatch(r"\s++\w++\s++", at) is not None
        if bare and not re.search(r"\bdot\b|punkt|punto|\bpoint\b|[\[({<]", domain, re.I) and not re.search(r"[\d._+]", local):
            continue  # "meet at example.com"
        if re.search(r"\s\.\s", domain) and not re.search(r"\s", at):
            continue  # a sentence ends behind an address
        pieces += [(x, y, ".") for x, y in dots] + [(c, d, "@")]
    n.rewrite(sorted(pieces))


def _may_spell(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _SPELLED_HINTS) and _SPELLED.search(text) is not None


def _may_disguise(text: str) -> bool:
    return "@" in text and _LOOSE.search(text) is not None or _BRACKETED_AT.search(text) is not None or _BARE_AT.search(text) is not None


def normalise(text: str) -> Normal:
    """The normal form with its map back to the text."""
    n = Normal(text)
    if _SPECIAL.search(n.text):
        _characters(n)
    if _may_spell(n.text):
        _spelled_digits(n)
    if _may_disguise(n.text):
        _at_and_dot(n)
    return n


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(surface: str) -> str | None:
    digits = re.sub(r"\D", "", surface)
    like_card = len(digits) == 16 and re.match(r"4|5[1-5]|2[2-7]|6(?:011|5)", digits)
    return digits if len(set(digits)) > 1 and (_luhn(digits) or like_card) else None


def _iban(surface: str) -> str | None:
    value = surface.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return None
    return value if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1 else None


def _phone(surface: str) -> str | None:
    digits = re.sub(r"\D", "", surface)
    if "+" in surface or surface.startswith("00"):
        return "+" + digits if 7 <= len(digits) <= 15 else None
    if "." in surface and "/" not in surface and not re.fullmatch(r"\(?\d{3}\)?[.]\d{3}[.]\d{4}|0\d(?:[.]\d{2}){4}", surface.strip()):
        return None  # dotted numbers are versions and decimals
    return digits if 10 <= len(digits) <= 15 and len(set(digits)) > 1 else None


_DETECTORS = (
    ("email", _EMAIL, str.lower), ("iban", _IBAN, _iban), ("card", _CARD, _card), ("ssn", _SSN, lambda s: re.sub(r"\D", "", s)), ("ipv4", _IPV4, str), ("phone", _PHONE, _phone),
)
#: No identifier exists without one of these in the source text.
_TRIGGER = re.compile("[0-9@]|" + _SPECIAL.pattern)


def detect(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normal value), by start."""
    if not text:
        return []
    if not (_TRIGGER.search(text) or _may_spell(text) or _may_disguise(text)):
        return []
    n = normalise(text)
    found: list[tuple[str, int, int, str]] = []
    taken = bytearray(len(n.text))
    for kind, pattern, value_of in _DETECTORS:
        for m in pattern.finditer(n.text):
            a, b = m.span()
            while a < b and n.text[a] in " .-":
                a += 1
            value = value_of(n.text[a:b])
            if value is None or taken.find(1, a, b) >= 0:
                continue
            taken[a:b] = b"\1" * (b - a)
            found.append((kind, *n.span(a, b), value))
    return sorted(found, key=lambda f: (f[1], f[2]))


def redact_text(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets."""
    found = detect(text)
    if not found:
        return text
    parts, at = [], 0
    for kind, a, b, _ in found:
        if a < at:  # two normal spans that share a source character
            continue
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a finding: (doc_id, kind, start, end, surface, value); offsets count characters."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kind", "start", "end", "surface", "value"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = []
            for i in range(len(texts)):
                text = texts[i].as_py()
                doc_id = None
                for k, (kind, a, b, value) in enumerate(detect(text)):
                    doc_id = ids[i].as_py() if k == 0 else doc_id
                    rows.append((doc_id, kind, a, b, text[a:b], value))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, SCHEMA.replace("end ", "`end` "))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with identifiers masked in text; n_chars, where there is one, follows the text."""

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(redact_text, na_action="ignore")

    masked = docs.withColumn("text", redact(docs["text"]))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull() & F.col("n_chars").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])
