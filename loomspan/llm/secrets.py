"""Secrets found by what they are assigned to.

A lexer reads source and configuration syntax in running text into assignments:
``name = "literal"``, ``name: literal``, ``"name": "literal"``, ``--name literal``, ``<name>literal</name>``,
keyword arguments, ``map["name"] = ...`` and the password of a URL.  A value is a chain of
literals and names joined by + (or by ``${name}`` and ``{name}`` inside a literal).  Constants
propagate in order of appearance: a name in a value stands for what it was last assigned,
so in ``x = "..."; password = x`` the literal is scored by ``password`` too.

Score of a (name, literal) pair = weight of the name * weight of the literal.  The
name's words are looked up in SENSITIVE and lowered by words that mean metadata
(``token_count``, ``password_hint``).  The literal's weight falls for placeholders, short
and repetitive values, and prose.  A literal of the shape that only credentials have
(key id prefixes, web tokens, private key blocks) scores by shape even without a name.
Findings with score >= THRESHOLD are returned; values are not, only a masked form
and a SHA-256 to compare by.

Defined cases
* null or empty text: no findings; null doc_id: carried; repeated rows: findings for each
* a literal that several names get: one finding, for the name with the highest score, the first at a tie
* cyclic constants (a = b; b = a): resolve to what was known before
* very long texts: lexed whole; empty table: no findings; extra columns are ignored
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.95, "apikey": 1.0, "apitoken": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "privatekey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.8, "authorization": 0.9, "bearer": 0.9, "signature": 0.6, "salt": 0.6,
    "key": 0.6, "cookie": 0.55, "contraseña": 1.0, "clave": 0.7, "passwort": 1.0, "kennwort": 1.0, "geheimnis": 0.8, "motdepasse": 1.0,
}
_PAIRED = {("api", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("private", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("access", "id"): 0.8, ("key", "id"): 0.6, ("client", "id"): 0.5}
_METADATA = {"count", "counts", "length", "len", "size", "max", "min", "limit", "hint", "name", "names", "type", "field", "label", "path", "file", "url", "uri", "endpoint", "expiry", "expires", "ttl", "policy", "regex", "pattern", "format", "public", "header", "prompt", "reset", "index", "column", "version", "enabled", "required", "rate", "budget", "usage"}
#: Values that stand for a secret: as a whole, or by a word of their own in them.
_PLACEHOLDER = re.compile(
    r"(?i)(?:x{3,}|\*{3,}|\.{3,}|<.*>|\[.*\]|\{\{?.*\}\}?|\$\{?\w+\}?|%\w+%|your[-_ ].*|none|null|nil|true|false|undefined|test|password|secret|token|string|(?:example|sample|dummy)\d*|os\.environ.*|process\.env.*|getenv.*)$"
    r"|.*(?<![^\W_])(?:change[-_ ]?me|placeholder|example|redacted|dummy|sample|insert|todo)\d*(?![^\W_])|.*(?-i:EXAMPLE(?:KEY)?)$",
    re.S,
)
_SHAPES = (
    ("key_id", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("hosting_token", re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,})")),
    ("chat_token", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("service_key", re.compile(r"(?<![A-Za-z0-9])(?:[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{35}|SG\.[\w-]{16,}\.[\w-]{16,})")),
    ("web_token", re.compile(r"(?<![\w-])eyJ[\w-]{8,}+\.eyJ[\w-]{8,}\.[\w-]{8,}")),
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----|$)")),
)
_SHAPE_HINTS = re.compile(r"AKIA|ASIA|AGPA|AROA|AIDA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_|sk-|AIza|SG\.|eyJ|-----BEGIN")

_QUOTED = r"""\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|[rbfuRBFU]{0,2}\"(?:[^"\\\n]|\\.)*+\"|[rbfuRBFU]{0,2}'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"""
#: Each alternative starts at a boundary and reads possessively, so that no stretch of text is read more than a few times.
_ASSIGN = re.compile(
    r"""(?P<flag>(?<![\w-])--?(?P<flag_name>[A-Za-z][\w-]++)(?:=|[ \t]++))(?=[^\s-])
    |<(?P<tag>[A-Za-z][\w.:-]*+)>(?P<tag_value>\s*+[^<>\n]++\s*+)</(?P=tag)>
    |(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@"']*+:(?P<url_value>[^\s/@"']++)@
    |(?:(?P<quoted_name>\"[^"\n]++\"|'[^'\n]++')\]?|(?<![\w.$-])[\d.$-]*+(?P<name>[^\W\d][\w.$-]*+))(?:[ \t]*+:[ \t]*+[A-Za-z_][\w\[\], .\t]*+(?==[^=]))?[ \t]*+(?P<op>:=|=>|\?=|\+=|=(?!=)|:(?![:/]))[ \t]*+""",
    re.X,
)
_ATOM = re.compile(rf"(?P<quoted>{_QUOTED})|(?P<bearer>(?:Bearer|Basic|Token)[ \t]++[\w.~+/=-]++)|(?P<bare>[^\s,;\"'`(){{}}\[\]<>|]++)")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+(?=[\"'`\w$])|[ \t]++(?=\"|')")
_WORDS = re.compile(r"[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+(?![a-zß-ÿ])|\d+")
_INNER = re.compile(r"\$\{(\w+)\}|\{(\w+)\}|\$(\w+)")


@dataclass(frozen=True)
class Literal:
    start: int
    end: int
    value: str


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    name: str
    rule: str
    score: float
    value: str


def name_weight(name: str) -> float:
    """How sensitive what a name holds is, from 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(re.sub("[._-]", " ", name))]
    if not words:
        return 0.0
    joined = "".join(words)
    weight = max([SENSITIVE.get(w, 0.0) for w in words] + [_PAIRED.get(p, 0.0) for p in zip(words, words[1:], strict=False)] + [SENSITIVE.get(joined, 0.0)])
    for end in ("password", "passwd", "secret", "apikey", "token"):
        if joined.endswith(end) or joined.startswith(end):
            weight = max(weight, 0.9)
    return weight * 0.3 if any(w in _METADATA for w in words) else weight


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret, from 0 to 1."""
    if len(value) < 4 or _PLACEHOLDER.match(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    if len(counts) < 3 or entropy < 1.5:
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    weight = 0.35 + min(0.3, 0.03 * len(value)) + min(0.25, 0.07 * entropy) + 0.1 * (classes - 1)
    if re.search(r"\s", value):
        weight *= 0.3 if value.count(" ") > 3 else 0.6
    if value.isalpha() and (value.islower() or value.istitle()):
        weight *= 0.75
    return min(1.0, weight)


@dataclass(eq=False, slots=True)
class Assigned:
    """An assignment; its value is made of literals and of what was assigned before."""

    name: str
    rule: str
    literals: list[Literal]
    earlier: list[Assigned]

    def all_literals(self) -> list[Literal]:
        found, stack, seen = {}, [self], set()
        while stack:
            a = stack.pop()
            if id(a) not in seen:
                seen.add(id(a))
                found |= dict.fromkeys(a.literals)
                stack += a.earlier
        return sorted(found, key=lambda lit: lit.start)


def lex(text: str) -> list[Assigned]:
    """The assignments in order."""
    known: dict[str, Assigned] = {}
    out: list[Assigned] = []
    at = run = 0
    while m := _ASSIGN.search(text, at):
        if m["tag"]:
            value = m["tag_value"].strip()
            start = text.index(value[0], m.start("tag_value")) if value else 0
            out.append(Assigned(m["tag"], "element", [Literal(start, start + len(value), value)] if value else [], []))
            at = m.end()
            continue
        if m["url_value"]:
            out.append(Assigned("url password", "url", [Literal(m.start("url_value"), m.end("url_value"), m["url_value"])], []))
            at = m.end()
            continue
        name = m["flag_name"] or (m["quoted_name"] or "")[1:-1] or m["name"]
        rule = "flag" if m["flag"] else "assignment" if m["op"] != ":" else "mapping"
        found = Assigned(name, rule, [], [])
        pos = m.end()
        loose = False
        while a := _ATOM.match(text, pos, text.find(":", pos, run) if pos < run and text.find(":", pos, run) >= 0 else len(text)):
            loose = loose or rule == "mapping" and bool(a["bare"]) and a["bare"].rstrip(".:!?").lstrip("$") not in known and not re.search(r"\d", a["bare"])
            _atom(a, known, found)
            joint = _PLUS.match(text, a.end()) if a["quoted"] or a["bare"] in known else None
            if not joint or (not joint.group().strip() and not a["quoted"]):
                pos = a.end()
                break
            pos = joint.end()
        if loose:
            run = max(run, pos)
        if found.literals or found.earlier:
            if m["op"] == "+=" and name in known:
                found.earlier.append(known[name])
            out.append(found)
            known[name] = known[name.rpartition(".")[2]] = found
        # An unquoted value after a colon may be prose or a name itself; it is read on from its start.  In a chain
        # like a:b:c only the first name gets the whole rest, those in it what stands up to the next colon.
        at = pos if (found.literals or found.earlier) and not loose else m.end()
    return out


def _atom(a: re.Match, known: dict[str, Assigned], into: Assigned) -> None:
    if a["quoted"]:
        body = a["quoted"].lstrip("rbfuRBFU")
        edge = 3 if body[:3] in ('"""', "'''") else 1
        start, value = a.end() - len(body) + edge, body[edge:-edge]
        named = list(dict.fromkeys(x for groups in _INNER.findall(value) for x in groups if x in known))
        into.earlier += [known[x] for x in named]
        into.literals += [Literal(start, a.end() - edge, value)] if value and not named else []
    elif a["bearer"]:
        value = a["bearer"].split()[-1]
        into.literals.append(Literal(a.end() - len(value), a.end(), value))
    else:
        value = a["bare"].rstrip(".:!?")
        if value.lstrip("$") in known:
            into.earlier.append(known[value.lstrip("$")])
        elif value:
            into.literals.append(Literal(a.start(), a.start() + len(value), value))


def _names_of_literals(assigned: list[Assigned]) -> Iterator[tuple[Literal, Assigned, float]]:
    """Each literal with the most sensitive assignment that it reaches (the first of equals) and the weight of its name."""
    best: dict[int, tuple[float, int]] = {}
    for i in range(len(assigned) - 1, -1, -1):  # whatever uses an assignment comes after it
        a = assigned[i]
        own = (1.0 if a.rule == "url" else name_weight(a.name), -i)
        top = best[id(a)] = max(own, best.get(id(a), own))
        for e in a.earlier:
            best[id(e)] = max(top, best.get(id(e), top))
    for a in assigned:
        weight, place = best[id(a)]
        for lit in a.literals:
            yield lit, assigned[-place], weight


def scan(text: str | None) -> list[Finding]:
    """Findings by start."""
    if not text:
        return []
    best: dict[tuple[int, int], Finding] = {}

    def offer(f: Finding) -> None:
        if f.score >= THRESHOLD and ((f.start, f.end) not in best or best[f.start, f.end].score < f.score):
            best[f.start, f.end] = f

    if any(c in text for c in "=:<-"):  # every assignment has one of these
        for lit, a, weight in _names_of_literals(lex(text)):
            if weight >= THRESHOLD:
                offer(Finding(lit.start, lit.end, a.name, a.rule, round(weight * literal_weight(lit.value), 4), lit.value))
    if _SHAPE_HINTS.search(text):
        for rule, pattern in _SHAPES:
            starts = sorted(best)
            reach = list(accumulate((end for _, end in starts), max))
            for m in pattern.finditer(text):
                k = bisect_right(starts, (m.start(), len(text)))
                if not k or reach[k - 1] < m.end():
                    offer(Finding(m.start(), m.end(), "", rule, 0.95, m.group()))
    return [best[k] for k in sorted(best)]


def mask(value: str) -> str:
    return value[: min(4, len(value) // 4)] + "*" * 4


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, name, rule, score, masked, sha256), a row for each finding."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
    names = ["doc_id", "start", "end", "name", "rule", "score", "masked", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            for i in range(len(texts)):
                for f in scan(texts[i].as_py()):
                    digest = hashlib.sha256(f.value.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((ids[i].as_py(), f.start, f.end, f.name, f.rule, f.score, mask(f.value), digest))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, start bigint, `end` bigint, name string, rule string, score double, masked string, sha256 string"
    )
