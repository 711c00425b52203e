"""The match grammar: AND (implicit), OR, NOT, parentheses, "phrases", prefix*, NEAR(a b, n) and column:term."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Leaf:
    """A term, prefix, phrase or group of near terms, perhaps of one column."""

    kind: str
    words: tuple[str, ...]
    column: str = ""
    gap: int = 10


@dataclass(frozen=True)
class Node:
    """and, or, or not (the first without the others)."""

    kind: str
    parts: tuple[Node | Leaf, ...]


_LEXEME = re.compile(r'NEAR\(([^(),]*)(?:,\s*(\d+)\s*)?\)|(?:(\w+)\s*:\s*)?(?:"((?:[^"]|"")*)"(\s*\*)?|(\w+)(\*)?)|([()])|(\S)')


def parse(query: str) -> Node | Leaf | None:
    """The expression of a query, None for a blank one; NOT binds closest, then AND, then OR."""
    tokens: list[tuple[str, object]] = []
    for m in _LEXEME.finditer(query):
        near, gap, column, quoted, after, word, star, bracket, other = m.groups()
        if other:
            raise ValueError(f"syntax error near {other!r}")
        if bracket:
            tokens.append((bracket, None))
        elif near is not None:
            tokens.append(("leaf", Leaf("near", tuple(re.findall("[a-z0-9]+", near.lower())), "", int(gap or 10))))
        elif word in ("AND", "OR", "NOT") and not column and not star:
            tokens.append((word, None))
        else:
            words = tuple(re.findall("[a-z0-9]+", (quoted if quoted is not None else word).lower()))
            if words:
                kind = "prefix" if (star or after) else "phrase" if len(words) > 1 else "term"
                tokens.append(("leaf", Leaf(kind, words, column or "")))
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def take() -> object:
        nonlocal at
        at += 1
        return tokens[at - 1][1]

    def primary() -> Node | Leaf:
        if peek() == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            take()
            return inner
        if peek() != "leaf":
            raise ValueError(f"syntax error near {peek() or 'the end'!r}")
        return take()

    def without() -> Node | Leaf:
        found = primary()
        while peek() == "NOT":
            take()
            found = Node("not", (found, primary()))
        return found

    def every() -> Node | Leaf:
        parts = [without()]
        while peek() in ("AND", "leaf", "("):
            if peek() == "AND":
                take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def either() -> Node | Leaf:
        parts = [every()]
        while peek() == "OR":
            take()
            parts.append(every())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    if not tokens:
        return None
    whole = either()
    if at < len(tokens):
        raise ValueError(f"syntax error near {peek()!r}")
    return whole


def leaves(expression: Node | Leaf) -> list[Leaf]:
    return [expression] if isinstance(expression, Leaf) else [x for p in expression.parts for x in leaves(p)]


def condition(expression: Node | Leaf, of: Callable[[Leaf], Column]) -> Column:
    """The expression as a column, its leaves given by ``of``."""
    if isinstance(expression, Leaf):
        return of(expression)
    first, *rest = [condition(p, of) for p in expression.parts]
    for c in rest:
        first = first & c if expression.kind == "and" else first | c if expression.kind == "or" else first & ~c
    return first
