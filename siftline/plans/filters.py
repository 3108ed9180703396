"""The filter language: text to tokens, to a tree, to a Spark condition.

Terms are joined by AND (also &&, or nothing), OR (also ||) and NOT, in rising order of their hold: OR, AND, NOT; round
brackets group. A term compares a column (`city:London`, `salary:50k..100k`, `date:>2026-01-01`, `company:"CVS Health"`),
asks whether it is filled (`missing:city`, `populated:salary`), or is looked for in every column. - and ! negate a term.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, ge, gt, le, lt, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.names import resolve
from siftline.functions.text import date_of, feed_trim, holds, is_iso_date, is_missing, literal_number, number_of

_LEX = re.compile(r'(?P<bracket>[()])|(?P<quoted>"[^"]*"?)|(?P<word>(?:[^\s()"]|"[^"]*(?:"|$))+)')
_KEYWORDS = {"AND": "AND", "&&": "AND", "OR": "OR", "||": "OR", "NOT": "NOT"}
#: The comparison signs in the order in which a term is split by them, and the texts of yes and no.
_SIGNS = {"!=": "!=", "<>": "!=", ":!=": "!=", ":>=": ">=", ":<=": "<=", ":>": ">", ":<": "<", ">=": ">=", "<=": "<=", ">": ">", "<": "<", "=": "=", ":": "="}
_ORDER = {">": gt, ">=": ge, "<": lt, "<=": le}
_TRUE, _FALSE = ["true", "1", "yes"], ["false", "0", "no"]


@dataclass(frozen=True)
class Token:
    kind: str  # AND, OR, NOT, (, ) or TERM
    text: str = ""


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Term:
    text: str


def tokenize(text: str) -> list[Token]:
    """Tokens, with an AND wherever something ends and the next thing begins without a connective."""
    out: list[Token] = []
    for m in _LEX.finditer(text):
        word = m["word"]
        kind = m["bracket"] or _KEYWORDS.get(word.upper() if word else "", "TERM")
        if out and out[-1].kind in ("TERM", ")") and kind in ("TERM", "(", "NOT"):
            out.append(Token("AND"))
        out.append(Token(kind, m[0] if kind == "TERM" else ""))
    return out


class _Reader:
    """Reads tokens by levels; a level that finds nothing gives None."""

    def __init__(self, tokens: Sequence[Token]):
        self.tokens, self.at = tokens, 0

    def next_is(self, kind: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].kind == kind

    def take(self, kind: str) -> bool:
        found = self.next_is(kind)
        self.at += found
        return found

    def joined(self, sign: str, below, node) -> object | None:
        if (first := below()) is None:
            return None
        parts = [first]
        while self.take(sign):
            if (more := below()) is not None:
                parts.append(more)
        return node(tuple(parts)) if len(parts) > 1 else first

    def either(self) -> object | None:
        return self.joined("OR", lambda: self.joined("AND", self.one, And), Or)

    def one(self) -> object | None:
        if self.take("NOT"):
            inner = self.one()
            return None if inner is None else Not(inner)
        if self.take("("):
            inner = self.either()
            self.take(")")
            return inner
        if self.next_is("TERM"):
            self.at += 1
            return Term(self.tokens[self.at - 1].text)
        self.at += 1  # a connective or bracket out of place is passed over
        return None


def parse(tokens: Sequence[Token]) -> object | None:
    """The tree; None if the text cannot begin so. What is left behind a complete tree is joined to it by AND."""
    reader = _Reader(tokens)
    if (first := reader.either()) is None:
        return None
    parts = [first]
    while reader.at < len(tokens):
        if (more := reader.either()) is None:
            reader.at += 1
        else:
            parts.append(more)
    return And(tuple(parts)) if len(parts) > 1 else first


def _compared(c: Column, sign: str, raw: str) -> Column:
    """A column against the value of a term."""
    value = raw.strip().strip('"')
    low = value.lower()
    trimmed = F.lower(feed_trim(c))
    if sign == "=" and ".." in value:
        a, _, b = value.partition("..")
        if (x := literal_number(a)) is not None and (y := literal_number(b)) is not None:
            return number_of(c).between(x, y)
        if is_iso_date(a) and is_iso_date(b):
            return date_of(c).between(F.lit(a.strip()).try_cast("date"), F.lit(b.strip()).try_cast("date"))
    if sign in _ORDER:
        if (x := literal_number(value)) is not None:
            return _ORDER[sign](number_of(c), F.lit(x))
        if is_iso_date(value):
            return _ORDER[sign](date_of(c), F.lit(value.strip()).try_cast("date"))
        return _ORDER[sign](c, F.lit(value))
    if sign == "!=":
        return c.isNull() | (~trimmed.isin(_TRUE) if low in _TRUE else ~holds(c, value))
    if low in _TRUE:
        return trimmed.isin(_TRUE) | holds(c, "true")
    if low in _FALSE:
        return c.isNull() | trimmed.isin([*_FALSE, ""]) | holds(c, "false")
    if raw.strip().startswith('"') and raw.strip().endswith('"'):
        return trimmed == F.lower(F.lit(value))
    return holds(c, value)


def term_condition(term: str, columns: Sequence[str]) -> Column | None:
    """What a term asks of a row; None of an empty term."""
    term = term.strip()
    if not term:
        return None
    if term[0] in "-!" and len(term) > 1 and (inner := term_condition(term[1:], columns)) is not None:
        return ~inner
    for prefix, missing in (("missing:", True), ("is:empty:", True), ("populated:", False), ("is:valid:", False)):
        if term.startswith(prefix) and (name := resolve(term[len(prefix) :].strip(), columns)):
            c = F.col(f"`{name}`")
            return is_missing(c) if missing else c.isNotNull() & (feed_trim(c) != "")
    for pattern, sign in _SIGNS.items():
        left, found, right = term.partition(pattern)
        if found and (name := resolve(left.strip(), columns)):
            return _compared(F.col(f"`{name}`"), sign, right)
    anywhere = [holds(F.col(f"`{c}`"), term.strip('"')) for c in columns]
    return reduce(or_, anywhere) if anywhere else None


def condition(node: object, columns: Sequence[str]) -> Column | None:
    if isinstance(node, Term):
        return term_condition(node.text, columns)
    if isinstance(node, Not):
        inner = condition(node.part, columns)
        return None if inner is None else ~inner
    parts = [c for p in node.parts if (c := condition(p, columns)) is not None]
    return reduce(and_ if isinstance(node, And) else or_, parts) if parts else None


def compile_filter(text: str | None, columns: Sequence[str]) -> Column:
    """The condition of a filter text; always true if it has none."""
    tree = parse(tokenize(text or ""))
    found = condition(tree, columns) if tree is not None else None
    return F.lit(True) if found is None else found


_PHRASE = re.compile(r'(?:[^\s"]|"[^"]*(?:"|$))+')


def search_words(text: str) -> list[str]:
    """The words of a search, quoted phrases whole and without their quotes; empty ones left out."""
    return [w for m in _PHRASE.findall(text) if (w := m.replace('"', ""))]
