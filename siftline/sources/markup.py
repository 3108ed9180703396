"""Tolerant reading of XML records: events, and the flat fields of a record."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from siftline.functions.names import strip_namespace

START, END, EMPTY, TEXT, CDATA = "start", "end", "empty", "text", "cdata"
#: Elements that format text and never become fields, and names of long descriptions.
HTML_TAGS = frozenset("li ul ol p br h1 h2 h3 h4 h5 h6 div span strong b i em u s a img table tr td th tbody thead tfoot font hr pre code blockquote style script button input header footer section article nav aside form".split())
DESCRIPTIONS = frozenset("body content summary details post job_post jobpost desc".split())
DESCRIPTION_PARTS = ("description", "post_body")
#: Elements that pair a name with a value, and where the two are looked for, in order.
PAIRS = frozenset("field param property attribute item entry".split())
PAIR_PART = "custom"
NAME_KEYS = ("name", "Name", "key", "Key", "id", "Id", "param", "field")
VALUE_KEYS = ("value", "Value", "val", "Val", "content", "text")

_EVENT = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<!(?:[^\[>]|\[[^\]]*\])*>|<(?P<end>/?)(?P<name>[^\s<>/!?"'=][^\s<>/"'=]*)(?P<rest>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile(r"&([^;&\s]*);?")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "apos": "'", "quot": '"'}


def events(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes). Markup that cannot be read is text."""
    at = 0
    for m in _EVENT.finditer(text):
        if m.start() > at:
            yield TEXT, text[at : m.start()], ""
        at = m.end()
        if m["name"] is not None:
            rest = m["rest"]
            kind = END if m["end"] else EMPTY if rest.endswith("/") else START
            yield kind, m["name"], rest
        elif m["cdata"] is not None:
            yield CDATA, m["cdata"], ""
    if at < len(text):
        yield TEXT, text[at:], ""


def attributes(rest: str) -> list[tuple[str, str]]:
    """Names without namespace, and values as written."""
    if not rest or "=" not in rest:
        return []
    return [(strip_namespace(m[1]), m[2] if m[2] is not None else m[3]) for m in _ATTRIBUTE.finditer(rest)]


def decode(text: str) -> str:
    """Text with XML's references decoded; empty if there is one that XML does not know."""
    if "&" not in text:
        return text
    bad = []

    def one(m: re.Match) -> str:
        ref = m[1]
        if m[0].endswith(";"):
            if ref in _ENTITIES:
                return _ENTITIES[ref]
            if ref.startswith("#"):
                try:
                    return chr(int(ref[2:], 16) if ref[1:2] == "x" else int(ref[1:]))
                except (ValueError, OverflowError):
                    pass
        bad.append(ref)
        return ""

    out = _REFERENCE.sub(one, text)
    return "" if bad else out


@lru_cache(1 << 12)
def spelled(name: str) -> tuple[str, str]:
    """A tag's name without namespace, as written and in lower case."""
    name = strip_namespace(name)
    return name, name.lower()


@lru_cache(1 << 12)
def is_description(tag: str) -> bool:
    low = tag.lower()
    return low in DESCRIPTIONS or any(p in low for p in DESCRIPTION_PARTS)


def is_pair(tag: str) -> bool:
    return tag in PAIRS or PAIR_PART in tag


class Record:
    """Collects the fields of one record from the events between its tags."""

    def __init__(self, tag: str, rest: str, skip_descriptions: bool = False):
        self.tag, self.skip = tag, skip_descriptions
        self.fields: dict[str, str] = dict(attributes(rest))
        self.path: list[str] = []
        self.text = ""
        self.skipping: list | None = None  # [name, depth] while a description is passed over

    def feed(self, kind: str, value: str, rest: str) -> bool:
        """Takes an event; true if it ends the record."""
        if kind in (TEXT, CDATA):
            if self.skipping is None:
                self.add(value if kind == CDATA else decode(value))
            return False
        name, low = spelled(value)
        if self.skipping is not None:
            return self.pass_over(kind, low)
        if kind == END and low == self.tag:
            return True
        if kind == START:
            self.start(name, low, rest)
        elif kind == END:
            self.end(name, low, rest)
        else:
            self.empty(name, low, rest)
        return False

    def pass_over(self, kind: str, low: str) -> bool:
        """Within a description: only elements that are no formatting count for its depth."""
        if kind == EMPTY:
            return False
        done = low == self.tag or kind == END and low == self.skipping[0]
        if not done and low not in HTML_TAGS:
            self.skipping[1] += 1 if kind == START else -1
            done = self.skipping[1] <= 0
        if done:
            self.skipping = None
        return False

    def add(self, text: str) -> None:
        if stripped := text.strip():
            if self.text and self.text[-1] not in " \n":
                self.text += " "
            self.text += stripped

    def new_line(self) -> None:
        if self.text and not self.text.endswith("\n"):
            self.text += "\n"

    def start(self, name: str, low: str, rest: str) -> None:
        if self.skip and is_description(low):
            self.skipping = [low, 1]
            return
        formatting = low in HTML_TAGS
        if formatting or any(map(is_description, self.path)):
            if low in ("p", "br", "tr", "li") or low.startswith("h"):
                self.new_line()
            if low == "li":
                self.text += "• "
        if formatting:
            return
        self.path.append(name)
        self.text = ""
        self.put_attributes(rest)

    def put_attributes(self, rest: str, *inner: str) -> None:
        for key, value in attributes(rest):
            self.fields[".".join((*self.path, *inner, key))] = value

    def empty(self, name: str, low: str, rest: str) -> None:
        if low not in HTML_TAGS:
            self.put_attributes(rest, name)
        elif low in ("br", "hr"):
            self.new_line()

    def end(self, name: str, low: str, rest: str) -> None:
        if low in HTML_TAGS:
            if low in ("p", "li", "tr") or low.startswith("h"):
                self.new_line()
            return
        at = len(self.path) - 1
        while at >= 0 and spelled(self.path[at])[1] != low:
            at -= 1
        if at < 0:
            return
        key = ".".join(self.path[: at + 1])
        if text := self.text.strip():
            if key not in self.fields:
                self.fields[key] = text
            elif self.fields[key]:
                self.fields[key] += ", " + text
        if is_pair(low):
            self.pivot(key, self.path[:at])
        del self.path[at:]
        self.text = ""

    def pivot(self, base: str, parents: list[str]) -> None:
        """A name and a value below an element become one field beside it. A name without a value leaves it empty."""
        first = lambda keys: next((k for x in keys if (k := f"{base}.{x}") in self.fields), None)
        if (name_at := first(NAME_KEYS)) is None:
            return
        value_at = first(VALUE_KEYS)
        name = self.fields.pop(name_at).strip()
        value = self.fields.pop(value_at, "") if value_at and value_at != name_at else ""
        if not name:
            return
        key = ".".join((*parents, name))
        if key in self.fields:
            self.fields[key] = ", ".join(x for x in (self.fields[key], value) if x)
        else:
            self.fields[key] = value


def records(text: str, tag: str, skip_descriptions: bool = False, whole: bool = True) -> Iterator[dict[str, str]]:
    """The records of a piece of a feed. A record ends at its first closing tag, or where the piece ends."""
    low, record = strip_namespace(tag).lower(), None
    for kind, value, rest in events(text):
        if record is not None:
            if record.feed(kind, value, rest):
                yield record.fields
                record = None
        elif kind in (START, EMPTY) and spelled(value)[1] == low:
            if kind == EMPTY:
                yield dict(attributes(rest))
            else:
                record = Record(low, rest, skip_descriptions)
    if record is not None and whole:
        yield record.fields
