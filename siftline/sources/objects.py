"""Reading of JSON records: whole objects out of a running text, and their flat fields."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

#: Keys of long descriptions.
DESCRIPTIONS, DESCRIPTION_PART = ("body", "content"), "description"
_STEP = re.compile(r'["{}\[\]]')
_IN_STRING = re.compile(r'["\\]')


class _Text(str):
    """A number as it was written."""


def _is_description(key: str) -> bool:
    low = key.lower()
    return low in DESCRIPTIONS or DESCRIPTION_PART in low


def load(text: str) -> Any:
    """A JSON value whose numbers are as written; None if it is malformed."""
    try:
        return json.loads(text, parse_float=_Text, parse_int=_Text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return None


def dump(value: Any) -> str:
    """Compact JSON, numbers as written."""
    if isinstance(value, _Text):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def flatten(value: dict, skip_descriptions: bool = False, prefix: str = "") -> dict[str, str]:
    """Dotted keys and their texts. Null and empty arrays are absent; arrays of plain values are joined, arrays of
    objects numbered, other arrays stay JSON."""
    out: dict[str, str] = {}
    for name, v in value.items():
        if skip_descriptions and _is_description(name):
            continue
        key = f"{prefix}.{name}" if prefix else name
        if isinstance(v, bool):
            out[key] = "true" if v else "false"
        elif isinstance(v, str):
            out[key] = str(v)
        elif isinstance(v, dict):
            out |= flatten(v, skip_descriptions, key)
        elif isinstance(v, list) and v:
            if all(isinstance(x, str) for x in v):
                out[key] = ", ".join(v)
            elif all(isinstance(x, dict) for x in v):
                for k, x in enumerate(v):
                    out |= flatten(x, skip_descriptions, f"{key}.{k}")
            else:
                out[key] = dump(v)
    return out


def objects(pieces: Iterable[str], in_array: bool = False) -> Iterator[str]:
    """The outermost objects of a text that comes in pieces. In an array, its closing bracket ends them.

    Holds the object that is begun, no more.
    """
    text, at, begin, depth, in_string = "", 0, 0, 0, False
    for piece in pieces:
        text += piece
        while m := (_IN_STRING if in_string else _STEP).search(text, at):
            if m[0] == "\\":
                if m.end() == len(text):
                    at = m.start()  # what is escaped comes with the next piece
                    break
                at = m.end() + 1
                continue
            at = m.end()
            if m[0] == '"':
                in_string = not in_string
            elif m[0] == "{":
                begin = begin if depth else m.start()
                depth += 1
            elif m[0] == "}" and depth:
                depth -= 1
                if not depth:
                    yield text[begin:at]
            elif m[0] == "]" and in_array and not depth:
                return
        else:
            at = len(text)
        keep = begin if depth else at
        text, at, begin = text[keep:], at - keep, 0


def record_of(text: str, record_tag: str | None = None, skip_descriptions: bool = False) -> dict[str, str] | None:
    """The flat fields of an object, or of the member that record_tag names; None if it is malformed."""
    value = load(text)
    if not isinstance(value, dict):
        return None
    if record_tag and isinstance(value.get(record_tag), dict):
        value = value[record_tag]
    return flatten(value, skip_descriptions)
