"""Types and keys that names and sample values suggest."""

from __future__ import annotations

import re
from collections.abc import Sequence

#: Parts of names that suggest a type, beginnings of links, signs of markup, the texts of yes and no; names,
#: ends and parts of names that say that a column identifies its rows, and parts of identifiers that do not; types of
#: which no column identifies rows.
URL_PARTS, EMAIL_PARTS, HTML_PARTS = ("url", "link"), ("email",), ("html", "description")
ID_PARTS, DATE_PARTS, NUMBER_PARTS = ("id", "guid", "code", "ref", "key"), ("date", "time"), ("salary", "price", "amount", "count")
LINKS, YES_NO = ("http://", "https://"), ("true", "false", "0", "1")
KEY_NAMES, KEY_ENDS, KEY_PARTS = ("id", "refcode", "job_id", "jobid"), (".id", ".refcode", ".job_id"), ("reference", "requisition")
NO_KEY_PARTS, NO_KEY_TYPES = ("country", "currency"), ("URL", "HTML", "Date", "Boolean")

_DATE = re.compile(r"[0-9][0-9\-/:TZ ]*")
_FLOAT = re.compile(r"[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)", re.IGNORECASE)
_MONEY = "$€£"


def _named(name: str, *parts: str) -> bool:
    return any(p in name for p in parts)


def _dated(s: str) -> bool:
    s = s.strip()
    return 8 <= len(s.encode()) <= 30 and _DATE.fullmatch(s) is not None and (s.count("-") == 2 or s.count("/") == 2)


def _numeric(s: str) -> bool:
    return _FLOAT.fullmatch(s.strip().lstrip(_MONEY).replace(",", "")) is not None


def infer_type(name: str, samples: Sequence[str]) -> str:
    """The first label that fits: Empty, URL, Email, HTML, Identifier, Date, Boolean, Numeric, else Text."""
    n = name.lower()
    if not samples:
        return "Empty"
    rules = (
        ("URL", any(s.startswith(LINKS) for s in samples) or _named(n, *URL_PARTS)),
        ("Email", any("@" in s and "." in s for s in samples) or _named(n, *EMAIL_PARTS)),
        ("HTML", any("<" in s and ">" in s or "&lt;" in s or "<![CDATA[" in s for s in samples) or _named(n, *HTML_PARTS)),
        ("Identifier", _named(n, *ID_PARTS)),
        ("Date", all(map(_dated, samples)) or _named(n, *DATE_PARTS)),
        ("Boolean", all(s.lower() in YES_NO for s in samples)),
        ("Numeric", all(map(_numeric, samples)) or _named(n, *NUMBER_PARTS)),
    )
    return next((label for label, fits in rules if fits), "Text")


def is_candidate_key(name: str, kind: str, total: int, valid: int, unique: int) -> bool:
    """Whether a column may identify its rows. A column whose name says so may have a few gaps and repeats."""
    n = name.lower()
    says_so = n in KEY_NAMES or n.endswith(KEY_ENDS) or _named(n, *KEY_PARTS)
    if not total:
        return False
    if says_so or kind == "Identifier" and not _named(n, *NO_KEY_PARTS):
        return valid / total * 100 >= 99.0 and unique / total >= 0.95
    return kind not in NO_KEY_TYPES and valid == total and unique >= total
