"""Column expressions of the feed's text rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The space separators that SQL trimming removes. Tabs and line ends stay.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def feed_trim(c: Column) -> Column:
    """Without leading and trailing space separators."""
    return F.btrim(c, F.lit(SPACES))


def full_trim(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return feed_trim(c) == ""


def is_missing(c: Column) -> Column:
    return c.isNull() | is_blank(c)


def labelled(c: Column, label: str) -> Column:
    """The trimmed value, or a label where it is null or blank."""
    return F.coalesce(F.nullif(feed_trim(c), F.lit("")), F.lit(label))


def number_of(c: Column) -> Column:
    """What digits and points of a text make as a number; signs and exponents do not count."""
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("double")


def date_of(c: Column) -> Column:
    """The date of an ordinary year-month-day text, with - or / and perhaps a time; null otherwise."""
    t = F.trim(c)
    whole = t.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}($|[ T]\d{1,2}:)")
    return F.when(whole, F.regexp_replace(F.regexp_extract(t, r"^[0-9/-]+", 0), "/", "-").try_cast("date"))


def holds(c: Column, value: str) -> Column:
    """Whether a text contains a value, whatever its case. % and _ in the value are wildcards, a backslash is itself."""
    return c.ilike("%" + value.replace("\\", "\\\\") + "%")


def percent(part: Column, whole: Column) -> Column:
    """Rounded to two places; null of nothing."""
    return F.round(part.cast("double") * F.lit(100.0) / F.nullif(whole.cast("double"), F.lit(0.0)), 2)


def plain_percent(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double") * F.lit(100.0)


def text_length(c: Column) -> Column:
    return F.char_length(feed_trim(c)).cast("long")


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?")


def literal_number(s: str) -> float | None:
    """A number in a query: $, commas and spaces are dropped, k and m stand for thousands and millions."""
    s = re.sub(r"[$, ]", "", s.strip()).lower()
    scale = {"k": 1e3, "m": 1e6}.get(s[-1:], 1.0)
    s = s[:-1] if scale > 1 else s
    return float(s) * scale if _NUMBER.fullmatch(s) else None


def is_iso_date(s: str) -> bool:
    return re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", s.strip()) is not None


def format_size(n: int) -> str:
    for unit, size, places in (("GB", 1 << 30, 2), ("MB", 1 << 20, 1), ("KB", 1 << 10, 0)):
        if n >= size:
            return f"{n / size:.{places}f} {unit}"
    return f"{n} B"


def size_label(n: Column) -> Column:
    """format_size() of a column: whole numbers, halves to the even digit."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size, places in (("KB", 1 << 10, 0), ("MB", 1 << 20, 1), ("GB", 1 << 30, 2)):
        scaled = n * F.lit(10**places)
        whole = F.floor(scaled / F.lit(size)).cast("long")
        rest = 2 * (scaled - whole * F.lit(size)) - F.lit(size)
        digits = whole + F.when((rest > 0) | ((rest == 0) & (whole % 2 == 1)), 1).otherwise(0)
        parts = [F.floor(digits / 10**places).cast("string")] + ([F.lit("."), F.lpad((digits % 10**places).cast("string"), places, "0")] if places else [])
        out = F.when(n >= size, F.concat(*parts, F.lit(f" {unit}"))).otherwise(out)
    return out
