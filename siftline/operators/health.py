"""Views of a profile: tiers, bands, filters, sorts and suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETE, CRITICAL, BANDS = 99.9, 10.0, (10, 50, 90)
#: Names that a company column goes by, parts of names that rule one out, parts of names of columns that are
#: suggested, and the names of the column that an export begins with.
COMPANY_NAMES = ("source.name", "source_name", "company", "company_name", "employer", "employer_name", "brand_name", "brand", "name")
NOT_COMPANY = ("user", "file", "first", "last")
COMPANY_PARTS = ("name", "company", "brand", "employer", "source")
EXPORT_NAMES = ("source.name", "source_name", "company", "name", "brand_name")
#: Fixed values of completions: columns that are offered before anything is typed, names of yes-or-no and of pay columns
#: with what is offered for them, and operators.
FIRST_COLUMNS = ("source_name", "locations_location_city", "remote", "work_model", "salary", "title")
YES_NO_PARTS, YES_NO = ("remote", "is_"), ("true", "false")
PAY_PARTS, PAY = ("salary", "pay", "wage", "rate"), (">50k", ">80k", ">100k", "50k..100k", "80k..150k")
OPERATORS = ("AND", "OR", "NOT", "missing:", "populated:")


def tier(fill: Column) -> Column:
    return F.when(fill >= COMPLETE, "complete").when(fill >= CRITICAL, "warning").otherwise("critical")


def band(fill: Column) -> Column:
    """0 to 3: how many of the badge limits a fill rate reaches."""
    return sum((F.when(fill >= b, 1).otherwise(0) for b in BANDS), F.lit(0))


def tier_counts(profile: DataFrame) -> DataFrame:
    """One row: columns by tier, nearly empty ones, and the average fill rate."""
    t = tier(F.col("fill_rate"))
    return profile.agg(*(F.count_if(t == x).alias(x) for x in ("complete", "warning", "critical")), F.count_if(F.col("fill_rate") < 0.1).alias("empty"), F.coalesce(F.avg("fill_rate"), F.lit(0.0)).alias("average_fill"))


def priorities(profile: DataFrame, k: int = 3) -> DataFrame:
    """The emptiest columns that are not complete."""
    return profile.filter(F.col("fill_rate") < COMPLETE).orderBy("fill_rate", "column_name").limit(k)


def filter_profile(profile: DataFrame, text: str = "", least: float = 0.0, most: float = 100.0, in_tier: str | None = None, keys_only: bool = False) -> DataFrame:
    """Columns whose name or type contains a text, within a range of fill rates, in a tier, or that may be keys."""
    out = profile.filter(F.col("fill_rate").between(least, most))
    if text:
        needle = text.strip().lower()
        out = out.filter(F.lower("column_name").contains(needle) | F.lower("original_name").contains(needle) | F.lower("inferred_type").contains(needle))
    if in_tier:
        out = out.filter(tier(F.col("fill_rate")) == in_tier)
    return out.filter("is_candidate_key") if keys_only else out


def sort_profile(profile: DataFrame, by: str = "fill_rate", descending: bool = True) -> DataFrame:
    key = {"name": "original_name", "type": "inferred_type", "fill": "fill_rate", "uniques": "unique_count", "valid": "valid_count", "missing": "empty_count", "length": "avg_length"}.get(by, by)
    return profile.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "column_name")


def uniqueness(profile: DataFrame) -> DataFrame:
    return profile.withColumn("uniqueness", F.when(F.col("valid_count") > 0, F.col("unique_count") / F.col("valid_count") * 100).otherwise(0.0)).withColumn("missing", F.greatest(F.col("total_records") - F.col("valid_count"), F.lit(0)))


def split_complete(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    return profile.filter("fill_rate >= 100"), profile.filter("fill_rate < 100")


def suggested_pivots(profile: DataFrame, selected: str = "", k: int = 8) -> list[str]:
    """Columns of few values worth breaking another column down by."""
    rows = profile.filter(F.col("unique_count").between(2, 25) & (F.col("column_name") != selected)).select("column_name").collect()
    return [r[0] for r in rows if "id" not in r[0].lower() and "url" not in r[0].lower()][:k]


def chart(distribution: DataFrame, k: int = 15, width: int = 25) -> DataFrame:
    """The first rows of a distribution with labels cut to a width."""
    cut = F.when(F.char_length("value") > width, F.concat(F.substring("value", 1, width), F.lit("..."))).otherwise(F.col("value"))
    return distribution.limit(k).withColumn("label", cut)


def matching(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose value contains a text, whatever its case."""
    return df.filter(F.lower(F.col(f"`{column}`")).contains(text.strip().lower()))


def inspect(df: DataFrame, text: str = "") -> DataFrame:
    """(row, key, value) of rows' fields whose key or value contains a text."""
    fields = F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns)))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.explode(fields).alias("key", "value"))
    needle = text.strip().lower()
    return rows.filter(F.lower("key").contains(needle) | F.lower(F.coalesce("value", F.lit(""))).contains(needle)) if needle else rows


def record_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("record"))


def visible_columns(fill: dict[str, float], columns: Sequence[str], filter_text: str = "") -> list[str]:
    """Columns by falling fill rate, unknown ones as half full; a column that the filter names comes first."""
    order = sorted(columns, key=lambda c: -fill.get(c, 50.0))
    named = filter_text.partition(":")[2].strip().lower() if filter_text.startswith(("missing:", "populated:")) else filter_text.partition(":")[0].strip().lower()
    pinned = [c for c in order if c.lower() == named]
    return pinned + [c for c in order if c not in pinned]


def company_column(columns: Sequence[str]) -> str | None:
    """The column that holds companies: the first of a usual name, else the first that looks like one."""
    looks = lambda c: ("company" in c or "employer" in c or c.endswith((".name", "_name"))) and not any(x in c for x in NOT_COMPANY)
    return next((c for c in columns if c.lower() in COMPANY_NAMES), next((c for c in columns if looks(c.lower())), None))


def company_columns(columns: Sequence[str], k: int = 6) -> list[str]:
    return [c for c in columns if any(x in c.lower() for x in COMPANY_PARTS)][:k]


def export_columns(columns: Sequence[str]) -> list[str]:
    """The column that an export begins with: the first of a usual name, else the first of all."""
    return [c for c in columns if c.lower() in EXPORT_NAMES][:1] or [*columns[:1]]


def complete_query(text: str, profile: Sequence, k: int = 8, columns: int = 6) -> list[str]:
    """Suggestions for the last word of a filter text.

    Behind a column's name and a colon: shortcuts of its kind, its samples that hold what is typed, and whether it is filled.
    Else columns, by name or original name, and operators that begin so; before anything is typed, usual columns.
    """
    word = text[max(text.rfind(" "), text.rfind("(")) + 1 :]
    name, colon, begun = word.partition(":")
    low = name.strip().lower()
    if not colon:
        named = lambda r: (r["column_name"].lower(), r["original_name"].lower())
        hits = [r for r in profile if (any(low in n for n in named(r)) if low else any(p in named(r)[0] for p in FIRST_COLUMNS))]
        found = [f"{r['original_name'] or r['column_name']}:" for r in hits[:columns]]
        return [*found, *(o for o in OPERATORS if low and o.lower().startswith(low))][:k]
    start = begun.lower()
    out = [v for parts, values in ((YES_NO_PARTS, YES_NO), (PAY_PARTS, PAY)) if any(p in low for p in parts) for v in values if v.startswith(start)]
    row = next((r for r in profile if low in (r["column_name"].lower(), r["original_name"].lower())), None)
    samples = [s.strip() for s in row["sample_values"]] if row is not None else []
    out += [f'"{s}"' if " " in s else s for s in samples if s and start in s.lower()]
    more = [f"missing:{low}", f"populated:{low}"] if not begun else []
    return [*(f"{low}:{v}" for v in out[:k]), *more][:k]
