"""Counting operators over a table of text columns. Groups are of raw values; labels are put on afterwards. Ties are settled by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import feed_trim, full_trim, is_missing, labelled, percent, plain_percent

TOP_SECONDARY, OTHER, UNKNOWN, EMPTY, UNSPECIFIED, NULL_OR_EMPTY = 20, "[Other]", "[Unknown]", "[Empty]", "[Unspecified / None]", "[NULL / EMPTY]"


def _c(name: str):
    return F.col(f"`{name}`")


def overview(df: DataFrame, elapsed: float = 0.0) -> DataFrame:
    """One row: records, columns, and records a second if the time taken is worth dividing by."""
    rate = F.col("total_records") / F.lit(elapsed) if elapsed > 0.05 else F.lit(0.0)
    return df.agg(F.count("*").alias("total_records")).select("total_records", F.lit(len(df.columns)).cast("long").alias("column_count"), F.lit(elapsed).alias("elapsed_secs"), rate.cast("double").alias("records_per_sec"))


def _counted(df: DataFrame, groups: list) -> tuple[DataFrame, DataFrame]:
    """The rows of each group, and of all as one row: the sum of the groups', so the input is read once."""
    counts = df.groupBy(*groups).agg(F.count("*").alias("count"))
    return counts, counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def distribution(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """The most frequent raw values with their share of all rows; null and blank values are labelled."""
    counts, total = _counted(df, [_c(column).alias("raw")])
    label = F.when(F.col("raw").isNull(), "[NULL]").when(full_trim(F.col("raw")) == "", "[EMPTY]").otherwise(F.col("raw"))
    top = counts.orderBy(F.desc("count"), F.col("raw").asc_nulls_last()).limit(limit)
    return top.crossJoin(F.broadcast(total)).select(label.alias("value"), "count", plain_percent(F.col("count"), F.col("total")).alias("percentage"))


def duplicates(df: DataFrame, column: str, limit: int = 30) -> DataFrame:
    """The values that occur more than once, blank ones left out."""
    counts = df.filter(~is_missing(_c(column))).groupBy(_c(column).alias("key")).agg(F.count("*").alias("count"))
    return counts.filter("count > 1").orderBy(F.desc("count"), "key").limit(limit)


def frequency(df: DataFrame, column: str, raw: str | None = None) -> DataFrame:
    """Every value with its count and share, the most frequent first; with a name for it, the value without a label too."""
    counts, total = _counted(df, [_c(column).alias("raw")])
    return counts.crossJoin(F.broadcast(total)).select(F.coalesce("raw", F.lit(NULL_OR_EMPTY)).alias("value"), "count", percent(F.col("count"), F.col("total")).alias("percentage"), *([F.col("raw").alias(raw)] if raw else [])).orderBy(F.desc("count"), "value")


def unique_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(_c(column)).alias("unique_count"))


def pairs(df: DataFrame, primary: str, secondary: str, count_name: str = "job_count") -> DataFrame:
    """Every pair of raw values with its count."""
    counts = df.groupBy(_c(primary).alias("p"), _c(secondary).alias("s")).agg(F.count("*").alias("n"))
    return counts.select(labelled(F.col("p"), UNSPECIFIED).alias(primary), labelled(F.col("s"), UNSPECIFIED).alias(secondary), F.col("n").alias(count_name)).orderBy(F.desc(count_name), _c(primary), _c(secondary))


def custom_columns(df: DataFrame, columns: Sequence[str], deduplicate: bool = False, include_counts: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """Chosen columns: plain, distinct, or with the count and share of each combination; counts go before deduplicate."""
    shown = [(c, (names or {}).get(c, c)) for c in columns]
    if include_counts:
        counts, total = _counted(df, [_c(c).alias(f"g{k}") for k, c in enumerate(columns)])
        out = counts.crossJoin(F.broadcast(total)).select(*(F.coalesce(F.col(f"g{k}").cast("string"), F.lit(NULL_OR_EMPTY)).alias(n) for k, (_, n) in enumerate(shown)), "count", percent(F.col("count"), F.col("total")).alias("percentage"))
        return out.orderBy(F.desc("count"), *(_c(n) for _, n in shown))
    out = df.select(*(F.coalesce(_c(c).cast("string"), F.lit(NULL_OR_EMPTY)).alias(n) for c, n in shown))
    return out.distinct() if deduplicate else out


def group_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*map(_c, columns)).agg(F.lit(1).alias("one")).agg(F.count("*").alias("groups"))


def top_secondary(df: DataFrame, secondary: str, k: int = TOP_SECONDARY) -> tuple[list[str], bool]:
    """The most frequent trimmed values of a column, missing ones as [Empty], and whether there are others."""
    counts = df.groupBy(labelled(_c(secondary), EMPTY).alias("v")).agg(F.count("*").alias("n"))
    top = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(k + 1).collect()]
    return top[:k], len(top) > k


def cross_tab(df: DataFrame, primary: str, secondary: str, limit: int | None = 150, k: int = TOP_SECONDARY) -> DataFrame:
    """A row per raw primary value, a column per frequent secondary value, the rest as [Other], and the total."""
    top, others = top_secondary(df, secondary, k)
    trimmed = feed_trim(_c(secondary))
    hit = lambda v: is_missing(_c(secondary)) if v == EMPTY else trimmed == F.lit(v)
    cells = [F.count_if(F.coalesce(hit(v), F.lit(False))).alias(f"c{i}") for i, v in enumerate(top)]
    by = df.groupBy(_c(primary).alias("raw")).agg(*cells, F.count("*").alias("total"))
    by = by.orderBy(F.desc("total"), F.col("raw").asc_nulls_last())
    by = by.limit(limit) if limit is not None else by
    shown = [F.col(f"c{i}").alias(v) for i, v in enumerate(top)]
    if others:
        rest = F.col("total") - sum((F.col(f"c{i}") for i in range(len(top))), F.lit(0))
        shown.append(F.greatest(rest, F.lit(0)).cast("long").alias(OTHER))
    return by.select(labelled(F.col("raw"), UNKNOWN).alias("primary_value"), *shown, "total")


def page(df: DataFrame, number: int = 1, size: int = 50, sort: str | None = None, descending: bool = False) -> DataFrame:
    """One page of the rows; page 0 is page 1; nulls sort last both ways, ties by all columns."""
    if sort:
        key = _c(sort).desc_nulls_last() if descending else _c(sort).asc_nulls_last()
        df = df.orderBy(key, *(_c(c).asc_nulls_last() for c in df.columns if c != sort))
    return df.offset((max(number, 1) - 1) * size).limit(size)


def page_after(df: DataFrame, after: Sequence[str | None] | None = None, size: int = 50, sort: str | None = None, descending: bool = False) -> DataFrame:
    """The rows behind a row that is given by its values, in the order of page(): deep pages cost what the first one does.

    Rows that are equal in all columns count as one place.
    """
    order = [c for c in ([sort] if sort else []) + df.columns if c]
    order = list(dict.fromkeys(order))
    keys = [(c, descending and c == sort) for c in order]
    if after is not None:
        values = dict(zip(df.columns, after, strict=True))
        behind = F.lit(False)
        for c, down in reversed(keys):
            v = F.lit(values[c]).cast("string")
            greater = F.lit(False) if values[c] is None else _c(c).isNull() | ((_c(c) < v) if down else (_c(c) > v))
            behind = greater | (_c(c).eqNullSafe(v) & behind)
        df = df.filter(F.coalesce(behind, F.lit(False)))
    return df.orderBy(*(_c(c).desc_nulls_last() if down else _c(c).asc_nulls_last() for c, down in keys)).limit(size)
