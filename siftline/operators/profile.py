"""Completeness profile: one scan in long form serves every column.

Rows become (column, key of the value) pairs, which are counted before anything else; all figures of a column, exact
distinct counts included, come from those counts. A value longer than SHORT characters goes by a digest of 128 bits and its
length, so no long text is shuffled. No row is copied once per distinct count, and a value that fills a column is combined
before the shuffle.

The samples of a column are its least values. A bounded beginning of the table gives a value above which none can be a
sample; what lies up to it is found by a scan with that filter, so neither the values of a column nor their order ever
meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.inference import infer_type, is_candidate_key
from siftline.functions.layout import spread
from siftline.functions.names import ColumnMap
from siftline.functions.text import feed_trim, is_blank, text_length

#: Samples of a column, rows that bound them, the length from which on a value goes by its digest, and columns that are
#: turned to rows at once: of a wider table each scan reads so many.
SAMPLES, BOUNDING_ROWS, SHORT, WIDE = 10, 2000, 40, 100
SCHEMA = (
    "column_name string, original_name string, total_records long, non_null_count long, empty_count long, valid_count long, fill_rate double, unique_count long,"
    " sample_values array<string>, min_length long, max_length long, avg_length double, inferred_type string, is_candidate_key boolean, has_collision_risk boolean"
)


def _long_form(df: DataFrame, columns: list[str], values: Callable[[str], Column], keep: Callable[[Column], Column] = lambda pairs: pairs) -> DataFrame:
    """(column_name, and the fields of values(column)) rows of those pairs that are kept."""
    parts = []
    for k in range(0, max(len(columns), 1), WIDE):
        pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), values(c)) for c in columns[k : k + WIDE]))
        parts.append(df.select(F.inline(keep(pairs))))
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, key, n, length, filled): how often each value, null included, is in each column. A short value is its
    own key; filled is null for null, and whether the value is more than blanks."""
    df = spread(df.select(*(F.col(f"`{c}`") for c in columns or df.columns)))
    # No short value has the form of a digest with its length: that is longer.
    key = lambda v: F.when(F.char_length(v) <= SHORT, v).otherwise(F.concat(F.md5(v.cast("binary")), F.lit("#"), F.char_length(v), F.lit(" " * SHORT)))
    entry = lambda v: F.struct(key(v).alias("key"), text_length(v).alias("length"), (~is_blank(v)).alias("filled")).alias("v")
    pairs = _long_form(df, df.columns, lambda c: entry(F.col(f"`{c}`").cast("string")))
    return pairs.groupBy("column_name", "v.key").agg(F.count("*").alias("n"), F.max("v.length").alias("length"), F.max("v.filled").alias("filled"))


def column_figures(counts: DataFrame) -> DataFrame:
    """A row per column: the counts, lengths and fill rate of the profile."""
    n, length, filled = F.col("n"), F.col("length"), F.col("filled")
    by = counts.groupBy("column_name").agg(
        F.sum("n").alias("total_records"),
        F.coalesce(F.sum(F.when(filled.isNotNull(), n)), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(filled, n)), F.lit(0)).alias("valid_count"),
        F.count(filled).alias("unique_count"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
        F.round(F.coalesce(F.sum(length * n) / F.sum(F.when(filled.isNotNull(), n)), F.lit(0.0)), 1).alias("avg_length"),
    )
    return by.withColumn("empty_count", F.col("total_records") - F.col("valid_count")).withColumn("fill_rate", F.col("valid_count").cast("double") / F.col("total_records") * 100.0)


def _least(values: DataFrame, k: int) -> DataFrame:
    """(column_name, value) -> the k least different values of each column: first of each of its parts, then of these."""
    different = values.groupBy("column_name", "value").agg(F.lit(1).alias("one")).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64)))
    for by in (["column_name", "part"], ["column_name"]):
        different = different.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("value"))).filter(F.col("rank") <= k)
    return different.select("column_name", "value")


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = SAMPLES) -> dict[str, list[str]]:
    """The least values of each column that are not blank, at most k."""
    columns = columns or df.columns
    bounds: dict[str, list[str]] = {}
    for r in _least(_filled(df.limit(BOUNDING_ROWS), columns), k).collect():
        bounds.setdefault(r["column_name"], []).append(r["value"])
    most = {c: max(v, key=lambda x: x.encode()) for c, v in bounds.items() if len(v) == k}
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in _least(_filled(spread(df.select(*(F.col(f"`{c}`") for c in columns))), columns, most), k).collect():
        found[r["column_name"]].append(r["value"])
    return {c: sorted(v, key=lambda x: x.encode()) for c, v in found.items()}


def _filled(df: DataFrame, columns: list[str], most: dict[str, str] | None = None) -> DataFrame:
    """(column_name, value): the values that are more than blanks, of a column no larger than its bound."""

    def value(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        ok = ~is_blank(v)
        return F.when(ok & (v <= F.lit(most[c])) if most and c in most else ok, v).alias("value")

    return _long_form(df, columns, value, lambda pairs: F.filter(pairs, lambda x: x["value"].isNotNull()))


def profile(df: DataFrame, names: ColumnMap | None = None) -> DataFrame:
    """The completeness matrix, the fullest columns first, in table order where equally full. Labels are given to one row per column."""
    names = names or ColumnMap({c: (c,) for c in df.columns})
    place = {c: k for k, c in enumerate(df.columns)}
    with ThreadPoolExecutor(1) as beside:  # the samples' jobs run beside that of the figures
        found = beside.submit(inheritable_thread_target(df.sparkSession)(lambda: sample_values(df)))
        figures = column_figures(value_counts(df)).collect()
        samples = found.result()
    rows = []
    for r in figures:
        original, own = names.original(r["column_name"]), samples[r["column_name"]]
        kind = infer_type(original, own)
        key = is_candidate_key(original, kind, r["total_records"], r["valid_count"], r["unique_count"])
        rows.append((r["column_name"], original, r["total_records"], r["non_null_count"], r["empty_count"], r["valid_count"], r["fill_rate"], r["unique_count"], own, r["min_length"], r["max_length"], r["avg_length"], kind, key, False))
    rows.sort(key=lambda x: (-x[6], place[x[0]]))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def row_health(df: DataFrame) -> Column:
    """How many columns of a row are filled."""
    return sum((F.when(F.col(f"`{c}`").isNotNull() & (feed_trim(F.col(f"`{c}`").cast("string")) != ""), 1).otherwise(0) for c in df.columns), F.lit(0))
