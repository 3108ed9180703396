"""Exports: CSV and JSON files of rows and results, on any file system of Spark's. Each runs its query once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftline.functions.layout import fresh_path, hadoop_path, remove
from siftline.operators.analytics import frequency
from siftline.operators.feed import FeedFrame


def _counted(df: DataFrame, what: str = "*") -> tuple[DataFrame, Observation]:
    """The same rows, and the number of them (or of a column's values) once they are written."""
    seen = Observation()
    return df.observe(seen, F.count(what).alias("n")), seen


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; quotes within values are doubled, white space around them stays."""
    out = df.coalesce(1) if single else df
    kept = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("overwrite").options(**kept).csv(path)


def write_json(df: DataFrame, path: str, as_array: bool = True) -> None:
    """Rows as objects, one a line; as_array joins them, inside the JVM, to one JSON array in one file."""
    rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    if not as_array:
        rows.write.mode("overwrite").text(path)
        return
    write_framed(rows, path, "[\n\t", ",\n\t", "\n]\n", "[\n]\n")


def write_framed(rows: DataFrame, path: str, before: str, between: str, after: str, nothing: str | None = None) -> None:
    """A column of texts as one file, with texts before, between and behind them. Parts are written by all tasks and joined
    inside the JVM, in order."""
    spark = rows.sparkSession
    jvm, parts = spark._jvm, fresh_path(spark, "parts")
    rows.write.option("lineSep", between).text(parts)
    p, fs = hadoop_path(spark, parts)
    files = sorted((f for f in fs.listStatus(p) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    target, target_fs = hadoop_path(spark, path)
    out = target_fs.create(target, True)
    try:
        if not files and nothing is not None:
            before, after = nothing, ""
        out.write(bytearray(before.encode()))
        for k, f in enumerate(files):
            source = fs.open(f.getPath())
            # Each part ends with what stands between rows; behind the last one nothing follows.
            kept = f.getLen() - len(between.encode()) * (k == len(files) - 1)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.org.apache.commons.io.input.BoundedInputStream(source, kept), out, 1 << 17, False)
            source.close()
        out.write(bytearray(after.encode()))
    finally:
        out.close()
        remove(spark, parts)


def export_records(feed: FeedFrame, path: str, as_json: bool = False, text: str | None = None) -> int:
    rows, seen = _counted(feed.filter(text).df)
    (write_json if as_json else write_csv)(rows, path)
    return seen.get["n"]


def export_frequency(feed: FeedFrame, column: str, path: str, text: str | None = None) -> int:
    """Writes the frequencies of a column; gives its number of different values."""
    f, seen = _counted(frequency(feed.filter(text).df, feed.column(column), raw="raw"), "raw")
    write_csv(f.drop("raw").withColumnRenamed("value", column), path)
    return seen.get["n"]


def export_cross_tab(feed: FeedFrame, primary: str, secondary: str, path: str, text: str | None = None) -> int:
    t, seen = _counted(feed.cross_tab(primary, secondary, None, text))
    write_csv(t.withColumnRenamed("primary_value", primary).withColumnRenamed("total", "Total"), path)
    return seen.get["n"]


def export_pairs(feed: FeedFrame, primary: str, secondary: str, path: str, text: str | None = None) -> int:
    p, seen = _counted(feed.pairs(primary, secondary, text))
    write_csv(p, path)
    return seen.get["n"]


def export_custom(feed: FeedFrame, columns: list[str], path: str, deduplicate: bool = False, include_counts: bool = False, text: str | None = None) -> int:
    c, seen = _counted(feed.custom(columns, deduplicate, include_counts, text))
    write_csv(c, path)
    return seen.get["n"]


def export_companies(feed: FeedFrame, path: str, text: str | None = None) -> int:
    column = feed.company_column()
    if column is None:
        raise ValueError("no column of companies")
    return export_frequency(feed, column, path, text)


def profile_matrix(profile: DataFrame) -> DataFrame:
    """The profile as it is exported."""
    return profile.select(
        F.col("original_name").alias("Column Name"), F.col("inferred_type").alias("Data Type"), F.format_string("%.1f", "fill_rate").alias("Fill Rate (%)"),
        F.col("valid_count").alias("Valid Count"), F.col("empty_count").alias("Missing Count"), F.col("unique_count").alias("Unique Values"),
        F.col("min_length").alias("Min Length"), F.col("max_length").alias("Max Length"), F.col("avg_length").alias("Avg Length"),
        F.when(F.col("is_candidate_key"), "YES").otherwise("NO").alias("Candidate Key"),
    )


def export_profile(profile: DataFrame, path: str) -> int:
    rows, seen = _counted(profile_matrix(profile))
    write_csv(rows, path, single=True)
    return seen.get["n"]
