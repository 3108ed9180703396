"""Tables as feeds, and the SQL of their profiles, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.feed import FeedFrame

_SPARSE = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '  ' ELSE event_type END"
#: The sparse events in SQL, as text.
EVENTS = f"(SELECT CAST(event_id AS VARCHAR) event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, CAST(user_id AS VARCHAR) user_id, {_SPARSE} event_type, CAST(value AS VARCHAR) AS value, props FROM events)"


def feed(spark: SparkSession, sf_dir: str, table: str) -> FeedFrame:
    return FeedFrame.from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def sparse_events(spark: SparkSession, sf_dir: str) -> FeedFrame:
    """The events as a feed in which every seventh type is null and every eleventh blank."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_type", F.expr(_SPARSE)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return FeedFrame.from_table(e)


_TEXT = "CAST({} AS VARCHAR)".format
#: Columns of the profiled tables and their text.
COLUMNS = {
    "orders": [("o_orderkey", _TEXT("o_orderkey")), ("o_custkey", _TEXT("o_custkey")), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", _TEXT("o_totalprice")), ("o_orderdate", _TEXT("o_orderdate")), ("o_orderpriority", "o_orderpriority")],
    "customer": [("c_custkey", _TEXT("c_custkey")), ("c_name", "c_name"), ("c_nationkey", _TEXT("c_nationkey")), ("c_acctbal", _TEXT("c_acctbal")), ("c_mktsegment", "c_mktsegment")],
    "part": [("p_partkey", _TEXT("p_partkey")), ("p_name", "p_name"), ("p_brand", "p_brand"), ("p_type", "p_type"), ("p_size", _TEXT("p_size")), ("p_retailprice", _TEXT("p_retailprice"))],
    "events": [("event_id", "event_id"), ("ts", "ts"), ("user_id", "user_id"), ("event_type", "event_type"), ("props", "props")],
}


def _any(samples: str, test: str) -> str:
    return f"len(list_filter({samples}, lambda x: {test})) > 0"


def _all(samples: str, test: str) -> str:
    return f"len(list_filter({samples}, lambda x: NOT ({test}))) = 0"


def _type_sql(name: str) -> str:
    """The label that a column's name and its samples suggest."""
    n, s = name.lower(), "sample_values"
    named = lambda *parts: str(any(p in n for p in parts)).lower()
    dated = "length(trim(x)) BETWEEN 8 AND 30 AND regexp_full_match(trim(x), '[0-9][0-9/:TZ -]*') AND (length(x) - length(replace(x, '-', '')) = 2 OR length(x) - length(replace(x, '/', '')) = 2)"
    return f"""CASE WHEN len({s}) = 0 THEN 'Empty'
 WHEN {_any(s, "x LIKE 'http://%' OR x LIKE 'https://%'")} OR {named("url", "link")} THEN 'URL'
 WHEN {_any(s, "contains(x, '@') AND contains(x, '.')")} OR {named("email")} THEN 'Email'
 WHEN {_any(s, "contains(x, '<') AND contains(x, '>')")} OR {named("html", "description")} THEN 'HTML'
 WHEN {named("id", "guid", "code", "ref", "key")} THEN 'Identifier'
 WHEN {_all(s, dated)} OR {named("date", "time")} THEN 'Date'
 WHEN {_all(s, "lower(x) IN ('true', 'false', '0', '1')")} THEN 'Boolean'
 WHEN {_all(s, "TRY_CAST(replace(trim(x), ',', '') AS DOUBLE) IS NOT NULL")} OR {named("salary", "price", "amount", "count")} THEN 'Numeric' ELSE 'Text' END"""


def _key_sql(name: str) -> str:
    n = name.lower()
    says_so = str(n in ("id", "refcode", "job_id", "jobid") or n.endswith((".id", ".refcode", ".job_id")) or "reference" in n or "requisition" in n).lower()
    foreign = str("country" in n or "currency" in n).lower()
    return f"""CASE WHEN {says_so} OR inferred_type = 'Identifier' AND NOT {foreign} THEN valid_count * 100 >= 99 * total_records AND unique_count * 100 >= 95 * total_records
 ELSE inferred_type NOT IN ('URL', 'HTML', 'Date', 'Boolean') AND valid_count = total_records AND unique_count >= total_records END"""


def profile_sql(table: str, columns: list[tuple[str, str]], full: bool = False) -> str:
    """The figures of columns (name, text) of a table; full: with place, samples, type and key."""

    def one(place: int, name: str, text: str) -> str:
        t = f"(SELECT {text} AS v FROM {table})"
        figures = f"""SELECT '{name}' AS column_name, COUNT(*) AS total_records, COUNT(v) AS non_null_count, COUNT(*) - COUNT(CASE WHEN TRIM(v) <> '' THEN 1 END) AS empty_count,
 COUNT(CASE WHEN TRIM(v) <> '' THEN 1 END) AS valid_count, COUNT(CASE WHEN TRIM(v) <> '' THEN 1 END)::DOUBLE / COUNT(*) * 100.0 AS fill_rate, COUNT(DISTINCT v) AS unique_count,
 COALESCE(MIN(LENGTH(TRIM(v))), 0) AS min_length, COALESCE(MAX(LENGTH(TRIM(v))), 0) AS max_length, ROUND(COALESCE(SUM(LENGTH(TRIM(v)))::DOUBLE / COUNT(v), 0), 1) AS avg_length"""
        if not full:
            return f"{figures} FROM {t}"
        samples = f"COALESCE((SELECT list(v ORDER BY v) FROM (SELECT DISTINCT v FROM {t} WHERE TRIM(v) <> '' ORDER BY v LIMIT 10)), [])"
        return f"SELECT *, {_key_sql(name)} AS is_candidate_key FROM (SELECT *, {_type_sql(name)} AS inferred_type FROM ({figures}, {place} AS place, '{name}' AS original_name, {samples} AS sample_values FROM {t}))"

    return "\nUNION ALL\n".join(one(k, n, t) for k, (n, t) in enumerate(columns))
