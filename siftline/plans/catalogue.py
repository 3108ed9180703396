"""The registered queries of the feed operators over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import analytics, health
from siftline.operators.feed import FeedFrame
from siftline.operators.profile import column_figures, row_health, value_counts
from siftline.plans import feeds
from siftline.plans.tables import COLUMNS, EVENTS, feed, profile_sql, sparse_events

#: The filter texts that are queries, by name, over the sparse events.
FILTERS = {
    "contains": "event_type:LICK",
    "quoted": 'event_type:"Click"',
    "not_equal": "event_type!=click",
    "minus": "-event_type:click",
    "not": "NOT event_type:click",
    "missing": "missing:event_type",
    "populated": "populated:event_type",
    "number": "value:>20",
    "number_least": "value>=20.5",
    "number_range": "value:10..0.02k",
    "date": "ts:>=2024-01-15",
    "date_range": "ts:2024-01-05..2024-01-20",
    "text_order": "event_type:>m",
    "truth": "user_id:1",
    "untruth": "user_id:0",
    "not_true": "user_id!=true",
    "either": "(event_type:click OR event_type:view) user_id:>50",
    "mixed": "event_type:purchase AND value:<30 OR user_id=7",
    "anywhere": "click",
    "wildcard": "event_type:c_i%k",
}


def _contains(c: str, v: str) -> str:
    return f"{c} ILIKE '%{v}%'"


_NUM = "TRY_CAST(REGEXP_REPLACE({}, '[^0-9.]', '', 'g') AS DOUBLE)".format
_FILTER_SQL = {
    "contains": _contains("event_type", "LICK"),
    "quoted": "LOWER(TRIM(event_type)) = 'click'",
    "not_equal": f"(event_type IS NULL OR NOT {_contains('event_type', 'click')})",
    "minus": f"NOT ({_contains('event_type', 'click')})",
    "not": f"NOT ({_contains('event_type', 'click')})",
    "missing": "(event_type IS NULL OR TRIM(event_type) = '')",
    "populated": "(event_type IS NOT NULL AND TRIM(event_type) <> '')",
    "number": f"{_NUM('value')} > 20",
    "number_least": f"{_NUM('value')} >= 20.5",
    "number_range": f"{_NUM('value')} BETWEEN 10 AND 20",
    "date": "TRY_CAST(ts AS DATE) >= DATE '2024-01-15'",
    "date_range": "TRY_CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    "text_order": "event_type > 'm'",
    "truth": f"(LOWER(TRIM(user_id)) IN ('true', '1', 'yes') OR {_contains('user_id', 'true')})",
    "untruth": f"(user_id IS NULL OR LOWER(TRIM(user_id)) IN ('false', '0', 'no', '') OR {_contains('user_id', 'false')})",
    "not_true": "(user_id IS NULL OR LOWER(TRIM(user_id)) NOT IN ('true', '1', 'yes'))",
    "either": f"({_contains('event_type', 'click')} OR {_contains('event_type', 'view')}) AND {_NUM('user_id')} > 50",
    "mixed": f"({_contains('event_type', 'purchase')} AND {_NUM('value')} < 30) OR {_contains('user_id', '7')}",
    "anywhere": " OR ".join(_contains(c, "click") for c in ("event_id", "ts", "user_id", "event_type", "value", "props")),
    "wildcard": _contains("event_type", "c_i%k"),
}
_FIGURES = ("column_name", "total_records", "non_null_count", "empty_count", "valid_count", "fill_rate", "unique_count", "min_length", "max_length", "avg_length")


def _figures(table: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = sparse_events(spark, sf_dir) if table == "events" else feed(spark, sf_dir, table)
        return column_figures(value_counts(f.df, [c for c, _ in COLUMNS[table]])).select(*_FIGURES)

    return run


def _filtered(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sparse_events(spark, sf_dir).filter(text).df


def _table(table: str, build: Callable[[FeedFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(sparse_events(spark, sf_dir) if table == "sparse" else feed(spark, sf_dir, table))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"filter_{name}": _filtered(text) for name, text in FILTERS.items()}
    out |= {f"figures_{t}": _figures(t) for t in COLUMNS}
    out |= {
        "overview_lineitem": _table("lineitem", lambda f: f.overview().select("total_records", "column_count")),
        "distribution_type": _table("sparse", lambda f: f.distribution("event_type")),
        "distribution_brand": _table("part", lambda f: f.distribution("p_brand", 10)),
        "duplicates_name": _table("part", lambda f: f.duplicates("p_name")),
        "duplicates_sparse": _table("sparse", lambda f: f.duplicates("event_type")),
        "frequency_segment": _table("customer", lambda f: f.frequency("c_mktsegment")),
        "frequency_sparse": _table("sparse", lambda f: f.frequency("event_type")),
        "unique_priority": _table("orders", lambda f: analytics.unique_count(f.df, "o_orderpriority")),
        "cross_tab_brand": _table("part", lambda f: long_cross_tab(f.cross_tab("p_type", "p_brand"))),
        "cross_tab_sparse": _table("sparse", lambda f: long_cross_tab(f.cross_tab("user_id", "event_type", None))),
        "pairs_sparse": _table("sparse", lambda f: f.pairs("event_type", "user_id")),
        "custom_plain": _table("sparse", lambda f: f.custom(["event_id", "event_type"])),
        "custom_distinct": _table("orders", lambda f: f.custom(["o_orderstatus", "o_orderpriority"], deduplicate=True)),
        "custom_counts": _table("orders", lambda f: f.custom(["o_orderstatus", "o_orderpriority"], include_counts=True)),
        "groups_pairs": _table("sparse", lambda f: analytics.group_count(f.df, ["event_type", "user_id"])),
        "page_sorted": _table("sparse", lambda f: analytics.page(f.df, 2, 50, "event_type").select("event_id", "event_type", "user_id")),
        "page_descending": _table("customer", lambda f: analytics.page(f.df, 3, 25, "c_name", True)),
        "row_health": _table("sparse", lambda f: f.df.select("event_id", row_health(f.df).cast("long").alias("filled"))),
        "tiers_sparse": lambda spark, sf_dir: health.tier_counts(_figures("events")(spark, sf_dir)).select("complete", "warning", "critical", "empty", F.round("average_fill", 9).alias("average_fill")),
        "matching_name": _table("part", lambda f: health.matching(f.df, "p_name", "RED").select("p_partkey", "p_name")),
    }
    return out | feeds.queries()


def long_cross_tab(table: DataFrame) -> DataFrame:
    """A cross-tab with a row for each cell: its columns follow the data, these do not."""
    cells = F.array(*(F.struct(F.lit(c).alias("secondary_value"), F.col(f"`{c}`").alias("n")) for c in table.columns if c not in ("primary_value", "total")))
    return table.select("primary_value", "total", F.inline(cells))


def _cross_sql(table: str, primary: str, secondary: str, limit: int | None) -> str:
    cut = f"ORDER BY total DESC, p NULLS LAST LIMIT {limit}" if limit else ""
    return f"""
WITH t AS (SELECT {primary} AS p, COALESCE(NULLIF(TRIM({secondary}), ''), '[Empty]') AS s FROM {table}),
ranked AS (SELECT s, COUNT(*) AS n FROM t GROUP BY s), top AS (SELECT s FROM ranked ORDER BY n DESC, s LIMIT 20),
totals AS (SELECT p, COUNT(*) AS total FROM t GROUP BY p {cut}),
cells AS (SELECT totals.p, totals.total, top.s, COUNT(t.s) AS n FROM totals CROSS JOIN top LEFT JOIN t ON t.p IS NOT DISTINCT FROM totals.p AND t.s = top.s GROUP BY ALL),
rest AS (SELECT p, total, '[Other]' AS s, total - SUM(n) AS n FROM cells WHERE (SELECT COUNT(*) FROM ranked) > 20 GROUP BY p, total)
SELECT COALESCE(NULLIF(TRIM(p), ''), '[Unknown]') AS primary_value, total, s AS secondary_value, n::BIGINT AS n FROM (SELECT * FROM cells UNION ALL SELECT * FROM rest)"""


def oracle_sql() -> dict[str, str]:
    e = EVENTS
    out = {f"filter_{n}": f"SELECT * FROM {e} WHERE {c}" for n, c in _FILTER_SQL.items()}
    out |= {f"figures_{t}": profile_sql(e if t == "events" else t, cols) for t, cols in COLUMNS.items()}
    pct = "ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {}), 2)".format
    out |= {
        "overview_lineitem": "SELECT COUNT(*) AS total_records, 11::BIGINT AS column_count FROM lineitem",
        "distribution_type": f"SELECT CASE WHEN event_type IS NULL THEN '[NULL]' WHEN TRIM(event_type) = '' THEN '[EMPTY]' ELSE event_type END AS \"value\", COUNT(*) AS count, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM events) * 100.0 AS percentage FROM {e} GROUP BY event_type ORDER BY count DESC LIMIT 50",
        "distribution_brand": "SELECT p_brand AS \"value\", COUNT(*) AS count, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM part) * 100.0 AS percentage FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 10",
        "duplicates_name": "SELECT p_name AS key, COUNT(*) AS count FROM part WHERE TRIM(p_name) <> '' GROUP BY p_name HAVING COUNT(*) > 1 ORDER BY count DESC, key LIMIT 30",
        "duplicates_sparse": f"SELECT event_type AS key, COUNT(*) AS count FROM {e} WHERE TRIM(event_type) <> '' GROUP BY event_type HAVING COUNT(*) > 1 ORDER BY count DESC, key LIMIT 30",
        "frequency_segment": f"SELECT c_mktsegment AS \"value\", COUNT(*) AS count, {pct('customer')} AS percentage FROM customer GROUP BY c_mktsegment",
        "frequency_sparse": f"SELECT COALESCE(event_type, '[NULL / EMPTY]') AS \"value\", COUNT(*) AS count, {pct('events')} AS percentage FROM {e} GROUP BY event_type",
        "unique_priority": "SELECT COUNT(DISTINCT o_orderpriority) AS unique_count FROM orders",
        "pairs_sparse": f"SELECT COALESCE(NULLIF(TRIM(event_type), ''), '[Unspecified / None]') AS event_type, COALESCE(NULLIF(TRIM(user_id), ''), '[Unspecified / None]') AS user_id, n AS job_count FROM (SELECT event_type, user_id, COUNT(*) n FROM {e} GROUP BY ALL)",
        "custom_plain": f"SELECT event_id, COALESCE(event_type, '[NULL / EMPTY]') AS event_type FROM {e}",
        "custom_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
        "custom_counts": f"SELECT o_orderstatus, o_orderpriority, COUNT(*) AS count, {pct('orders')} AS percentage FROM orders GROUP BY o_orderstatus, o_orderpriority",
        "groups_pairs": f"SELECT COUNT(*) AS \"groups\" FROM (SELECT 1 FROM {e} GROUP BY event_type, user_id)",
        "page_sorted": f"SELECT event_id, event_type, user_id FROM {e} ORDER BY event_type ASC NULLS LAST, event_id LIMIT 50 OFFSET 50",
        "page_descending": "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, CAST(c_nationkey AS VARCHAR) c_nationkey, CAST(c_acctbal AS VARCHAR) c_acctbal, c_mktsegment FROM customer ORDER BY c_name DESC NULLS LAST, CAST(c_custkey AS VARCHAR) LIMIT 25 OFFSET 50",
        "row_health": f"SELECT event_id, 5 + CASE WHEN event_type IS NOT NULL AND TRIM(event_type) <> '' THEN 1 ELSE 0 END::BIGINT AS filled FROM {e}",
        "tiers_sparse": f"SELECT COUNT(*) FILTER (fill_rate >= 99.9) AS complete, COUNT(*) FILTER (fill_rate >= 10 AND fill_rate < 99.9) AS warning, COUNT(*) FILTER (fill_rate < 10) AS critical, COUNT(*) FILTER (fill_rate < 0.1) AS \"empty\", ROUND(AVG(fill_rate), 9) AS average_fill FROM ({profile_sql(e, COLUMNS['events'])})",
        "matching_name": "SELECT CAST(p_partkey AS VARCHAR) p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')",
        "cross_tab_brand": _cross_sql("part", "p_type", "p_brand", 150),
        "cross_tab_sparse": _cross_sql(e, "user_id", "event_type", None),
    }
    return out | feeds.oracle_sql()
