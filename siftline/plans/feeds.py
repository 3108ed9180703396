"""The registered queries of reading, writing, profiling and viewing feeds, each with the same in DuckDB's SQL.

Feeds are made of whole tables in the shared folder, read back by the readers, and must hold what the tables do.
"""

from __future__ import annotations

import io
import tarfile
import threading
import zipfile
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.layout import fresh_path, hadoop_path
from siftline.functions.names import sanitize
from siftline.functions.text import size_label
from siftline.operators import analytics, health
from siftline.operators.feed import FeedFrame
from siftline.plans.filters import search_words
from siftline.plans.tables import COLUMNS, EVENTS, feed, profile_sql, sparse_events
from siftline.sources import sinks, sniff
from siftline.sources.catalog import Catalog
from siftline.sources.reader import read_feed
from siftline.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]

_out: dict[str, tuple[Query, str]] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    """Registers a function under its name with its SQL."""

    def put(f: Query) -> Query:
        _out[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _out.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _out.items()}


# --- feeds made of tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(spark: SparkSession, name: str) -> str:
    return f"{fresh_path(spark, 'feed')}-{name}"


def _xml(c: str) -> str:
    """A column as text of an element."""
    return f"replace(replace(cast({c} as string), '&', '&amp;'), '<', '&lt;')"


def _customers_xml(spark: SparkSession, sf_dir: str, tag: str = "job", prefix: str = "") -> DataFrame:
    p = prefix
    body = f"""concat('<{p}{tag} id="', c_custkey, '"><{p}title><![CDATA[ ', c_name, ' ]]></{p}title><{p}place><{p}nation code="n', c_nationkey, '">', c_nationkey, '</{p}nation></{p}place><{p}description><p>in ', {_xml('c_mktsegment')}, '<br>x</{p}description><{p}salary>', c_acctbal, '</{p}salary></{p}{tag}>') AS value"""
    return _table(spark, sf_dir, "customer").selectExpr(body)


_CUSTOMERS = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, CAST(c_nationkey AS VARCHAR) AS place_nation, 'n' || c_nationkey AS place_nation_code, {} CAST(c_acctbal AS VARCHAR) AS salary FROM customer".format


@_query(_CUSTOMERS("'in ' || c_mktsegment || chr(10) || 'x' AS description,"))
def ingest_xml_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "customers.xml")
    sinks.write_framed(_customers_xml(spark, sf_dir), path, '<?xml version="1.0"?>\n<source><publisher>p</publisher>\n', "\n", "\n</source>\n")
    d = read_feed(spark, path).df
    return d.withColumn("description", F.regexp_replace(F.btrim("description", F.lit(" \n")), r"[ \n]*\n[ \n]*", "\n"))


@_query(_CUSTOMERS(""))
def ingest_xml_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "customers.xml")
    sinks.write_framed(_customers_xml(spark, sf_dir), path, "<source>\n", "\n", "\n</source>\n")
    return read_feed(spark, path, "fast").df


@_query(_CUSTOMERS(""))
def ingest_xml_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with a namespace, records of an unusual name, and no file name to tell the format."""
    path = _file(spark, "customers")
    sinks.write_framed(_customers_xml(spark, sf_dir, "vacancy", "ns:"), path, "<ns:vacancies>", " ", "</ns:vacancies>")
    return read_feed(spark, path, "extreme").df


@_query("SELECT CAST(page_id AS VARCHAR) AS id, url, html AS source_text FROM pages")
def pages_xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as CDATA of XML records."""
    body = f"""concat('<page id="', page_id, '"><url>', {_xml("url")}, '</url><source_text><![CDATA[', html, ']]></source_text></page>') AS value"""
    path = _file(spark, "pages.xml")
    sinks.write_framed(_table(spark, sf_dir, "pages").selectExpr(body), path, "<pages>\n", "\n", "\n</pages>\n")
    return read_feed(spark, path).df


@_query("SELECT CAST(event_id AS VARCHAR) AS event_id, json_extract_string(props, '$.k') AS props_k, event_type AS tags FROM events")
def events_props_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects, arrays and nulls of JSON lines, some of them broken, as columns."""
    body = """concat('{"event_id":', event_id, ',"props":', props, ',"tags":["', event_type, '"],"none":null,"empty":[]}', if(event_id % 5 = 0, '\n{"broken":', '')) AS value"""
    path = _file(spark, "events.ndjson")
    sinks.write_framed(_table(spark, sf_dir, "events").selectExpr(body), path, "", "\n", "\n")
    return read_feed(spark, path).df


def _orders_json(spark: SparkSession, sf_dir: str, outer: bool = False) -> DataFrame:
    body = "concat('{\"key\":', o_orderkey, ',\"at\":{\"status\":\"', o_orderstatus, '\",\"note\":\"} ] \\\\\" {\"},\"lines\":[{\"n\":', o_custkey, '}],\"description\":\"d\"}')"
    return _table(spark, sf_dir, "orders").selectExpr((f"concat('{{\"order\":', {body}, '}}')" if outer else body) + " AS value")


_ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS \"key\", o_orderstatus AS at_status, '}} ] \" {{' AS at_note, CAST(o_custkey AS VARCHAR) AS lines_0_n {} FROM orders".format


@_query(_ORDERS(", 'd' AS description"))
def ingest_json_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array on one line, within an object, as programs export it."""
    path = _file(spark, "orders.json")
    sinks.write_framed(_orders_json(spark, sf_dir), path, '{"status":"ok","meta":{"n":1},"results":[', ",", '],"total":2,"errors":[{"key":0}]}')
    return read_feed(spark, path).df


@_query(_ORDERS(""))
def ingest_json_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array over many lines of records whose fields lie in a member that is named."""
    path = _file(spark, "orders.json")
    sinks.write_framed(_orders_json(spark, sf_dir, True), path, "[\n ", ",\n ", "\n]\n")
    return read_feed(spark, path, "fast", "order").df


# --- codecs, archives and servers

_NATIONS = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, CAST(n_regionkey AS VARCHAR) AS region FROM nation"


def _nations(spark: SparkSession, sf_dir: str) -> bytes:
    rows = _table(spark, sf_dir, "nation").collect()
    return ("<jobs>" + "".join(f"<job><id>{r['n_nationkey']}</id><title>{r['n_name']}</title><region>{r['n_regionkey']}</region></job>" for r in rows) + "</jobs>").encode()


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    path = _file(spark, name)
    p, fs = hadoop_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    return path


def _lines(spark: SparkSession, sf_dir: str, codec: str) -> str:
    """The events as compressed JSON lines: the one file of a folder."""
    folder = fresh_path(spark, "lines")
    e = _table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    e.coalesce(1).write.option("compression", codec).text(folder)
    p, fs = hadoop_path(spark, folder)
    return next(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))


_LINES = "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events"


@_query(_LINES)
def ingest_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_feed(spark, _lines(spark, sf_dir, "gzip")).df


@_query(_LINES)
def ingest_bzip2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_feed(spark, _lines(spark, sf_dir, "bzip2")).df


@_query(_NATIONS)
def ingest_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest feed of an archive."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "x" * 100_000)
        z.writestr("small.xml", "<jobs><job><id>no</id></job></jobs>")
        z.writestr("feeds/nations.xml", _nations(spark, sf_dir))
    return read_feed(spark, _put(spark, "feeds.zip", data.getvalue())).df


@_query(_NATIONS)
def ingest_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first feed of an archive."""
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        for name, body in (("readme.txt", b"x"), ("feeds/nations.xml", _nations(spark, sf_dir)), ("more.xml", b"<jobs><job><id>no</id></job></jobs>")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return read_feed(spark, _put(spark, "feeds.tar.gz", data.getvalue())).df


@_query(_NATIONS)
def ingest_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed from a server."""
    body = _nations(spark, sf_dir)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None: ...

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        return read_feed(spark, f"http://127.0.0.1:{server.server_address[1]}/nations").df
    finally:
        server.shutdown()


_NAMES = "concat('a/feed', page_id, element_at(array('.xml', '.XML.gz', '.tar.gz', '.tgz', '.zip', '.json.bz2', '.ndjson', '.gzip', '.txt'), cast(page_id % 9 + 1 as int)))"
_HEADS = "CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN concat(chr(10), ' {\"a\":1}') WHEN 2 THEN 'plain' ELSE '  [1]' END"


@_query(
    """WITH t AS (SELECT page_id, lower('a/feed' || page_id || (['.xml', '.XML.gz', '.tar.gz', '.tgz', '.zip', '.json.bz2', '.ndjson', '.gzip', '.txt'])[page_id % 9 + 1]) AS low,
  CASE page_id % 4 WHEN 0 THEN 'xml' WHEN 2 THEN 'auto' ELSE 'json' END AS by_content FROM pages),
 u AS (SELECT *, CASE WHEN contains(low, '.xml') THEN 'xml' WHEN contains(low, '.json') OR contains(low, '.ndjson') OR contains(low, '.jsonl') THEN 'json' ELSE 'auto' END AS by_name FROM t)
 SELECT page_id, by_content, by_name, CASE WHEN by_content <> 'auto' THEN by_content WHEN by_name <> 'auto' THEN by_name ELSE 'xml' END AS format,
  CASE WHEN low LIKE '%.tar.gz' OR low LIKE '%.tgz' THEN 'tar' WHEN low LIKE '%.gz' OR low LIKE '%.gzip' THEN 'gzip' WHEN low LIKE '%.bz2' THEN 'bzip2' WHEN low LIKE '%.zip' THEN 'zip' END AS codec FROM u"""
)
def sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by content and by name, which of them counts, and codecs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, names = [x.encode() for x in b.column("head").to_pylist()], b.column("name").to_pylist()
            found = [[sniff.format_of_bytes(h) for h in heads], [sniff.format_of_name(n) for n in names], [sniff.sniff_format(h, n) for h, n in zip(heads, names, strict=True)], [sniff.codec_of(n) for n in names]]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(x, pa.string()) for x in found)], names=["page_id", "by_content", "by_name", "format", "codec"])

    d = _table(spark, sf_dir, "pages").select("page_id", F.expr(_NAMES).alias("name"), F.expr(_HEADS).alias("head"))
    return d.mapInArrow(run, "page_id long, by_content string, by_name string, format string, codec string")


@_query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'col_' || p_size || '_' ELSE '' END || regexp_replace(lower(p_name || '-' || p_brand || '.x'), '[^a-z0-9_]', '_', 'g') AS name FROM part")
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sanitize(x) for x in b.column(1).to_pylist()], pa.string())], names=["p_partkey", "name"])

    name = "concat(if(p_size % 3 = 0, concat(p_size, ' '), ''), p_name, '-', p_brand, '.x')"
    return _table(spark, sf_dir, "part").selectExpr("p_partkey", f"{name} AS name").mapInArrow(run, "p_partkey long, name string")


@_query("SELECT p_partkey, p_name || '|x' || p_brand || ' y' AS words FROM part")
def search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and quoted phrases of searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["|".join(search_words(x)) for x in b.column(1).to_pylist()], pa.string())], names=["p_partkey", "words"])

    text = """concat(' "', p_name, '"  x"', p_brand, ' y" ""')"""
    return _table(spark, sf_dir, "part").selectExpr("p_partkey", f"{text} AS text").mapInArrow(run, "p_partkey long, words string")


_BIG = "n_chars * n_chars * n_chars % 5000000000"


@_query(f"SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.0f KB', n / 1024.0) ELSE n || ' B' END AS size FROM (SELECT doc_id, {_BIG} AS n FROM documents)")
def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", size_label(F.expr(_BIG)).alias("size"))


@_query("SELECT text AS key, COUNT(*) AS count FROM documents WHERE TRIM(text) <> '' GROUP BY text HAVING COUNT(*) > 1 ORDER BY count DESC, key LIMIT 30")
def duplicates_doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "documents").duplicates("text")


# --- filters that find their column, presets, pages

_CUSTOMER_TEXT = "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, CAST(c_nationkey AS VARCHAR) c_nationkey, CAST(c_acctbal AS VARCHAR) c_acctbal, c_mktsegment FROM customer"


@_query(f"{_CUSTOMER_TEXT} WHERE TRY_CAST(REGEXP_REPLACE(CAST(c_acctbal AS VARCHAR), '[^0-9.]', '', 'g') AS DOUBLE) > 5000")
def filter_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "customer").filter("acctbal:>5k").df


@_query(f"{_CUSTOMER_TEXT} WHERE c_name ILIKE '%#00000001%' AND c_mktsegment ILIKE '%build%'")
def filter_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "customer").filter("employer:#00000001 C.MktSegment:BUILD").df


@_query(f"SELECT event_id FROM {EVENTS} WHERE event_type IS NULL OR TRIM(event_type) = ''")
def preset_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_events(spark, sf_dir).missing("event_type").df.select("event_id")


@_query(f"SELECT event_id FROM {EVENTS} WHERE event_type IS NOT NULL AND TRIM(event_type) <> ''")
def preset_populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_events(spark, sf_dir).populated("event_type").df.select("event_id")


@_query(f"SELECT 1::BIGINT AS page, 250::BIGINT AS page_size, COUNT(*) AS total_records, GREATEST(1, CEIL(COUNT(*) / 250.0))::BIGINT AS total_pages, 6::BIGINT AS columns FROM {EVENTS} WHERE event_type ILIKE '%click%'")
def page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sparse_events(spark, sf_dir).page(0, 250, text="event_type:click")
    return spark.range(1).select(*(F.lit(v).cast("long").alias(n) for n, v in (("page", p.page), ("page_size", p.page_size), ("total_records", p.total_records), ("total_pages", p.total_pages), ("columns", len(p.columns)))))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer ORDER BY c_name DESC NULLS LAST, CAST(c_custkey AS VARCHAR) LIMIT 100 OFFSET 100")
def page_of_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 100, found behind the last row of the first."""
    d = feed(spark, sf_dir, "customer").df
    first = analytics.page(d, 1, 100, "c_name", True).collect()
    return analytics.page_after(d, tuple(first[-1]), 100, "c_name", True).select("c_custkey", "c_name")


# --- profiles and their views

_PROFILE = ("column_name", "original_name", "total_records", "non_null_count", "empty_count", "valid_count", "fill_rate", "unique_count", "min_length", "max_length", "avg_length", "inferred_type", "is_candidate_key")


def _profiled(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = sparse_events(spark, sf_dir) if table == "events" else feed(spark, sf_dir, table)
        f = FeedFrame(f.df.select(*(c for c, _ in COLUMNS[table])), f.names)
        return f.profile()

    return run


def _shown(profile: DataFrame) -> DataFrame:
    return profile.select(*_PROFILE, F.array_join("sample_values", "|").alias("samples"))


def _sql(table: str) -> str:
    return f"({profile_sql(EVENTS if table == 'events' else table, COLUMNS[table], True)})"


_SHOWN = ", ".join(_PROFILE) + ", array_to_string(sample_values, '|') AS samples"
for _t in COLUMNS:
    _out[f"profile_{_t}"] = (lambda spark, sf_dir, t=_t: _shown(_profiled(t)(spark, sf_dir)), f"SELECT {_SHOWN} FROM {_sql(_t)}")


def _view(table: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a view of a table's profile; {} in the SQL is the profile, with `place` its column's place."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Query:
        run: Query = lambda spark, sf_dir: f(_profiled(table)(spark, sf_dir))
        _out[f.__name__] = (run, sql.format(_sql(table)))
        return run

    return put


def _numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """A small ordered frame with the number of each row."""
    got = [tuple(r[c] for c in columns) for r in rows.collect()]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(got, 1)], ", ".join(["number long", *(f"{c} {kinds[c]}" for c in columns)]))


@_view("events", "SELECT row_number() OVER (ORDER BY fill_rate DESC, place) AS number, column_name FROM {}")
def profile_order(p: DataFrame) -> DataFrame:
    return _numbered(p, "column_name")


@_view("part", "SELECT row_number() OVER (ORDER BY unique_count DESC, column_name) AS number, column_name, unique_count FROM {}")
def profile_by_uniques(p: DataFrame) -> DataFrame:
    return _numbered(health.sort_profile(p, "uniques"), "column_name", "unique_count")


@_view("part", "SELECT row_number() OVER (ORDER BY avg_length, column_name) AS number, column_name, avg_length FROM {}")
def profile_by_length(p: DataFrame) -> DataFrame:
    return _numbered(health.sort_profile(p, "length", False), "column_name", "avg_length")


@_view("events", "SELECT column_name, CASE WHEN fill_rate >= 99.9 THEN 'complete' WHEN fill_rate >= 10 THEN 'warning' ELSE 'critical' END AS tier, (fill_rate >= 10)::INT + (fill_rate >= 50)::INT + (fill_rate >= 90)::INT AS band FROM {}")
def profile_tiers(p: DataFrame) -> DataFrame:
    return p.select("column_name", health.tier(F.col("fill_rate")).alias("tier"), health.band(F.col("fill_rate")).alias("band"))


@_view("events", "SELECT column_name, fill_rate FROM {} WHERE fill_rate < 99.9 ORDER BY fill_rate, column_name LIMIT 3")
def profile_priorities(p: DataFrame) -> DataFrame:
    return health.priorities(p).select("column_name", "fill_rate")


@_view("customer", "SELECT column_name FROM {} WHERE (contains(lower(column_name), 'key') OR contains(lower(inferred_type), 'key')) AND is_candidate_key")
def profile_filtered(p: DataFrame) -> DataFrame:
    return health.filter_profile(p, " KEY ", 50, 100, "complete", True).select("column_name")


@_view("events", "SELECT column_name, CASE WHEN valid_count > 0 THEN unique_count / valid_count * 100 ELSE 0 END AS uniqueness, GREATEST(total_records - valid_count, 0) AS missing FROM {}")
def profile_uniqueness(p: DataFrame) -> DataFrame:
    return health.uniqueness(p).select("column_name", "uniqueness", "missing")


@_view("customer", "SELECT row_number() OVER (ORDER BY fill_rate DESC, place) AS number, column_name FROM {} WHERE unique_count BETWEEN 2 AND 25 AND column_name <> 'c_name' AND NOT contains(column_name, 'id') AND NOT contains(column_name, 'url')")
def suggested_pivots(p: DataFrame) -> DataFrame:
    found = health.suggested_pivots(p, "c_name")
    return p.sparkSession.createDataFrame([*enumerate(found, 1)], "number long, column_name string")


@_view("events", "SELECT COUNT(*) FILTER (fill_rate >= 100) AS complete, COUNT(*) FILTER (fill_rate < 100) AS partial FROM {}")
def profile_split(p: DataFrame) -> DataFrame:
    complete, partial = health.split_complete(p)
    return complete.agg(F.count("*").alias("complete")).crossJoin(partial.agg(F.count("*").alias("partial")))


@_view("events", "SELECT row_number() OVER (ORDER BY column_name <> 'event_type', fill_rate DESC, place) AS number, column_name FROM {}")
def visible_columns(p: DataFrame) -> DataFrame:
    rows = p.collect()
    found = health.visible_columns({r["column_name"]: r["fill_rate"] for r in rows}, [r["column_name"] for r in rows], "missing:event_type")
    return p.sparkSession.createDataFrame([*enumerate(found, 1)], "number long, column_name string")


@_view("customer", "SELECT row_number() OVER (ORDER BY o, i) AS number, word FROM (SELECT 0 AS o, i, 'c_mktsegment:' || v AS word FROM (SELECT unnest(sample_values) AS v, generate_subscripts(sample_values, 1) AS i FROM {} WHERE column_name = 'c_mktsegment') UNION ALL SELECT 1, 1, 'missing:c_mktsegment' UNION ALL SELECT 1, 2, 'populated:c_mktsegment') LIMIT 8")
def completions(p: DataFrame) -> DataFrame:
    found = health.complete_query("c_name:x C_MktSegment:", p.collect())
    return p.sparkSession.createDataFrame([*enumerate(found, 1)], "number long, word string")


@_query("SELECT 1::BIGINT AS number, 'c_name' AS column_name, 'suggested' AS kind UNION ALL SELECT 1, 'c_custkey', 'export' UNION ALL SELECT 1, 'c_name', 'company'")
def company_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = feed(spark, sf_dir, "customer").columns
    rows = [(k, x, kind) for kind, found in (("suggested", health.company_columns(c)), ("export", health.export_columns(c)), ("company", [health.company_column(c)])) for k, x in enumerate(found, 1)]
    return spark.createDataFrame(rows, "number long, column_name string, kind string")


@_query("SELECT p_name AS \"value\", COUNT(*) AS count, CASE WHEN length(p_name) > 20 THEN substr(p_name, 1, 20) || '...' ELSE p_name END AS label FROM part GROUP BY p_name ORDER BY count DESC, p_name LIMIT 15")
def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.chart(feed(spark, sf_dir, "part").distribution("p_name"), 15, 20).select("value", "count", "label")


@_query("SELECT k AS key, v AS \"value\", COUNT(*) AS n FROM (SELECT unnest(['c_name', 'c_mktsegment']) AS k, unnest([c_name, c_mktsegment]) AS v FROM customer) WHERE contains(lower(k), 'build') OR contains(lower(v), 'build') GROUP BY ALL")
def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = feed(spark, sf_dir, "customer").df.select("c_name", "c_mktsegment")
    return health.inspect(d, " Build").groupBy("key", "value").agg(F.count("*").alias("n"))


@_query("SELECT '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\",\"n_regionkey\":\"' || n_regionkey || '\"}' AS record FROM nation")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.record_json(feed(spark, sf_dir, "nation").df)


# --- exports, read back, and the number they give


def _csv(spark: SparkSession, path: str, count: int) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).withColumn("written", F.lit(count).cast("long"))


@_query(f"SELECT event_id, user_id, event_type, value, props, ts, COUNT(*) OVER () AS written FROM {EVENTS} WHERE user_id ILIKE '%7%'")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "csv")
    return _csv(spark, path, sinks.export_records(sparse_events(spark, sf_dir), path, text="user_id:7"))


@_query(f"SELECT event_id, user_id, event_type, CAST(value AS VARCHAR) AS value, ts, COUNT(*) OVER () AS written FROM {EVENTS} WHERE event_type IS NOT NULL AND TRIM(event_type) <> ''")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as one JSON array, read back as a feed."""
    path = _file(spark, "rows.json")
    n = sinks.export_records(sparse_events(spark, sf_dir), path, True, "populated:event_type")
    return read_feed(spark, path).df.select("event_id", "user_id", "event_type", "value", "ts").withColumn("written", F.lit(n).cast("long"))


@_query("SELECT p_brand, CAST(COUNT(*) AS VARCHAR) AS count, (SELECT COUNT(DISTINCT p_brand) FROM part) AS written FROM part GROUP BY p_brand")
def export_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "frequency")
    return _csv(spark, path, sinks.export_frequency(feed(spark, sf_dir, "part"), "p_brand", path)).drop("percentage")


@_query("SELECT c_name, CAST(COUNT(*) AS VARCHAR) AS count, (SELECT COUNT(DISTINCT c_name) FROM customer) AS written FROM customer GROUP BY c_name")
def export_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "companies")
    return _csv(spark, path, sinks.export_companies(feed(spark, sf_dir, "customer"), path)).drop("percentage")


@_query("SELECT o_orderstatus, COUNT(*) FILTER (o_orderpriority LIKE '1%')::VARCHAR AS urgent, COUNT(*)::VARCHAR AS \"Total\", (SELECT COUNT(DISTINCT o_orderstatus) FROM orders) AS written FROM orders GROUP BY o_orderstatus")
def export_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "cross")
    n = sinks.export_cross_tab(feed(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", path)
    d = _csv(spark, path, n)
    return d.select("o_orderstatus", F.col(next(f"`{c}`" for c in d.columns if c.startswith("1"))).alias("urgent"), "Total", "written")


@_query(f"SELECT COALESCE(NULLIF(TRIM(event_type), ''), '[Unspecified / None]') AS event_type, user_id, n::VARCHAR AS job_count, COUNT(*) OVER () AS written FROM (SELECT event_type, user_id, COUNT(*) n FROM {EVENTS} GROUP BY ALL)")
def export_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "pairs")
    return _csv(spark, path, sinks.export_pairs(sparse_events(spark, sf_dir), "event_type", "user_id", path))


@_query("SELECT o_orderstatus, o_orderpriority, COUNT(*) OVER () AS written FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def export_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "custom")
    return _csv(spark, path, sinks.export_custom(feed(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], path, True))


@_query(f"SELECT original_name AS \"Column Name\", inferred_type AS \"Data Type\", printf('%.1f', fill_rate) AS \"Fill Rate (%)\", valid_count::VARCHAR AS \"Valid Count\", empty_count::VARCHAR AS \"Missing Count\", unique_count::VARCHAR AS \"Unique Values\", min_length::VARCHAR AS \"Min Length\", max_length::VARCHAR AS \"Max Length\", CAST(avg_length AS VARCHAR) AS \"Avg Length\", CASE WHEN is_candidate_key THEN 'YES' ELSE 'NO' END AS \"Candidate Key\", COUNT(*) OVER () AS written FROM {_sql('customer')}")
def matrix_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "matrix")
    return _csv(spark, path, sinks.export_profile(_profiled("customer")(spark, sf_dir), path))


# --- catalog and watched ingest


@_query(f"SELECT *, (SELECT COUNT(*) FROM customer) AS total_records, 'f2' AS newest, 2::BIGINT AS entries FROM ({_CUSTOMER_TEXT})")
def catalog_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds kept, listed, deleted and loaded again."""
    catalog = Catalog(_file(spark, "catalog"), spark)
    for k, table in enumerate(("nation", "customer", "region")):
        catalog.save(feed(spark, sf_dir, table), f"f{k + 1 if k < 2 else 0}", f"{table}.xml")
    catalog.delete("f0")
    listed = catalog.entries()
    return catalog.load(spark, "f2").df.withColumns({"total_records": F.lit(listed[0].total_records).cast("long"), "newest": F.lit(listed[0].id), "entries": F.lit(len(listed)).cast("long")})


@_query(f"SELECT {_SHOWN}, 'ready' AS status, 100.0::DOUBLE AS percentage, (SELECT COUNT(*) FROM orders) AS ingested FROM ({profile_sql('orders', [('custkey', 'CAST(o_custkey AS VARCHAR)'), ('key', 'CAST(o_orderkey AS VARCHAR)'), ('status', 'o_orderstatus')], True)})")
def ingest_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that is read under watch, kept in a catalog and profiled, with the last report on it."""
    o = _table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))).alias("value"))
    path = _file(spark, "orders.ndjson")
    sinks.write_framed(o, path, "", "\n", "\n")
    done = ingest(spark, path, catalog=Catalog(_file(spark, "catalog"), spark))
    return _shown(done.profile).withColumns({"status": F.lit(done.progress.status), "percentage": F.lit(done.progress.percentage), "ingested": F.lit(done.entry.total_records).cast("long")})
