"""URL filters by a sort-merge range join (operator 3).

A rule is a host and the beginning of a path, with a verdict. The canonical key of a host and a path is the host with
its labels reversed, a separator, and the path, so what a rule covers on one host is an interval of keys: its own key
and all that begin with it. A url asks once for each of its host and parent domains that has as many labels as some
rule's host: that is few times, however long the host is. Keys and rules are dealt to
ranges of keys, a rule to each range that its interval meets; each range is swept in order, with a stack of the rules
whose intervals are open. Intervals are nested or apart, so the top of the stack is the longest rule on that host, and
the longest over a url's domains wins; of rules equally long, the one on the longer host, then the blocking one.

The ranges are cut at keys of a bounded sample, together with a hash of the row, so that a url that holds a third of
all rows, or a host of many pages, is spread over several tasks. Rows are sorted by Spark; a sweeping task holds a
batch and the stack.

Defined results: a null url, and one without `://`, has an empty host and path, and no rule; rules that are null in
host or path, or have an empty host, are ignored, of equal rules the blocking one stays; without rules every url gets the default verdict;
a very long url is judged in full; equal rows get equal rows; an empty table gives no rows; columns besides the id and the url are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import partitions, read, written

#: The rules of the query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT, SAMPLE_PER_RANGE = "allow", 64
#: Between labels, and between host and path. Both sort before all characters of hosts.
DOT, SLASH = "\x01", "\x00"
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1))


def keys_of(host: Column, path: Column, depths: list[int]) -> Column:
    """The canonical keys of those of a host and its parent domains that have so many labels, with their path."""
    labels = F.reverse(F.split(host, r"\.", -1))
    own = F.filter(F.lit(depths).cast("array<int>"), lambda k: k <= F.size(labels))
    return F.transform(own, lambda k: F.concat(F.array_join(F.slice(labels, 1, k), DOT), F.lit(SLASH), path))


def key_of(host: str, path: str) -> str:
    return DOT.join(reversed(host.split("."))) + SLASH + path


def sweep(rows: Iterator[tuple[str, tuple | None]]) -> Iterator[tuple | None]:
    """For (key, rule or None) rows by rising key, a rule before the urls of its own key: the innermost rule of each url row."""
    stack: list[tuple[str, tuple]] = []
    for key, rule in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if rule is None:
            yield stack[-1][1] if stack else None
        else:
            stack.append((key, rule))


_ROW = "part int, key string, kind int, salt long, id long, verdict string, rule string, host_length int"


def match(urls: DataFrame, rules: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """urls (id long, host, path), rules (host, path, verdict) -> (id, rule, verdict): a row per id that a rule fits."""
    spark = urls.sparkSession
    n = n_ranges or partitions(spark)
    salt = F.xxhash64("id")
    labels = F.reverse(F.split("host", r"\.", -1))
    ruled = rules.filter("host <> '' and path is not null and verdict is not null").groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("b"))
    depths = sorted(r[0] for r in ruled.select(F.size(labels)).distinct().collect())
    ruled = ruled.select(F.concat(F.array_join(labels, DOT), F.lit(SLASH), "path").alias("key"), F.when(F.col("b"), "block").otherwise("allow").alias("verdict"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"))
    asked = urls.filter("host <> '' or path <> ''").select("id", F.explode(keys_of(F.col("host"), F.col("path"), depths)).alias("key")).withColumn("salt", salt)
    # Cuts of the ranges: a bounded sample of (key, salt), as many for each range whatever the size.
    total = asked.count()
    part = min(1.0, n * SAMPLE_PER_RANGE / max(total, 1))
    drawn = asked.filter(F.pmod(F.xxhash64("key", "salt"), F.lit(1 << 30)) < int(part * (1 << 30))).select("key", "salt").limit(4 * n * SAMPLE_PER_RANGE).collect()
    drawn = sorted((r["key"], r["salt"]) for r in drawn)
    cuts = [drawn[len(drawn) * k // n] for k in range(1, n)] if drawn else []

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = [bisect.bisect_right(cuts, (k, s)) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int32()), *b.columns], names=["part", *b.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule goes to each range that its interval meets."""
        for b in batches:
            rows = [(p, *r.values()) for r in b.to_pylist() for p in range(bisect.bisect_right(cuts, (r["key"], -(1 << 63))), bisect.bisect_right(cuts, (r["key"] + LAST, 1 << 62)) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows, strict=True)] or [()] * 5, [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()], strict=True)], names=["part", *b.schema.names])

    left = asked.select("key", "salt", "id").mapInArrow(dealt, "part int, key string, salt long, id long").withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string"), "rule": F.lit(None).cast("string"), "host_length": F.lit(None).cast("int")})
    right = ruled.select("key", "verdict", "rule", "host_length").mapInArrow(spread, "part int, key string, verdict string, rule string, host_length int").withColumns({"kind": F.lit(0), "salt": F.lit(0).cast("long"), "id": F.lit(None).cast("long")})

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []

        def rows() -> Iterator[tuple[str, tuple | None]]:
            for b in batches:
                for p, key, kind, i, *rule in zip(*(b.column(c).to_pylist() for c in ("part", "key", "kind", "id", "verdict", "rule", "host_length")), strict=True):
                    if kind:
                        ids.append(i)
                    yield f"{p}|{key}", tuple(rule) if not kind else None

        found: list[tuple] = []
        schema = pa.schema([("id", pa.int64()), ("verdict", pa.string()), ("rule", pa.string()), ("host_length", pa.int32())])
        for rule in sweep(rows()):
            i = ids.pop()
            if rule is not None:
                found.append((i, *rule))
            if len(found) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                found = []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*found, strict=True)] or [()] * 4, schema, strict=True)], schema=schema)

    names = [c.split()[0] for c in _ROW.split(", ")]
    joined = left.select(*names).unionByName(right.select(*names)).repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", "kind").mapInArrow(swept, "id long, verdict string, rule string, host_length int")
    best = F.struct(F.length("rule").alias("n"), F.col("host_length").alias("h"), (F.col("verdict") == "block").alias("b"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    return joined.groupBy("id").agg(F.max(best).alias("best")).select("id", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages (page_id, url) -> a row per row: page_id, host, path, rule (null if none fits) and verdict."""
    rows = written(pages.select("page_id", F.monotonically_increasing_id().alias("_row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    m = match(rows.select(F.col("_row").alias("id"), "host", "path"), rules).withColumnRenamed("id", "_row")
    return rows.join(m, "_row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules given in code as a table."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), rules_frame(spark))


def oracle() -> str:
    cases = [f"('{h}', '{p}', '{v}')" for h, p, v in RULES]
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {", ".join(cases)}),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
hits AS (
  SELECT r, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(rv, '{DEFAULT}') AS verdict FROM parts LEFT JOIN hits USING (r)
"""
