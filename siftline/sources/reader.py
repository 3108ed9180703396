"""read_feed(): any supported feed as a table of text columns."""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.names import ColumnMap
from siftline.operators.feed import FeedFrame
from siftline.sources import objects, sniff, streams
from siftline.sources.markup import records
from siftline.sources.streams import FeedError

#: extreme and fast leave descriptions out, full keeps them.
MODES = {"extreme": True, "fast": True, "full": False}
#: Columns that a feed may have at most: more are keys that are data, which make no table.
MAX_COLUMNS = 10_000
_FIELDS = "fields map<string,string>"


def _head(spark: SparkSession, path: str, codec: str | None, size: int) -> bytes:
    """The first decompressed bytes."""
    data = streams.head(spark, path, size)
    if codec == "gzip" or data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31).decompress(data, size)
    return bz2.BZ2Decompressor().decompress(data, size) if codec == "bzip2" else data


def _rows(found: Iterator[dict[str, str]]) -> Iterator[pa.RecordBatch]:
    """Batches of records as maps, a bounded number of rows at a time."""
    kind, rows = pa.map_(pa.string(), pa.string()), []
    for fields in found:
        rows.append([*fields.items()])
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind)], names=["fields"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, kind)], names=["fields"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        yield from (x or "" for x in b.column(0).to_pylist())


def xml_fields(lines: DataFrame, tag: str, skip: bool) -> DataFrame:
    """Records of pieces that end at closing tags; pieces are parsed wherever they lie."""
    return lines.mapInArrow(lambda batches: _rows(f for t in _texts(batches) for f in records(t, tag, skip)), _FIELDS)


def ndjson_fields(lines: DataFrame, tag: str | None, skip: bool) -> DataFrame:
    """Records of lines of whole objects. Malformed ones are passed over."""
    found = lambda t: (f for o in objects.objects([t]) if (f := objects.record_of(o, tag, skip)) is not None)
    return lines.mapInArrow(lambda batches: _rows(f for t in _texts(batches) for f in found(t)), _FIELDS)


def array_fields(pieces: DataFrame, before: int, tag: str | None, skip: bool) -> DataFrame:
    """Records of one array, on one line or many, from its pieces that end at closing braces.

    One task finds where records end, in order, and holds one record at a time; the records are parsed by all.
    """

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        left = before
        for t in _texts(batches):
            t += "}"
            if left >= len(t):
                left -= len(t)
            else:
                yield t[left:]
                left = 0

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0
        for o in objects.objects(text(batches), True):
            held.append(o)
            size += len(o)
            if len(held) >= 2000 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    whole = pieces.coalesce(1).mapInArrow(found, "value string")
    return ndjson_fields(whole.repartition(pieces.sparkSession.sparkContext.defaultParallelism), tag, skip)


def closing_tag(head: str, tag: str) -> str:
    """The closing tag as the feed writes it, with its namespace."""
    m = re.search(rf"</((?:[\w.-]+:)?{re.escape(tag)})\s*>", head, re.IGNORECASE)
    return m[0] if m else f"</{tag}>"


def wide(fields: DataFrame, collision: str = "first", keep: bool = True, max_columns: int = MAX_COLUMNS) -> FeedFrame:
    """Records as a table: a column for each key of any record, in the order of the keys, null where a record lacks it.

    The keys come to the driver: they are the columns, and more than max_columns are an error. keep: parsed records stay in
    memory and on disk, until the frame's release(), for the pass that makes the columns; else they are parsed again.
    """
    if keep:
        fields = fields.persist(StorageLevel.MEMORY_AND_DISK)
    keys = sorted(r[0] for r in fields.select(F.explode(F.map_keys("fields")).alias("k")).distinct().limit(max_columns + 1).collect())
    if len(keys) > max_columns:
        fields.unpersist()
        raise FeedError(f"the records have more than {max_columns} different keys")
    names = ColumnMap.of(keys, collision) if keys else ColumnMap({"id": ("id",)})
    cols = [F.coalesce(*(F.try_element_at("fields", F.lit(o)) for o in originals)).alias(c, metadata={"original": originals[0]}) for c, originals in names.originals.items()]
    return FeedFrame(fields.select(*cols), names, fields if keep else None)


def located(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """A path that Spark splits, and its codec: remote feeds and archives are copied to the shared folder first."""
    if path.startswith(("http://", "https://")):
        path = streams.download(spark, path)
    codec = sniff.codec_of(path)
    if codec in ("zip", "tar"):
        return (streams.unzip if codec == "zip" else streams.untar)(spark, path), None
    return path, codec


def record_tag_of(spark: SparkSession, path: str, codec: str | None, head: bytes) -> str:
    """The records' tag by the feed's beginning, by a wider one if that has none, else the usual one."""
    tag = sniff.detect_record_tag(head.decode("utf-8", "replace"))
    if tag is None and len(head) >= sniff.HEAD // 2:
        tag = sniff.detect_record_tag(_head(spark, path, codec, sniff.WIDE_HEAD).decode("utf-8", "replace"))
    return tag or sniff.DEFAULT_TAG


def read_fields(spark: SparkSession, path: str, mode: str = "full", record_tag: str | None = None, split: bool = True) -> DataFrame:
    """The records of a feed as maps of dotted keys to texts, before they become columns.

    split=False reads XML in one task, for feeds that quote their record's closing tag within CDATA.
    """
    skip = MODES[mode]
    path, codec = located(spark, path)
    head = _head(spark, path, codec, sniff.HEAD)
    if sniff.sniff_format(head, path) == "xml":
        tag = record_tag or record_tag_of(spark, path, codec, head)
        if not split:
            return xml_fields(spark.read.text(path, wholetext=True), tag, skip)
        lines = spark.read.text(path, lineSep=closing_tag(head.decode("utf-8", "replace"), tag))
        return xml_fields(lines, tag, skip)
    before = sniff.record_array(head.decode("utf-8-sig", "replace"), record_tag)
    if before is None:
        return ndjson_fields(spark.read.text(path), record_tag, skip)
    return array_fields(spark.read.text(path, lineSep="}"), before, record_tag, skip)


def read_feed(spark: SparkSession, path: str, mode: str = "full", record_tag: str | None = None, collision: str = "first", split: bool = True, keep: bool = True, max_columns: int = MAX_COLUMNS) -> FeedFrame:
    """A feed, XML or JSON, perhaps compressed, local, remote or on any file system of Spark's, as a table of text columns."""
    return wide(read_fields(spark, path, mode, record_tag or None, split), collision, keep, max_columns)
