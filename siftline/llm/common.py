"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.layout import remove, shared_folder, spread

__all__ = ["blocks_of", "drop", "fold", "lower_ascii", "n_words", "partitions", "read", "scope", "scoped", "small_batches", "spread", "trim", "unit", "words", "written"]

#: A word is a run of characters outside ASCII white space. This is also what bytes.split() splits by.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo a number; null ids fall in fold 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


#: Settings that hold while tables are written: Spark's own removal of the files of a write's shuffles when it has ended,
#: and rows that go to Python at once, of which each may be a long text.
CLEANUP, ROWS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
WRITING = {CLEANUP: "true", ROWS: "2000"}


#: Only glibc has it.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_here = threading.local()
_writers = {"lock": threading.Lock(), "number": 0, "before": {}}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """While anyone writes, the settings hold; the last one out puts back what was before."""
    with _writers["lock"]:
        if not _writers["number"]:
            _writers["before"] = {k: spark.conf.get(k, None) for k in WRITING}
            for k, v in WRITING.items():
                spark.conf.set(k, v)
        _writers["number"] += 1
    try:
        yield
    finally:
        with _writers["lock"]:
            _writers["number"] -= 1
            if not _writers["number"]:
                for k, v in _writers["before"].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and survives lost executors. The shuffles that made
    them leave no files behind. A scope deletes its tables at its end, but those that are kept: these are the outer scope's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_here, "scopes", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append((spark, path))
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftline_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on no more rows go to Python at once than while tables are written, as each may be a long text."""
    if not 0 < int(spark.conf.get(ROWS)) <= int(WRITING[ROWS]):
        spark.conf.set(ROWS, WRITING[ROWS])


def trim() -> None:
    """Gives memory that is free back to the system: a Python worker waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


@contextmanager
def scope() -> Iterator[None]:
    """Tables that are written within, and not kept, are deleted at the end. What reads them must be over by then."""
    _here.scopes = [*getattr(_here, "scopes", []), []]
    try:
        yield
    finally:
        *_here.scopes, own = _here.scopes
        for spark, path in own:
            remove(spark, path)


def scoped(f: Callable) -> Callable:
    """A function with a scope: what its result reads it must keep."""

    @wraps(f)
    def run(*args, **named):
        with scope():
            return f(*args, **named)

    return run


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_siftline_path", None):
            remove(t.sparkSession, path)


def blocks_of(spark: SparkSession, total: int, size: int) -> int:
    """Blocks for so many bytes: of a size at most, and of a small table as many as there are cores."""
    return max(1, -(-total // size), min(spark.sparkContext.defaultParallelism, total >> 20))


def unit(*parts: object) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    key = "|".join(map(str, parts)).encode()
    return (zlib.crc32(key) * 0x100000 + (zlib.adler32(key[::-1]) & 0xFFFFF)) / 2**52


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
