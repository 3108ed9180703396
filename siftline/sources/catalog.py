"""The catalog of analysed feeds: a Parquet table each, and one JSON list, on any file system of Spark's."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from siftline.functions.layout import hadoop_path, remove
from siftline.functions.names import ColumnMap
from siftline.operators.feed import FeedFrame

MOST = 30


@dataclass(frozen=True)
class Entry:
    id: str
    filename: str
    source_type: str
    file_size: str
    total_records: int
    column_count: int
    db_path: str
    analyzed_at: str = field(default_factory=lambda: time.strftime("%Y-%m-%d %H:%M:%S"))


class Catalog:
    """Newest first, at most MOST entries, one for each id and path. Tables of entries that fall out go too."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.active()
        self.folder = folder.rstrip("/")
        p, fs = hadoop_path(self.spark, self.folder)
        fs.mkdirs(p)
        self.list_path = f"{self.folder}/feeds.json"

    def entries(self) -> list[Entry]:
        p, fs = hadoop_path(self.spark, self.list_path)
        if not fs.exists(p):
            return []
        source = fs.open(p)
        try:
            return [Entry(**e) for e in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))]
        except (ValueError, TypeError):
            return []
        finally:
            source.close()

    def _store(self, entries: list[Entry]) -> None:
        """The list is replaced at once: a reader sees the old or the new one."""
        jvm = self.spark._jvm
        p, fs = hadoop_path(self.spark, f"{self.list_path}.part")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps([asdict(e) for e in entries], indent=1).encode()))
        out.close()
        target, _ = hadoop_path(self.spark, self.list_path)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(target), how)

    def _drop(self, entries: list[Entry]) -> None:
        """Removes tables, of those that lie in the catalog."""
        for e in entries:
            if e.db_path.startswith(f"{self.folder}/"):
                remove(self.spark, e.db_path)

    def add(self, entry: Entry) -> None:
        others = [e for e in self.entries() if e.id != entry.id and e.db_path != entry.db_path]
        self._store([entry, *others][:MOST])
        self._drop(others[MOST - 1 :])

    def save(self, feed: FeedFrame, feed_id: str, filename: str, source_type: str = "file", file_size: str = "") -> Entry:
        """Writes a feed's table; its columns keep their original names as metadata."""
        path, seen = f"{self.folder}/{feed_id}", Observation()
        feed.df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
        entry = Entry(feed_id, filename, source_type, file_size, seen.get["n"], len(feed.columns), path)
        self.add(entry)
        return entry

    def load(self, spark: SparkSession, feed_id: str) -> FeedFrame:
        entry = next(e for e in self.entries() if e.id == feed_id)
        df = spark.read.parquet(entry.db_path)
        return FeedFrame(df, ColumnMap({f.name: (f.metadata.get("original", f.name),) for f in df.schema.fields}))

    def delete(self, feed_id: str) -> None:
        entries = self.entries()
        self._store([e for e in entries if e.id != feed_id])
        self._drop([e for e in entries if e.id == feed_id])
