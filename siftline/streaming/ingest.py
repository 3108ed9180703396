"""Ingesting: one feed, watched, kept and profiled; and feeds that keep arriving, by Structured Streaming over a folder."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from siftline.functions.text import format_size
from siftline.operators.feed import FeedFrame
from siftline.sources.catalog import Catalog, Entry
from siftline.sources.reader import MODES, ndjson_fields, read_feed, xml_fields
from siftline.sources.streams import size_of

#: Seconds between two reports of an ingest.
INTERVAL = 0.15


@dataclass(frozen=True)
class Progress:
    bytes_read: int
    total_bytes: int
    records_ingested: int
    percentage: float
    mb_per_sec: float
    records_per_sec: float
    elapsed_secs: float
    estimated_remaining_secs: float | None
    status: str
    current_phase: str
    error_message: str | None = None


class Tracker:
    """Counts and rates of an ingest. Rates begin after 0.05 s, the time left needs 0.01 MB/s at least."""

    def __init__(self, total_bytes: int = 0):
        self.total, self.bytes, self.records, self.began, self.cancelled = total_bytes, 0, 0, time.monotonic(), False

    def add(self, n_bytes: int = 0, n_records: int = 0) -> None:
        self.bytes += n_bytes
        self.records += n_records

    def cancel(self) -> None:
        self.cancelled = True

    def snapshot(self, status: str = "ingesting", phase: str = "", error: str | None = None) -> Progress:
        spent = time.monotonic() - self.began
        mb = self.bytes / (1 << 20) / spent if spent > 0.05 else 0.0
        rate = self.records / spent if spent > 0.05 else 0.0
        done = min(100.0, self.bytes / self.total * 100) if self.total else 0.0
        left = (self.total - self.bytes) / (1 << 20) / mb if self.total > self.bytes and mb > 0.01 else None
        return Progress(self.bytes, self.total, self.records, done, mb, rate, spent, left, "cancelled" if self.cancelled else status, phase, error)


class Watch:
    """Reports an ingest's progress while its jobs run, and how it ended: ready, cancelled or error.

    The bytes read are the feed's, in the proportion of its scans' tasks that have ended.
    """

    def __init__(self, spark: SparkSession, tracker: Tracker, tell: Callable[[Progress], None] | None = None, group: str | None = None, interval: float = INTERVAL):
        self.spark, self.tracker, self.tell = spark, tracker, tell or (lambda _: None)
        self.group, self.interval, self.phase = group or f"ingest-{uuid.uuid4().hex}", interval, "reading"
        self._over = threading.Event()

    def _measure(self) -> None:
        status = self.spark.sparkContext.statusTracker()
        done = whole = 0
        for job in status.getJobIdsForGroup(self.group):
            info = status.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if (s := status.getStageInfo(stage)) is not None:
                    done, whole = done + s.numCompletedTasks, whole + s.numTasks
        if whole and not self.tracker.cancelled:
            self.tracker.bytes = max(self.tracker.bytes, int(self.tracker.total * 0.99 * done / whole))

    def _report(self) -> None:
        while not self._over.wait(self.interval):
            self._measure()
            self.tell(self.tracker.snapshot("ingesting", self.phase))
            if self.tracker.cancelled:
                self.spark.sparkContext.cancelJobGroup(self.group)

    def __enter__(self) -> Watch:
        self.spark.sparkContext.setJobGroup(self.group, self.group, interruptOnCancel=True)
        self._thread = threading.Thread(target=self._report, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self._over.set()
        self._thread.join()
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if error is None and not self.tracker.cancelled:
            self.tracker.bytes = self.tracker.total
        self.tell(self.tracker.snapshot("error" if error is not None else "ready", self.phase, str(error) if error is not None and not self.tracker.cancelled else None))
        return error is not None and self.tracker.cancelled


@dataclass(frozen=True)
class Ingested:
    feed: FeedFrame | None
    profile: DataFrame | None
    entry: Entry | None
    progress: Progress


def ingest(spark: SparkSession, path: str, mode: str = "full", record_tag: str | None = None, catalog: Catalog | None = None, feed_id: str | None = None, tell: Callable[[Progress], None] | None = None, tracker: Tracker | None = None) -> Ingested:
    """Reads a feed, reports on it, keeps its table in a catalog and profiles it. A cancelled one is neither kept nor profiled."""
    remote = path.startswith(("http://", "https://"))
    tracker = tracker or Tracker()
    tracker.total = tracker.total or (0 if remote else size_of(spark, path))
    feed = profile = entry = None
    last: list[Progress] = []

    def told(p: Progress) -> None:
        last[:] = [p]
        if tell:
            tell(p)

    with Watch(spark, tracker, told) as watch:
        found = read_feed(spark, path, mode, record_tag)
        seen = Observation()
        found.df.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
        tracker.add(n_records=seen.get["n"])
        feed = found
        if catalog is not None and not tracker.cancelled:
            watch.phase = "keeping"
            entry = catalog.save(feed, feed_id or uuid.uuid4().hex, path.rsplit("/", 1)[-1], "url" if remote else "file", format_size(tracker.total))
        if not tracker.cancelled:
            watch.phase = "profiling"
            profile = feed.profile()
    return Ingested(feed, profile, entry, last[0])


#: The name under which a stream of records reports the bytes of its lines.
OBSERVED = "feed"


class ProgressListener(StreamingQueryListener):
    """Feeds a tracker from the reports of streaming queries, or of the one that is named: bytes read, and records too if asked."""

    def __init__(self, tracker: Tracker, records: bool = True):
        self.tracker, self.records, self.query = tracker, records, None

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query in (None, str(p.id)):
            seen = p.observedMetrics.get(OBSERVED)
            self.tracker.add(int(seen["bytes"] or 0) if seen is not None else 0, p.numInputRows if self.records else 0)


def stream_fields(spark: SparkSession, folder: str, mode: str = "full", record_tag: str | None = None, xml: bool = False, files_at_once: int | None = None) -> DataFrame:
    """A streaming table of records as maps: NDJSON files, or XML files split at the closing tag, that arrive in a folder."""
    stream = spark.readStream if files_at_once is None else spark.readStream.option("maxFilesPerTrigger", files_at_once)
    end = f"</{record_tag}>" if xml else "\n"
    lines = stream.text(folder, lineSep=end).observe(OBSERVED, F.sum(F.octet_length("value") + len(end.encode())).alias("bytes"))
    return (xml_fields if xml else ndjson_fields)(lines, record_tag, MODES[mode])


def ingest_available(fields: DataFrame, target: str, checkpoint: str, tracker: Tracker | None = None) -> StreamingQuery:
    """Appends what has arrived to a Parquet table, each file exactly once, and ends. What is written when a query is
    stopped, or its tracker cancelled, stays. A tracker gets the bytes and the records of each batch."""
    if tracker is None:
        return fields.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    spark, held = fields.sparkSession, []
    listener = ProgressListener(tracker, records=False)
    spark.streams.addListener(listener)

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        # A batch that is written again replaces itself.
        batch.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        tracker.add(n_records=seen.get["n"])
        if tracker.cancelled:
            threading.Thread(target=lambda: held and held[0].stop(), daemon=True).start()

    held.append(fields.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    listener.query = str(held[0].id)
    return held[0]


def cancellable(spark: SparkSession, group: str, action):
    """Runs an action whose jobs cancel(spark, group) ends."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    return action()


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)
