"""Streams that Spark cannot split: archives and remote feeds are copied, inside the JVM, to a file in the shared folder.

From there every executor reads and splits them like any file. Nothing is held in memory, and paths may be on any file
system that Spark reads.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from siftline.functions.layout import fresh_path, hadoop_path

#: Names of feeds within archives, the agent a server is told, seconds to connect and to read, and what a
#: server's answers mean.
MEMBERS = (".xml", ".json", ".jsonl", ".ndjson")
AGENT = "Mozilla/5.0 (X11; Linux x86_64) siftline"
CONNECT, READ = 20, 60
ANSWERS = {404: "the feed was not found", 403: "access is forbidden", 401: "authentication is needed"}
#: How often a server may send on; bytes that are copied at once.
HOPS, _BUFFER = 6, 1 << 17


class FeedError(Exception):
    pass


def _is_feed(name: str) -> bool:
    return name.lower().endswith(MEMBERS)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file as it is stored; 0 where that is not known."""
    p, fs = hadoop_path(spark, path)
    return fs.getFileStatus(p).getLen() if fs.exists(p) else 0


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first stored bytes of a file."""
    p, fs = hadoop_path(spark, path)
    raw = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(raw, size)))
    finally:
        raw.close()


def _copy(spark: SparkSession, source, name: str) -> str:
    target = fresh_path(spark, name)
    p, fs = hadoop_path(spark, target)
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, fs.create(p), _BUFFER, True)
    return target


def _open_zip(spark: SparkSession, path: str):
    p, fs = hadoop_path(spark, path)
    return spark._jvm.java.util.zip.ZipInputStream(fs.open(p))


def unzip(spark: SparkSession, path: str) -> str:
    """The largest feed of an archive, else its first member, as a file in the shared folder."""
    consume = spark._jvm.org.apache.commons.io.IOUtils.consume
    found: list[tuple[bool, int, int]] = []
    z = _open_zip(spark, path)
    try:
        while (e := z.getNextEntry()) is not None:
            feed = _is_feed(e.getName())
            # A streamed archive tells a member's size only behind it.
            size = e.getSize() if e.getSize() >= 0 or not feed else consume(z)
            found.append((feed, size if feed else 0, -len(found)))
    finally:
        z.close()
    if not found:
        raise FeedError("the archive is empty")
    chosen = -max(found)[2]
    z = _open_zip(spark, path)
    for _ in range(chosen + 1):
        e = z.getNextEntry()
    return _copy(spark, z, _named(e.getName()))


def untar(spark: SparkSession, path: str) -> str:
    """The first feed of a compressed tar archive, as a file in the shared folder."""
    p, fs = hadoop_path(spark, path)
    unpacked = spark._jvm.java.util.zip.GZIPInputStream(fs.open(p))
    t = spark._jvm.org.apache.commons.compress.archivers.tar.TarArchiveInputStream(unpacked)
    while (e := t.getNextEntry()) is not None:
        if e.isFile() and _is_feed(e.getName()):
            return _copy(spark, t, _named(e.getName()))
    t.close()
    raise FeedError("the archive holds no XML or JSON feed")


def _named(name: str) -> str:
    """A file name that begins with the last part of a name; its end is free, so no codec is seen in it."""
    return re.sub(r"\W", "_", name.rsplit("/", 1)[-1]) or "feed"


def _connected(spark: SparkSession, url: str):
    """An open connection that answers with a body; also where the server sends on to another protocol."""
    for _ in range(HOPS):
        connection = spark._jvm.java.net.URI(url).toURL().openConnection()
        connection.setConnectTimeout(CONNECT * 1000)
        connection.setReadTimeout(READ * 1000)
        connection.setRequestProperty("User-Agent", AGENT)
        connection.setRequestProperty("Accept-Encoding", "gzip")
        code = connection.getResponseCode()
        if code >= 400:
            raise FeedError(f"HTTP {code}: {ANSWERS.get(code, 'the server refused')} ({url})")
        if code < 300 or not (place := connection.getHeaderField("Location")):
            return connection
        url = urljoin(url, place)
    raise FeedError(f"the server sends on and on ({url})")


def download(spark: SparkSession, url: str) -> str:
    """A remote feed as a file in the shared folder, uncompressed if it came gzipped."""
    try:
        body = spark._jvm.java.io.BufferedInputStream(_connected(spark, url).getInputStream(), _BUFFER)
        body.mark(2)
        magic = (body.read(), body.read())
        body.reset()
        name = _named(url.split("?")[0])
        return _copy(spark, spark._jvm.java.util.zip.GZIPInputStream(body) if magic == (0x1F, 0x8B) else body, name)
    except Py4JJavaError as e:
        raise FeedError(f"the server could not be reached ({url}): {e.java_exception.getMessage()}") from e
