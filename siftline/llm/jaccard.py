"""N-gram Jaccard join by rare-first prefix filtering (operator 5).

A document's set is its distinct 5-word shingles, as 64-bit hashes. Equal texts are one representative. A set is put in
a global order, the rarest shingle first: two sets whose Jaccard similarity reaches t must share a shingle among the
first n - ceil(t n) + 1 of either, so only these prefixes are joined. As most shingles of a text occur nowhere else,
and such ones come first, most prefixes hold nothing that another document has, and are never sent.

How often a shingle occurs is counted exactly over all documents: blocks of documents send their distinct shingles,
packed and cut by ranges of hashes; each range returns to each block what occurs in more than one document.

Candidates pass the length and the positional filter in the join on prefix shingles; then, once per pair, the suffix filter
and the exact intersection. A shingle that many near copies share is no square of rows: first each document meets only
the hub of its shingles' groups with which it shares most; documents that this links are one component. Then, of each
shingle's group, the documents outside of its largest component are joined with all others, those of like length, and
pairs of one component are passed over. At its first common shingle a similar pair has enough behind it on both sides,
so only such places count: documents that share a long passage, but not enough of it, are never candidates. A large
group is dealt to many tasks. This loses no link that could join components.

Defined results: null, empty and wordless texts have the empty set and link with nothing; with fewer than five words
the whole sequence is the one shingle; repeated rows and ids share a component; a null id gets the least id
that it reaches, or null; a very long text is one set; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import blocks_of, lower_ascii, read, scoped, trim, written
from siftline.llm.components import components_sql, connected_components

#: Words of a shingle, least similarity in percent, bytes of text in a block and of shingles in a range.
WORDS, PERCENT, BLOCK_BYTES, RANGE_BYTES = 5, 75, 8 << 20, 8 << 20
#: Rounds of hubs; documents of a shingle's group that one task joins with others at most.
HUB_ROUNDS, GROUP = 2, 4096

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A random number for each byte, and the odd base of the polynomial hash of a word with its inverse modulo 2^64.
_MIX = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased bytes, and where they begin."""
    if not len(buffer):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = np.concatenate([[False], ~_BLANK[buffer], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_MIX[buffer] * _powers(_BASE, len(buffer)), out=sums[1:])
    h = (sums[end] - sums[begin]) * _powers(_INVERSE, len(buffer))[begin]
    return _finish(h + (end - begin).astype(np.uint64)), begin


def shingle_sets(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h, _ = word_hashes(_LOW[np.frombuffer(text, np.uint8)])
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _finish(out * np.uint64(_BASE) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def overlap_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Least intersection of sets of n and m that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted integers as differences, byte by byte of their rank, compressed."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_hashes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def suffix_possible(x: np.ndarray, y: np.ndarray, needed: int, depth: int = 3) -> bool:
    """False if splitting both sorted sets at a middle value, again and again, shows that they share fewer than needed."""

    def most(a: np.ndarray, b: np.ndarray, d: int) -> int:
        if not d or not len(a) or not len(b):
            return min(len(a), len(b))
        w = a[len(a) // 2]
        i, j = len(a) // 2, int(np.searchsorted(b, w))
        return most(a[:i], b[:j], d - 1) + most(a[i:], b[j:], d - 1)

    return most(x, y, depth) >= needed


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity: suffix filter, then the exact intersection."""
    needed = overlap_needed(len(x), len(y), percent)
    if min(len(x), len(y)) < needed or not suffix_possible(x, y, needed):
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= needed


def _sets(t: pa.Table, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    for rid, text in zip(t.column("rid").to_pylist(), t.column("text"), strict=True):
        yield rid, shingle_sets(text.as_buffer().to_pybytes() if text.is_valid else b"")


def _offer(t: pa.Table, ranges: int, bits: int) -> pa.Table:
    """A block's distinct shingles, shortened to `bits`, with whether several of its documents have them, by ranges."""
    parts = [s >> np.uint64(64 - bits) for _, s in _sets(t)]
    # Shortened hashes of one set may coincide; they still count once for it.
    parts = [p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p for p in parts]
    h, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    at = np.searchsorted(h, [(k << bits) // ranges for k in range(ranges)] + [1 << bits]) if bits < 64 else np.searchsorted(h, np.array([(k << bits) // ranges for k in range(ranges)], np.uint64)).tolist() + [len(h)]
    block = t.column("block")[0].as_py()
    rows = [(k, block, pack_hashes(h[i:j]), np.minimum(n[i:j], 1 << 31).astype("<u4").tobytes()) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    del parts, h, n
    trim()
    return pa.table([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [()] * 4, types, strict=True)], names=["range", "block", "hashes", "counts"])


def _answer(t: pa.Table) -> pa.Table:
    """For each block of a range those of its shingles that more than one document of the corpus has, and how many."""
    blocks = t.column("block").to_pylist()
    hashes = [unpack_hashes(b) for b in t.column("hashes").to_pylist()]
    counts = [np.frombuffer(b, "<u4") for b in t.column("counts").to_pylist()]
    everything = np.concatenate(hashes)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
    often = total > 1
    h, df = ordered[first][often], total[often]
    rows = []
    for block, own in zip(blocks, hashes, strict=True):
        at = np.searchsorted(h, own)
        hit = (at < len(h)) & (h[np.minimum(at, len(h) - 1)] == own) if len(h) else np.zeros(len(own), bool)
        if hit.any():
            rows.append((block, pack_hashes(own[hit]), np.minimum(df[at[hit]], (1 << 32) - 1).astype("<u4").tobytes()))
    types = [pa.int64(), pa.binary(), pa.binary()]
    del everything, order, ordered, first, total, often, hashes, counts
    trim()
    return pa.table([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [()] * 3, types, strict=True)], names=["block", "hashes", "counts"])


_PREFIX = "rid long, n long, prefix array<struct<h:long,p:int>>, shingles binary"


def _prefixes(docs: pa.Table, known: pa.Table, bits: int, percent: int = PERCENT) -> pa.Table:
    """A row per document: its set's size and, if its prefix holds shingles that others have, these with their places, and the set."""
    h = [unpack_hashes(b) for b in known.column("hashes").to_pylist()]
    c = [np.frombuffer(b, "<u4") for b in known.column("counts").to_pylist()]
    h, c = (np.concatenate(h), np.concatenate(c)) if h else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    rids, sizes, hashes, places, ends, sets = [], [], [h[:0]], [np.zeros(0, np.int32)], [0], []
    for rid, s in _sets(docs):
        short = s >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(h, short), max(len(h) - 1, 0))
        df = np.where(h[at] == short, c[at], 1) if len(h) else np.ones(len(s), np.uint32)
        p = prefix_length(len(s), percent)
        alone = int((df == 1).sum())
        held = 0
        if alone < p:
            shared = np.flatnonzero(df > 1)
            best = shared[np.lexsort((s[shared], df[shared]))][: p - alone]
            held = len(best)
            hashes.append(s[best])
            places.append(np.arange(alone, alone + held, dtype=np.int32))
        rids.append(rid)
        sizes.append(len(s))
        ends.append(ends[-1] + held)
        sets.append(s.tobytes() if held else None)
    tokens = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places))], names=["h", "p"])
    prefixes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)
    return pa.table([pa.array(rids, pa.int64()), pa.array(sizes, pa.int64()), prefixes, pa.array(sets, pa.binary())], names=["rid", "n", "prefix", "shingles"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) once each -> those that are similar."""
    a = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = ([np.frombuffer(v.as_buffer(), "<u8") for v in t.column(c)] for c in ("x", "y"))
            keep = pa.array([similar(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield t.select(["a", "b"]).filter(keep)
        trim()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


@scoped
def similarity_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> a row per row: doc_id, n_shingles, component_id. Links are never expanded between copies."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Equal texts, but for the case of A-Z, by digest; the least id of a text stands for it.
    key = F.coalesce(F.sha1(lower_ascii(F.col("text")).cast("binary")), F.lit(""))
    ids = written(own.select("doc_id", key.alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "ids")
    alike = written(ids.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("bytes").alias("bytes")).withColumn("rid", F.monotonically_increasing_id()), "alike")
    total = alike.agg(F.sum("bytes")).first()[0] or 0
    blocks = blocks_of(spark, total, BLOCK_BYTES)
    bits = min(64, max(24, math.ceil(math.log2(max(total / 6, 2))) + 10))
    ranges = blocks_of(spark, total, RANGE_BYTES)
    block = F.pmod(F.xxhash64("least", "key", F.lit(5)), F.lit(blocks))
    reps = alike.select("rid", "least", block.alias("block"), "key")
    keyed = own.withColumnRenamed("doc_id", "least").withColumn("key", key).withColumn("block", block)

    def of_reps(t: pa.Table, r: pa.Table) -> pa.Table:
        """The texts that stand for others, with their numbers; of repeated rows the first."""
        chosen = {(i, k): n for n, i, k in zip(*(r.column(c).to_pylist() for c in ("rid", "least", "key")), strict=True)}
        rid = pa.array([chosen.pop(x, None) for x in zip(t.column("least").to_pylist(), t.column("key").to_pylist(), strict=True)], pa.int64())
        return t.append_column("rid", rid).filter(rid.is_valid())

    sent = keyed.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(lambda t, r: _offer(of_reps(t, r), ranges, bits) if len(t) and len(r) else _offer_none(), "range int, block long, hashes binary, counts binary")
    answers = written(sent.groupBy("range").applyInArrow(_answer, "block long, hashes binary, counts binary"), "answers")
    none = F.lit(None)
    told = reps.select("block", "rid", "least", "key", none.cast("binary").alias("hashes"), none.cast("binary").alias("counts")).unionByName(answers.select("block", none.cast("long").alias("rid"), none.cast("long").alias("least"), none.cast("string").alias("key"), "hashes", "counts"))

    def prefixes(t: pa.Table, r: pa.Table) -> pa.Table:
        is_rep = r.column("hashes").is_null()
        return _prefixes(of_reps(t, r.filter(is_rep)), r.filter(pc.invert(is_rep)), bits, percent)

    found = written(keyed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(prefixes, _PREFIX), "prefixes")
    sets = found.filter("shingles is not null").select("rid", "shingles")
    tokens = written(found.filter("shingles is not null").select("rid", "n", F.col("prefix")[0]["p"].alias("first"), F.explode("prefix").alias("x")).select("rid", "n", "x.h", "x.p", (1000 * F.col("first") / F.col("n")).cast("int").alias("alone")), "tokens")

    # Hub rounds: each document against the one hub, of another component, with which it shares most of its prefix.
    # The hub of a shingle is its document with the fewest shingles of its own: what near copies were copied from.
    linked = None
    for _ in range(HUB_ROUNDS):
        placed = _placed(tokens, linked)
        best = placed.groupBy("h", "c").agg(F.min(F.struct("alone", "n", "rid", "p")).alias("best"))
        hubs = best.groupBy("h").agg(F.min(F.struct("best", "c")).alias("one"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h", "one")
        other = best.join(hubs, "h").filter("c <> one.c").groupBy("h").agg(F.min(F.struct("best", "c")).alias("two"))
        both = written(hubs.join(other, "h"), "hubs")  # as a table of its own, so that a join with it can be split where a shingle is hot
        hub = F.when(F.col("c") == F.col("one.c"), F.col("two")).otherwise(F.col("one"))["best"]
        near = placed.join(both, "h").select("rid", hub.alias("hub"), "n", "p").select("rid", F.col("hub.rid").alias("hub"), *_bounds(F.col("n"), F.col("hub.n"), F.col("p"), F.col("hub.p"), percent)).filter("possible")
        chosen = near.groupBy("rid", "hub").agg(F.count("*").alias("shared")).groupBy("rid").agg(F.max(F.struct("shared", (-F.col("hub")).alias("m"))).alias("best"))
        pairs = chosen.select(F.least("rid", -F.col("best.m")).alias("a"), F.greatest("rid", -F.col("best.m")).alias("b")).distinct()
        new = written(_verify(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        linked = new if linked is None else linked.unionByName(new)

    pairs = written(candidates(_placed(tokens, linked), percent), "candidates")
    joined = connected_components(linked.unionByName(_verify(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))))

    rep = alike.select("rid", "key").join(found.select("rid", "n"), "rid").join(joined.withColumnRenamed("id", "rid"), "rid", "left").select(F.col("key").alias("k"), "n", F.coalesce("component", "rid").alias("c"))
    rows = written(ids.join(rep, F.col("key") == F.col("k")).select("doc_id", "n", "c"), "rows", keep=True)
    least = written(rows.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least", keep=True)
    return rows.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _placed(tokens: DataFrame, links: DataFrame | None) -> DataFrame:
    """The prefix tokens with the component of their document so far."""
    if links is None:
        return tokens.withColumn("c", F.col("rid"))
    parts = written(connected_components(links), "parts")
    return tokens.join(parts.withColumnRenamed("id", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid")).drop("component")


def candidates(placed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Tokens (h, rid, n, p, c) -> (a, b): all pairs of different components that may be similar, each once.

    Documents of like length meet: those of the classes beside each other. Of a group, what its largest component holds
    does not meet itself; the group is dealt to places of GROUP documents, and those outside of that component go to each.
    """
    by = placed.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "c"))["c"].alias("major"), F.sum("k").alias("total"), F.count("*").alias("parts"))
    by = written(by.filter("parts > 1").select("h", "major", F.ceil(F.col("total") / GROUP).cast("int").alias("places")), "groups")
    # Of sets of which one is similar to the other, the lengths differ by less than a class's width.
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100.5 / percent)).cast("int")
    t = placed.join(by, "h").withColumn("class", size_class)
    beside = F.sequence(F.col("class") - 1, F.col("class") + 1)
    every = F.sequence(F.lit(0), F.col("places") - 1)
    few = t.filter("c <> major").select("h", "rid", "n", "p", "c", "major", F.explode(beside).alias("class"), "places").select("h", "rid", "n", "p", "c", "major", "class", F.explode(every).alias("place"))
    few = few.select("h", "class", "place", "major", *(F.col(x).alias(f"{x}1") for x in ("rid", "n", "p", "c")))
    place = F.pmod(F.xxhash64("rid", F.lit(55)), F.col("places")).cast("int").alias("place")
    most = t.select("h", "class", place, *(F.col(x).alias(f"{x}2") for x in ("rid", "n", "p", "c")))
    room = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    near = (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & ((100 + percent) * room >= percent * (F.col("n1") + F.col("n2")))
    # Two documents outside of the largest component meet twice, in either order.
    once = (F.col("c2") == F.col("major")) | (F.col("rid1") < F.col("rid2"))
    met = few.join(most, ["h", "class", "place"]).filter((F.col("c1") != F.col("c2")) & near & once)
    return met.select(F.least("rid1", "rid2").alias("a"), F.greatest("rid1", "rid2").alias("b")).distinct()


def _bounds(n: object, m: object, p: object, q: object, percent: int) -> list:
    """The positional filter: whether sets that share a token at places p and q may still share enough."""
    needed = F.ceil(percent * (n + m) / (100 + percent))
    return [((100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - p - 1, m - q - 1) + F.least(p, q) >= needed)).alias("possible")]


def _offer_none() -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())], names=["range", "block", "hashes", "counts"])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(read(spark, sf_dir, "documents"))


def oracle() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id AS id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM w),
x AS (SELECT r, len(s) AS n, unnest(s) AS shingle FROM s),
edges AS (SELECT p.r AS a, q.r AS b FROM x p JOIN x q ON p.shingle = q.shingle AND p.r < q.r GROUP BY p.r, q.r, p.n, q.n HAVING 100 * COUNT(*) >= {PERCENT} * (p.n + q.n - COUNT(*))),
{components_sql("s", "edges")}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, least AS component_id FROM s JOIN least USING (r)"""


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least id, with all columns, whatever their names; of repeated rows one."""
    c = similarity_components(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("chosen")).distinct()
    own = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")
    text = F.sha1(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary")).alias("digest")
    d = docs.select(own, F.col("doc_id").alias("id"), text)
    return d.join(c, d["id"].eqNullSafe(c["chosen"])).dropDuplicates(["id", "digest"]).select("row.*")
