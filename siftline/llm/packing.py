"""Hierarchical multi-length packing (operator 7).

A document's ids, with an end id, are cut into pieces. Whole windows of the longest tier are sequences at once; what is
left of a document goes to the shortest tier that holds it. Each tier is packed on its own: an item opens a window of
its tier, and the gap behind it is filled from the shorter tiers, the largest fitting item first, the last one cut to
fit. Every window is then full, so sequences have the length of a tier. What a task still holds at its end is drained
into sequences whose lengths are powers of two, so nothing is padded at all.

Sequences of one tier are dealt to step groups, GROUPS at a time. Groups have equally many sequences (at a task's end one
more or less), and the work of attention in them, the sum of the squares of the pieces' lengths, is balanced: in each
round the costliest sequence left goes to the group that has least so far.

Packing is local to a scan task: no shuffle (but of a small table), memory bounded by a batch of documents and a bounded buffer of pieces,
and a task that is run again on another executor gives the same sequences.

Defined results: null or empty text is the end id alone; a very long text fills windows of its own; a null id stays null;
equally costly sequences go in their order; repeated rows are packed each; an empty table gives no pieces;
other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import read, spread, trim

TIERS, END, STEP_TOKENS, GROUPS, BUFFER = (128, 256, 512, 1024), 0, 8192, 8, 4096
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())])


@cache
def tokenizer(path: str):
    """A function text -> uint32 ids as the tokenizers library gives them for a byte-level BPE file.

    tiktoken runs the same merges over the same vocabulary several times faster. Texts that hold a special token's
    string, and texts on which the fast way breaks off, go to the tokenizers library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @cache  # hardly any text needs it, and it takes some memory
    def slow() -> Tokenizer:
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return np.array(fast.encode_ordinary(text), dtype="<u4")
            except BaseException as e:  # the library's own panics derive from BaseException
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(slow().encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


class Packer:
    """Packs documents given one by one; rows come from `take()`."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, base: int = 0):
        self.tiers, self.top, self.step_tokens = tuple(sorted(tiers)), max(tiers), step_tokens
        self.waiting: dict[int, deque] = {t: deque() for t in self.tiers}
        self.held, self.base, self.sequences, self.groups = 0, base, 0, 0
        self.ready: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.top
        for at in range(0, whole, self.top):
            self.emit([(doc_id, at, ids[at : at + self.top], len(ids))])
        if whole < len(ids):
            self.route((doc_id, whole, ids[whole:], len(ids)))
        if self.held >= BUFFER:
            self.pack(BUFFER // 4)

    def route(self, item: tuple) -> None:
        self.waiting[next(t for t in self.tiers if len(item[2]) <= t)].append(item)
        self.held += 1

    def pick(self, gap: int) -> tuple | None:
        """An item for a gap: the longest tier whose items all fit, else any item of a tier not longer than the gap's, else none."""
        for t in reversed(self.tiers):
            if t <= gap and self.waiting[t]:
                self.held -= 1
                return self.waiting[t].popleft()
        for t in self.tiers:
            if self.waiting[t]:
                self.held -= 1
                return self.waiting[t].popleft()
        return None

    def pack(self, down_to: int) -> None:
        """Fills windows of the long tiers first, as long as more than down_to pieces wait."""
        for t in reversed(self.tiers):
            while self.waiting[t] and self.held > down_to:
                if sum(len(q) for q in self.waiting.values()) * (self.tiers[0] // 2) < t:
                    return
                self.held -= 1
                window, gap = [first := self.waiting[t].popleft()], t - len(first[2])
                while gap:
                    if (item := self.pick(gap)) is None:
                        for x in window:
                            self.route(x)
                        return
                    d, at, ids, n = item
                    if len(ids) > gap:
                        self.route((d, at + gap, ids[gap:], n))
                        ids = ids[:gap]
                    window.append((d, at, ids, n))
                    gap -= len(ids)
                self.emit(window)

    def drain(self) -> None:
        """Packs all that waits; the last rest into sequences of falling powers of two."""
        self.pack(0)
        rest = [x for t in reversed(self.tiers) for x in self.waiting[t]]
        self.waiting, self.held = {t: deque() for t in self.tiers}, 0
        left, window, room = sum(len(x[2]) for x in rest), [], 0
        for d, at, ids, n in rest:
            while len(ids):
                room = room or min(self.top, 1 << (left.bit_length() - 1))
                piece = ids[:room]
                window.append((d, at, piece, n))
                at, ids, room, left = at + len(piece), ids[len(piece) :], room - len(piece), left - len(piece)
                if not room:
                    self.emit(window)
                    window = []
        for total in [t for t in self.ready if t in self.waiting]:
            self.deal(total, self.ready.pop(total))
        # Of the last lengths, each shorter than a tier, there is one sequence each: they are one group.
        for windows in self.ready.values():
            self.number(windows, self.groups)
        self.groups += bool(self.ready)
        self.ready = {}

    def emit(self, window: list[tuple]) -> None:
        """A full sequence, which waits for others of its length to be dealt to step groups."""
        total = sum(len(x[2]) for x in window)
        ready = self.ready.setdefault(total, [])
        ready.append(window)
        if total in self.waiting and len(ready) >= GROUPS * max(1, self.step_tokens // total):
            self.deal(total, self.ready.pop(total))

    def deal(self, total: int, windows: list[list[tuple]]) -> None:
        n = -(-len(windows) // max(1, self.step_tokens // total))
        cost = [sum(len(x[2]) ** 2 for x in w) for w in windows]
        order = sorted(range(len(windows)), key=lambda k: -cost[k])
        load, groups = [0] * n, [[] for _ in range(n)]
        for at in range(0, len(order), n):
            for k, g in zip(order[at : at + n], sorted(range(n), key=load.__getitem__), strict=False):
                load[g] += cost[k]
                groups[g].append(windows[k])
        for g in groups:
            self.number(g, self.groups)
            self.groups += 1

    def number(self, windows: list[list[tuple]], group: int) -> None:
        for window in windows:
            total, offset, sequence = sum(len(x[2]) for x in window), 0, self.base + self.sequences
            for d, at, ids, n in window:
                self.rows.append((d, at, len(ids), n, sequence, offset, total, self.base + group, ids.tobytes()))
                offset += len(ids)
            self.sequences += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, end: int = END) -> DataFrame:
    """(doc_id, text) -> a row per piece: where it lies in its document and its sequence, its step group, and its ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(tokenizer_path), Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32)
        stop = np.array([end], dtype="<u4")

        def out() -> Iterator[pa.RecordBatch]:
            rows = packer.take()
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 4096], strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), stop]))
                if len(packer.rows) >= 4096:
                    yield from out()
        packer.drain()
        yield from out()
        del packer
        trim()

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    p = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
