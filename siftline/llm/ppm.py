"""Language-model scoring by prediction by partial matching over bytes (operator 4).

The model is a trie of byte contexts up to ORDER bytes long. A symbol is predicted in the longest context that was
seen; if it never followed there, an escape is paid (half a count for each distinct symbol, method D) and the next
shorter context is asked, with the symbols of the longer one excluded. A text's code length is the sum over its bytes, A-Z
lower-cased, and an end symbol. `Adaptive` learns within one text; `score` uses a trie that is trained on the corpus.

The corpus's trie grows with the corpus and is never in one place. Blocks of documents send their distinct grams
(context and symbol) and words with training counts; counts are summed by gram; the trie is evaluated where grams with
the same last three context bytes meet, sorted by these and taken some contexts at a time, with the counts of orders 0
to 2, of which there are 2^24 at most, given to every task; each gram's log-probability goes back to the blocks that
asked for it, and a block scores its documents by table look-up.
The unigram base score comes from the words' counts in the same way.

Grams are exact; words are told apart by 64-bit hashes.

Defined results: null text is empty, its one token is the end; a very long text is a block's with others; without training documents all counts are zero and
every byte costs log10(256); repeated rows are scored each and counted each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import blocks_of, fold, partitions, read, trim, written
from siftline.llm.jaccard import _LOW, word_hashes

#: Bytes of context; symbols that no text has (not in UTF-8): what stands before a text, and its end; bytes of a block and of a step.
ORDER, BEFORE, END, SYMBOLS, BLOCK_BYTES, STEP = 5, 0xFE, 0xFF, 256, 20 << 20, 1 << 19
#: Keys that wait to be merged with a block's others; grams that are evaluated together, if their contexts allow.
MERGE, TOGETHER = 1 << 18, 1 << 18
#: Words' hashes are marked as keys below zero; grams are not.
MARK = np.int64(-1 << 63)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), *((c, pa.float64()) for c in ("base_score", "score", "base_per_token", "score_per_token", "bits_per_byte"))])


class Adaptive:
    """The same model learning as it reads: code lengths of one text, from nothing or from a trained start."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def probability(self, context: bytes, symbol: int) -> float:
        p, excluded = 1.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                continue
            fresh = {s: c for s, c in seen.items() if s not in excluded}
            if not fresh:
                continue
            total = 2 * sum(fresh.values())
            if symbol in fresh:
                return p * (2 * fresh[symbol] - 1) / total
            p *= len(fresh) / total
            excluded |= fresh.keys()
        return p / (SYMBOLS - len(excluded))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(context)) + 1):
            seen = self.counts.setdefault(context[len(context) - k :], {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def log10(self, text: str, learning: bool = True) -> float:
        data = bytes([BEFORE]) * self.order + _LOW[np.frombuffer(text.encode(), np.uint8)].tobytes() + bytes([END])
        total = 0.0
        for i in range(self.order, len(data)):
            context = data[i - self.order : i]
            total += float(np.log10(self.probability(context, data[i])))
            if learning:
                self.learn(context, data[i])
        return total


def grams_of(data: np.ndarray) -> np.ndarray:
    """For each byte behind the first ORDER ones the gram that ends with it, as a number, the context's farthest byte highest."""
    out = np.zeros(len(data) - ORDER, np.int64)
    for k in range(ORDER + 1):
        out = (out << 8) | data[k : len(data) - ORDER + k]
    return out


def _texts(t: pa.Table) -> list[memoryview]:
    """The texts where they lie, none copied."""
    return [memoryview(x.as_buffer()) if x.is_valid else memoryview(b"") for x in t.column("text")]


def _steps(texts: list[memoryview]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t) + ORDER + 1
        if size >= STEP:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _joined(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """Texts, each with its beginning and end symbols, as one; and where each begins."""
    before, end = bytes([BEFORE]) * ORDER, bytes([END])
    data = b"".join(x for t in texts for x in (before, t, end))
    starts = np.concatenate([[0], np.cumsum([len(t) + ORDER + 1 for t in texts])])
    return _LOW[np.frombuffer(data, np.uint8)], starts


def _real(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n grams end within a text: those that end on a mark before a text do not."""
    real = np.ones(n, bool)
    for s in starts[1:-1]:
        real[s - ORDER : s] = False
    return real


def _keys(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of some texts and the text of each; words and the text of each."""
    data, starts = _joined(texts)
    g = grams_of(data)
    real = _real(starts, len(g))
    # Marks are no blanks: they end words, so they become blanks for the words.
    plain = np.where((data == BEFORE) | (data == END), np.uint8(32), data)
    w, at = word_hashes(plain)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts) - ORDER)
    return g[real], owner, w.view(np.int64) | MARK, np.searchsorted(starts, at, side="right") - 1


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts; the parts are used up."""
    k, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    parts.clear()
    order = np.argsort(k)
    k, c = k[order], c[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first, dtype=np.int64) if len(k) else c.astype(np.int64)


def _ask(t: pa.Table) -> pa.Table:
    """A block's distinct grams and words, with how often its training documents have them."""
    texts, train = _texts(t), np.array(t.column("train").to_pylist(), bool)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in _steps(texts):
        g, go, w, wo = _keys(texts[i:j])
        for key, owner in ((g, go), (w, wo)):
            taught = train[i:j][owner]
            for part, weight in ((key[taught], 1), (key[~taught], 0)):
                u, n = np.unique(part, return_counts=True)
                parts.append((u, n * weight))
        if sum(len(p[0]) for p in parts[1:]) >= max(MERGE, len(parts[0][0]) // 2):
            parts = [_summed(parts)]
    u, n = _summed(parts)
    trim()
    return pa.table([pa.array(np.full(len(u), t.column("block")[0].as_py())), pa.array(u), pa.array(n)], names=["block", "key", "n"])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, where = np.unique(keys, return_inverse=True)
    return u, where


class ShortOrders:
    """Training counts of the orders 0 to 2: of each (byte, byte, symbol) that was seen, and what follows from these."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order].astype(float)
        context, last = self.keys >> 8, self.keys & 0xFFFF
        self.pairs = np.bincount(last, self.n, 1 << 16)
        self.singles = np.bincount(last & 255, self.n, 256)
        two = lambda w: np.bincount(context, w, 1 << 16)
        seen = self.pairs.reshape(256, 256)
        # By order: total and number of the symbols behind each context, and what these symbols count in the next shorter one.
        self.two = two(self.n), two(np.ones(len(self.keys))), two(self.pairs[last])
        self.one = seen.sum(1), (seen > 0).sum(1), (seen > 0) @ self.singles
        self.none = self.singles.sum(), (self.singles > 0).sum()

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0.0)


def evaluate(grams: np.ndarray, counts: np.ndarray, short: ShortOrders) -> np.ndarray:
    """log10 probabilities of grams, given all grams that share their last three context bytes, with training counts
    (zero: only asked for)."""
    seen = []  # by order from the longest: count of the symbol, total and distinct symbols of the context, and what the context's symbols count in the next shorter one
    below = None
    for k in range(ORDER, 2, -1):
        own = grams & ((1 << 8 * (k + 1)) - 1)
        gu, gw = _groups(own)
        c = np.bincount(gw, counts, len(gu))
        ctx, cw = _groups(gu >> 8)
        total, distinct = np.bincount(cw, c, len(ctx)), np.bincount(cw, c > 0, len(ctx))
        if below is not None:
            longer, longer_ctx, longer_c, n, last = below
            place = np.searchsorted(gu, longer & ((1 << 8 * (k + 1)) - 1))
            seen[-1][3] = np.bincount(longer_ctx, np.where(longer_c > 0, c[place], 0), n)[last]
        at = cw[gw]
        below = gu, cw, c, len(ctx), at
        seen.append([c[gw], total[at], distinct[at], None])
    longer, longer_ctx, longer_c, n, last = below
    seen[-1][3] = np.bincount(longer_ctx, np.where(longer_c > 0, short.count(longer & 0xFFFFFF), 0), n)[last]
    two, one, symbol = (grams >> 8) & 0xFFFF, (grams >> 8) & 255, grams & 255
    seen.append([short.count(grams & 0xFFFFFF), *(x[two] for x in short.two)])
    seen.append([short.pairs[grams & 0xFFFF], *(x[one] for x in short.one)])
    seen.append([short.singles[symbol], *(np.full(len(grams), float(x)) for x in short.none), None])
    out, done, begun = np.zeros(len(grams)), np.zeros(len(grams), bool), np.zeros(len(grams), bool)
    excluded_count, excluded_kinds = np.zeros(len(grams)), np.zeros(len(grams))
    for count, total, distinct, next_taken in seen:
        here = ~done & (total > 0)
        fresh, kinds = total - excluded_count, distinct - excluded_kinds
        asked = here & (kinds > 0)
        hit = asked & (count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(hit, out + np.log10((2 * count - 1) / (2 * fresh)), out)
            out = np.where(asked & ~hit, out + np.log10(kinds / (2 * fresh)), out)
        done |= hit
        begun |= here
        if next_taken is not None:
            excluded_count = np.where(begun, next_taken, 0.0)
        excluded_kinds = np.where(begun, distinct, 0.0)
    with np.errstate(divide="ignore"):
        return np.where(done, out, out - np.log10(SYMBOLS - excluded_kinds))


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of keys that are all there. Asked for in order, neighbours find the table in the cache."""
    order = np.argsort(asked)
    out = np.empty(len(asked))
    out[order] = values[np.searchsorted(keys, asked[order])]
    return out


def _score(docs: pa.Table, known: pa.Table, total: int, distinct: int, ends: int) -> pa.Table:
    """A block's documents with their scores, by look-up of its grams' and words' values."""
    keys, values = (known.column(c).to_numpy() for c in ("key", "value"))
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    del order
    base = lambda c: np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    texts, n = _texts(docs), docs.num_rows
    score, unigram, tokens, hits = np.zeros(n), np.zeros(n), np.ones(n, np.int64), np.full(n, int(ends > 0), np.int64)
    for i, j in _steps(texts):
        g, go, w, wo = _keys(texts[i:j])
        score[i:j] = np.bincount(go, _look_up(keys, values, g), j - i)
        c = _look_up(keys, values, w) if len(w) else np.zeros(0)
        unigram[i:j] = np.bincount(wo, base(c), j - i)
        tokens[i:j] += np.bincount(wo, minlength=j - i)
        hits[i:j] += np.bincount(wo, c > 0, j - i).astype(np.int64)
    unigram += base(float(ends))
    symbols = np.array([len(t) + 1 for t in texts], float)
    trim()
    columns = [docs.column("doc_id"), pa.array(~np.array(docs.column("train").to_pylist(), bool)), pa.array(tokens), pa.array(hits), pa.array(np.full(n, total, np.int64)), pa.array(unigram), pa.array(score)]
    columns += [pa.array(x) for x in (unigram / tokens, score / tokens, -score * np.log2(10) / symbols)]
    return pa.table(columns, names=SCHEMA.names)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, text, train boolean) -> a row per row: tokens, known tokens, the unigram base score, the model's score of the
    text, both by token, and the model's bits for each byte and the end, which tells junk of any length."""
    spark = docs.sparkSession
    sums = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count_if("train")).first()
    total, ends = sums[0] or 0, sums[1]
    blocks = blocks_of(spark, total, BLOCK_BYTES)
    placed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "train", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    asked = written(placed.groupBy("block").applyInArrow(_ask, "block long, key long, n long"), "asked")
    n = partitions(spark)
    counts = written(asked.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter("key < 0").select("key", F.col("n").cast("double").alias("value"))
    seen = words.agg(F.sum("value"), F.count_if(F.col("value") > 0)).first()
    all_tokens, kinds = int(seen[0] or 0) + ends, int(seen[1]) + int(ends > 0)
    grams = counts.filter("key >= 0").select("key", "n")
    held = grams.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("short")).agg(F.sum("n").alias("n"), F.count("*").alias("grams")).toArrow()
    taught = held.filter(pc.greater(held.column("n"), 0))
    short = ShortOrders(taught.column("short").to_numpy(), taught.column("n").to_numpy())
    together = TOGETHER
    places = max(n, -(-(pc.sum(held.column("grams")).as_py() or 0) // (4 * together)))

    def trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grams by rising last three context bytes: as many contexts at a time as TOGETHER grams have, one at least."""

        def done(keys: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from pa.table([pa.array(keys), pa.array(evaluate(keys, c, short))], names=["key", "value"]).to_batches(65_536)

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        enough = together
        for b in batches:
            waiting.append((b.column("key").to_numpy(), b.column("n").to_numpy()))
            if sum(len(k) for k, _ in waiting) >= enough:
                keys, c = (np.concatenate(x) for x in zip(*waiting, strict=True))
                context = (keys >> 8) & 0xFFFFFF
                end = int(np.searchsorted(context, context[-1]))  # the last context may go on
                if end:
                    yield from done(keys[:end], c[:end])
                waiting, enough = [(keys[end:], c[end:])], together + 2 * (len(keys) - end)
        if waiting:
            yield from done(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    context = F.expr("(key >> 8) & 16777215")
    grams = grams.repartition(places, context).sortWithinPartitions(context).mapInArrow(trie, "key long, value double")
    told = asked.select("block", "key").join(grams.unionByName(words), "key").select("block", "key", "value")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, base_per_token double, score_per_token double, bits_per_byte double"
    return placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, k: _score(d, k, all_tokens, kinds, ends) if d.num_rows else SCHEMA.empty_table(), out)


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (fold(F.col("doc_id"), 10) != 0).alias("train")))
