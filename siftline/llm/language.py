"""Language identification with language-bitmask n-gram filters (operator 6).

Byte 3- and 4-grams of lower-cased words are looked up in a bit-sliced Bloom filter: a table with, at each place, one
bit for each language. The words at a gram's places, and-ed, are the languages whose set may hold it, all at once.
A document's bits are counted by language; the false positives that a language's fill makes likely are taken off; the
language that explains most of the grams wins, and the explained share is the score.

A language's set holds the grams that make up at least MIN_SHARE of its training text, so 1/MIN_SHARE of them at most,
unless they are RATIO times as common in another language. Learning takes about MAX_DOCS documents at most, drawn by a
hash at a rate for each language: the languages get equal parts, and those with fewer documents teach with all of them.

Defined results: null text and text without a letter is `und` with score 0; of languages that explain equally much the
first by code point wins; very long texts are taken piece by piece; a language without grams (its texts are empty, or
all digits) is never predicted; without anything to learn from all is `und`; equal rows get equal rows; an empty table
gives no rows; columns besides the id, the text and, for learning, the language are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import fold, read, spread, trim

GRAMS, HASHES, MIN_SHARE, RATIO, MAX_DOCS, UNKNOWN = (3, 4), 3, 1 / 30_000, 8.0, 20_000, "und"
#: Bytes and texts taken at once, and the least score of a document that the pipeline keeps.
CHUNK, ROWS, MIN_SCORE = 1 << 17, 1024, 0.2

_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _FOLD[_b] = _b if chr(_b).isalpha() else 32


def pieces(texts: Iterable[str | None], size: int | None = None) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Texts as bytes, cut and gathered to about `size` bytes at a time: owners, bytes, and how many places of each are its own.

    A cut text's piece goes on for as many bytes behind its own places as a gram needs, so every gram is in one piece.
    """
    size, over = size or CHUNK, max(GRAMS) - 1
    owners: list[int] = []
    parts: list[bytes] = []
    own: list[int] = []
    held = 0
    for k, t in enumerate(texts):
        whole = b" " + (t or "").lower().encode("utf-8", "replace") + b"    "
        for at in range(0, len(whole), size):
            owners.append(k)
            parts.append(whole[at : at + size + over])
            own.append(min(size, len(whole) - at))
            held += own[-1]
            if held >= size:
                yield owners, parts, own
                owners, parts, own, held = [], [], [], 0
    if owners:
        yield owners, parts, own


def piece_grams(parts: list[bytes], own: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size of gram the key at every byte of all pieces one after the other, 0 where there is none; and the pieces' beginnings."""
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    b = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    mine = np.zeros(len(b) + 1, np.int8)
    np.add.at(mine, starts[:-1], 1)
    np.add.at(mine, starts[:-1] + np.array(own, np.int64), -1)
    # A gram begins a word or lies in one; of two blanks in a row none begins or ends a gram.
    out, key, real = [], np.zeros(len(b), np.uint64), np.cumsum(mine[:-1], dtype=np.int8) > 0
    for n in range(1, max(GRAMS) + 1):
        room = max(len(b) - n + 1, 0)
        key <<= np.uint64(8)
        key[:room] |= b[n - 1 :]
        if n > 1:
            real[:room] &= ~((b[n - 2 : len(b) - 1] == 32) & (b[n - 1 :] == 32))
        if n in GRAMS:
            k = key | np.uint64(n << 40)
            k[~real] = 0
            k[room:] = 0
            out.append(k)
    return out, starts[:-1]


@dataclass(frozen=True)
class LanguageFilter:
    """masks[w, place]: bits of languages 64 w and on; rate: the false positives of a language."""

    languages: tuple[str, ...]
    masks: np.ndarray
    rate: np.ndarray

    @staticmethod
    def build(sets: dict[str, np.ndarray]) -> LanguageFilter:
        languages = tuple(sorted(sets))
        most = max((len(s) for s in sets.values()), default=1)
        places = 1 << max(10, (16 * most - 1).bit_length())
        masks = np.zeros((len(languages) // 64 + 1, places), np.uint64)
        for k, lang in enumerate(languages):
            for at in LanguageFilter.places(sets[lang].astype(np.uint64), places):
                masks[k // 64][at] |= np.uint64(1 << k % 64)
        fill = np.array([np.count_nonzero(masks[k // 64] & np.uint64(1 << k % 64)) / places for k in range(len(languages))])
        return LanguageFilter(languages, masks, fill**HASHES)

    @staticmethod
    def places(keys: np.ndarray, n: int) -> Iterator[np.ndarray]:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        a, b = h >> np.uint64(32), h | np.uint64(1)
        for _ in range(HASHES):
            yield (a & np.uint64(n - 1)).astype(np.int64)
            a += b

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) corrected shares of grams that each language explains, and each text's number of grams."""
        count, found = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for owners, parts, own in pieces(texts):
            by_size, starts = piece_grams(parts, own)
            for keys in by_size:
                real = np.flatnonzero(keys)
                begin = np.searchsorted(real, starts)
                end = np.append(begin[1:], len(real))
                np.add.at(count, owners, end - begin)
                every: list[np.ndarray] = []
                for p in self.places(keys[real], self.masks.shape[1]):
                    every = [got & table[p] for got, table in zip(every, self.masks, strict=True)] if every else [table[p] for table in self.masks]
                total = np.zeros(len(real) + 1, np.int64)
                for w, got in enumerate(every):
                    for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                        np.cumsum(got & np.uint64(1 << k % 64) != 0, out=total[1:])
                        np.add.at(found[:, k], owners, total[end] - total[begin])
        share = found / np.maximum(count, 1)[:, None]
        return np.clip((share - self.rate) / np.maximum(1 - self.rate, 1e-9), 0, 1), count

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores; `und` for null."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        share, _ = self.hits(texts)
        best = share.argmax(axis=1)
        known = [t is not None for t in texts]
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], [float(share[i, k]) if known[i] else 0.0 for i, k in enumerate(best)]


def equal_part(sizes: list[int], total: int) -> float:
    """What a size may be at most so that all, cut to it, add up to the total at most."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left / (len(sizes) - k)
        left -= n
    return float("inf")


class GramCounts:
    """Grams of one language and size, with how often they are; what is new waits until it is worth merging."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.waiting.append((u, n))
        self.held += len(u)
        if self.held > max(len(self.keys), 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip((self.keys, self.n), *self.waiting, strict=True))
        self.keys, at = np.unique(keys, return_inverse=True)
        self.n = np.bincount(at, n, len(self.keys)).astype(np.int64)
        self.waiting, self.held = [], 0


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> LanguageFilter:
    """From (text, lang) of at most about max_docs documents. The driver gets a count and 1/MIN_SHARE grams of a language at most."""
    docs = docs.filter("lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    most = equal_part([*sizes.values()], max_docs)
    if over := {lang: int((1 << 30) * most / n) for lang, n in sizes.items() if n > most}:
        below = F.map_from_arrays(F.lit([*over]), F.lit([*over.values()]).cast("array<long>"))[F.col("lang")]
        docs = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < F.coalesce(below, F.lit(1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], GramCounts] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = b.column(0).take(pa.array(np.flatnonzero(langs == lang)))
                for _, parts, places in pieces(x.as_py() for x in own):
                    for size, keys in zip(GRAMS, piece_grams(parts, places)[0], strict=True):
                        sums.setdefault((lang, size), GramCounts()).add(keys[keys != 0])
        for (lang, size), c in sums.items():
            c.merge()
            columns = [pa.array([lang] * len(c.keys), pa.string()), pa.array([size] * len(c.keys), pa.int32()), pa.array(c.keys.astype(np.int64)), pa.array(c.n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "gram", "n"])
        sums.clear()
        trim()

    counts = spread(docs.select("text", "lang")).mapInArrow(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, ["lang", "size"]).select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    by_gram = shares.filter(F.col("share") >= MIN_SHARE / RATIO).groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("all"))
    kept = by_gram.select("gram", "most", F.explode("all").alias("x")).filter((F.col("x.share") >= MIN_SHARE) & (F.col("x.share") * RATIO >= F.col("most")))
    sets: dict[str, list[int]] = {}
    for r in kept.select("gram", F.col("x.lang").alias("lang")).collect():
        sets.setdefault(r["lang"], []).append(r["gram"])
    return LanguageFilter.build({k: np.array(sorted(v), np.uint64) for k, v in sets.items()})


def predicted(text: Column, model: LanguageFilter) -> Column:
    """A struct: lang_pred and score of a text. Nothing but the text goes to Python."""

    @F.arrow_udf(returnType="lang_pred string, score double")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            lang: list[str] = []
            score: list[float] = []
            for k in range(0, len(b), ROWS):
                got = model.predict(b.slice(k, ROWS).to_pylist())
                lang += got[0]
                score += got[1]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])
        trim()

    # Texts without a letter go in as null: nothing of them is sent.
    return found(F.when(text.rlike(r"\p{L}"), text))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred and score behind their own columns; columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = predicted(F.col(f"`{text}`"), model)
    return docs.select(*(F.col(f"`{c}`") for c in own), found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = learn(docs.filter(~held))
    return predict(spread(docs.select("doc_id", "text", held.alias("held_out"))), model).select("doc_id", "held_out", "lang_pred", "score")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is found and explains enough of them, with all their columns, whatever their names."""
    model = learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    # `und` has score 0, so one condition is enough.
    return spread(docs).filter(predicted(F.col("text"), model)["score"] >= MIN_SCORE)
