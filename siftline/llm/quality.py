"""Quality rules: learned decision lists over native text statistics (operator 1).

Everything on the way of a document is a Spark expression: its statistics, and the ordered conditional expression that
sequential covering emits. Covering learns from `labels`: rules for the rejected class are grown on two thirds of a
bounded sample by information gain, one threshold at a time, pruned on the other third, and kept while they hold there.
The driver sees only counts by cell of the binned statistics, at most a row for each row of the sample.

Defined results: null or wordless text has no words, fails the base rules and is not kept; equal rows get equal rows;
labels that are null or contradict each other are ignored; without usable labels the list is empty and the base rules
alone decide; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import read, scoped, spread, words, written

#: Labelled rows to learn from at most (taken by a hash of the id), thresholds of a statistic, conditions of a rule,
#: rules, and what a rule must reach on the rows kept for pruning.
MAX_ROWS, BINS, MAX_CONDITIONS, MAX_RULES, MIN_PRECISION, MIN_COVER = 20_000, 24, 4, 16, 0.9, 3
FEATURES = ("n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows are told apart by 64-bit hashes."""
    last = F.size(w) - 3

    def covered(sorted_: Column) -> Column:
        near = lambda x, k, d: F.coalesce(F.get(sorted_, k + d)["h"] == x["h"], F.lit(False))
        again = F.filter(sorted_, lambda x, k: near(x, k, -1) | near(x, k, 1))
        begin = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n"))
        return F.aggregate(begin, zero, step)["n"]

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), covered))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(last < 1, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def statistics(text: Column) -> Column:
    """A struct of the base counts of a text."""

    def of(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup")))
        return let(
            F.when(F.size(w) > 0, by_line),
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
                F.coalesce(x["n_dup"], F.lit(0)).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.coalesce(x["n_lines"], F.lit(0)).cast("long").alias("n_lines"),
            ),
        )

    return let(words(text), of)


def features(s: Column) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(s[a] / F.when(s[b] > 0, s[b]), F.lit(0.0)).cast("double")
    pairs = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_words", "n_lines"))
    return {"n_words": s["n_words"].cast("double")} | {f: share(*p) for f, p in zip(FEATURES[1:], pairs, strict=True)}


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejected_by(self, values: dict[str, Column]) -> Column:
        """The number of the first rule that holds, 1 the first; null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed([*enumerate(self.rules, 1)]):
            held = rule[0].expression(values)
            for c in rule[1:]:
                held = held & c.expression(values)
            out = F.when(held, F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules)


def _covers(rule: list[tuple[int, bool, int]], bins: tuple[int, ...]) -> bool:
    return all((bins[f] > t) == above for f, above, t in rule)


def _counts(rule: list, cells: list) -> tuple[int, int]:
    hit = [(bad, good) for bins, bad, good in cells if _covers(rule, bins)]
    return sum(x[0] for x in hit), sum(x[1] for x in hit)


def _grow(cells: list, n_bins: list[int], most: int) -> list[tuple[int, bool, int]]:
    """Adds the threshold of the highest information gain until no good row is covered. Ties: the first statistic and threshold."""
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < most:
        p0, n0 = sum(c[1] for c in cells), sum(c[2] for c in cells)
        if not p0 or not n0:
            break
        best, gain0 = None, math.log2(p0 / (p0 + n0))
        for f, size in enumerate(n_bins):
            by = [[0, 0] for _ in range(size + 1)]
            for bins, bad, good in cells:
                by[bins[f]][0] += bad
                by[bins[f]][1] += good
            p = n = 0
            for t in range(size):
                p, n = p + by[t][0], n + by[t][1]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a and a + b < p0 + n0 and (best is None or a * (math.log2(a / (a + b)) - gain0) > best[0] + 1e-9):
                        best = a * (math.log2(a / (a + b)) - gain0), (f, above, t)
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        cells = [c for c in cells if _covers([best[1]], c[0])]
    return rule


def _prune(rule: list, cells: list) -> list:
    """The beginning of the rule that separates best on the rows kept for pruning; the shortest of equals."""
    worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_counts(r, cells))
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])


def cover(grow: list, prune: list, n_bins: list[int], most: int = MAX_CONDITIONS) -> list[list[tuple[int, bool, int]]]:
    """Sequential covering. Cells are (bins, bad, good)."""
    rules: list[list] = []
    while len(rules) < MAX_RULES and any(c[1] for c in grow):
        rule = _prune(_grow(grow, n_bins, most), prune)
        bad, good = _counts(rule, prune) if rule else (0, 0)
        if bad < MIN_COVER or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(rule)
        grow, prune = ([c for c in part if not _covers(rule, c[0])] for part in (grow, prune))
    return rules


@scoped
def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DecisionList:
    """A decision list from labels (doc_id, quality 0 or 1) of documents (doc_id, text) that pass the base rules."""
    y = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z").select("doc_id", "y")
    n = y.count()
    if n > max_rows:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.95 * max_rows / n))
    sample = spread(docs.select("doc_id", "text")).join(F.broadcast(y.limit(max_rows)), "doc_id").select("doc_id", "y", statistics(F.col("text")).alias("s"))
    # The filter stands behind the written table: before it, Spark would push it, with the statistics, below the join.
    sample = written(sample.select("y", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prune"), base_failed(F.col("s")).alias("failed"), *(c.alias(f) for f, c in features(F.col("s")).items())), "labelled").filter("not failed")
    at = [k / BINS for k in range(1, BINS)]
    cuts = sample.agg(*(F.percentile(f, F.array(*map(F.lit, at))).alias(f) for f in FEATURES), *(F.percentile(F.when(F.col("y") == 0, F.col(f)), F.array(*map(F.lit, at))).alias(f"{f}_bad") for f in FEATURES)).first()
    seen = {f: sorted({*(cuts[f] or []), *(cuts[f"{f}_bad"] or [])}) for f in FEATURES}
    thresholds = {f: [(a + b) / 2 for a, b in pairwise(v)] for f, v in seen.items()}  # between what was seen, so with a margin
    binned = sample.select("y", "prune", *(sum((F.when(F.col(f) > t, 1).otherwise(0) for t in thresholds[f]), F.lit(0)).alias(f) for f in FEATURES))
    cells = binned.groupBy("prune", *FEATURES).agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good")).collect()
    parts = {side: sorted((tuple(c[f] for f in FEATURES), c["bad"], c["good"]) for c in cells if c["prune"] is side) for side in (False, True)}
    found = cover(parts[False], parts[True], [len(thresholds[f]) for f in FEATURES])
    return DecisionList(tuple(tuple(Condition(FEATURES[f], above, thresholds[FEATURES[f]][t]) for f, above, t in r) for r in found))


def verdict(text: Column, rules: DecisionList) -> Column:
    """A struct: the base counts, base_failed, rule (the one that rejects) and kept."""

    def decide(s: Column) -> Column:
        rule = rules.rejected_by(features(s))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
        return let(rule, lambda r: F.struct(*(s[c].alias(c) for c in names), base_failed(s).alias("base_failed"), r.alias("rule"), (~base_failed(s) & r.isNull()).alias("kept")))

    return let(statistics(text), decide)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id and the verdict's fields."""
    rules = learn(docs, labels)
    return spread(docs.select("doc_id", "text")).select("doc_id", verdict(F.col("text"), rules).alias("v")).select("doc_id", "v.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base rules nor the learned ones reject, with all their columns."""
    return spread(docs).filter(verdict(F.col("text"), learn(docs, labels))["kept"])
