"""Mixing sources to target weights by pivotal dependent rounding (operator 9).

Every document of a source starts with the same copy number, its source's target over its source's size. The whole
part is certain. The fractions are rounded dependently: two units move mass, counted in words, from one to the other
at random until one of them is integral, so that the words of the source stay what they were and each document's
expectation too.

A unit can also be a pool of documents that have one fraction: what moves changes that one fraction. The large documents
of a source, at most HEAD, go first, by falling size, each against the pool of all that are smaller. The fraction that
this leaves to the others is where the leaves begin: a leaf takes some documents by falling size, each against the pool
of the leaf's smaller ones, and leaves one fractional unit, nearly always a tiny one. These residuals meet in a reduction
tree, and the last one of a source is drawn with its fraction. So every document's mean number of copies is its ratio,
and a source misses its target by less than one document, hardly ever by one that is large.

Defined results: null text is size 0; a null source is a source of its own, the last one; rows alike in id, source and
size share one decision (their mass is the sum); empty documents take no words; a very long text is one document; an
empty table gives no rows; columns of the input other than the three are neither read nor returned, so their names
cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import n_words, partitions, read, scoped, unit, written

#: Documents in a leaf, residuals under a node of the tree, the seed of the draws, and how many times a document of the
#: size of its source is larger than one that is not large any more: there are at most so many large ones.
LEAF, FAN_IN, SEED, HEAD = 1024, 64, 9, 1024
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0


def pair(f: float, s: float, g: float, t: float, u: float) -> tuple[float, float]:
    """Fractions f, g of units with s, t words, after one random transfer of words that leaves one of them integral."""
    up, down = min((1 - f) * s, g * t), min(f * s, (1 - g) * t)
    if up + down <= 0:
        return f, g
    if u * (up + down) < down:
        f2, g2 = f + up / s, g - up / t
        return (1.0, g2) if up == (1 - f) * s else (f2, 0.0)
    f2, g2 = f - down / s, g + down / t
    return (0.0, g2) if down == f * s else (f2, 1.0)


def leaf(fraction: float, masses: list[float], draw: list[float], others: float = 0.0) -> tuple[list[float], float]:
    """Fractions of units by falling mass that all begin with one fraction, each against the pool of those behind it and
    of others, a mass of units that are not given; and the fraction of these."""
    out, pool, g = [0.0] * len(masses), sum(masses) + others, fraction
    for k, s in enumerate(masses):
        pool -= s
        if pool <= 0.5 or g in (0.0, 1.0):
            out[k] = g
            continue
        out[k], g = pair(g, s, g, pool, draw[k])
        g = min(1.0, max(0.0, g))
        if 0.0 < out[k] < 1.0:  # the pool is integral, this one stays
            out[k + 1 :] = [g] * (len(masses) - k - 1)
            break
    return out, g


def chain(fractions: list[float], masses: list[float], draw: list[float]) -> list[float]:
    """Fractions after each pair of the list in turn, the one left fractional against the next."""
    out, held = list(fractions), 0
    for k in range(1, len(out)):
        out[held], out[k] = pair(out[held], masses[held], out[k], masses[k], draw[k])
        if out[held] in (0.0, 1.0):
            held = k
    return out


def _ordered(t: pa.Table, seed: int) -> tuple[pa.Table, list[float]]:
    """Units by falling mass, of equal ones by their draws and ids; and the draws."""
    source, ids, size, mass = (t.column(c).to_pylist() for c in ("source", "doc_id", "size", "mass"))
    draw = [unit(seed, *r) for r in zip(source, ids, size, strict=True)]
    order = sorted(range(len(draw)), key=lambda k: (-mass[k], draw[k], str(ids[k])))
    return t.take(pa.array(order, pa.int64())), [draw[k] for k in order]


def _with(t: pa.Table, **columns: list[float]) -> pa.Table:
    for name, values in columns.items():
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(values, pa.float64()))
    return t


def _pooled(t: pa.Table, seed: int) -> pa.Table:
    """A group of units of one fraction; `others` is the mass of those it stands before, which get the fraction `rest`."""
    t, draw = _ordered(t, seed)
    out, rest = leaf(t.column("fraction")[0].as_py(), t.column("mass").to_pylist(), draw, t.column("others")[0].as_py())
    return _with(t, fraction=out, rest=[rest] * len(out))


def _node(t: pa.Table, seed: int) -> pa.Table:
    t, draw = _ordered(t, seed + 1)
    return _with(t, fraction=chain(t.column("fraction").to_pylist(), t.column("mass").to_pylist(), draw))


def _last(t: pa.Table, seed: int) -> pa.Table:
    """What is left of a source: a unit, drawn."""
    t, draw = _ordered(t, seed + 2)
    return _with(t, fraction=[float(u < f) for u, f in zip(draw, t.column("fraction").to_pylist(), strict=True)])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size) rows -> a row per source: source_size, units, target, ratio. The excess above the cap is shared anew by weight.

    The sources are ranked by ranges, and the level that the targets have by weight is found by sums: they never meet in one place.
    """
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    by = written(by.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    held = {r["part"]: r["n"] for r in by.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for q, n in held.items() if q < p) for p in range(max(held, default=0) + 1)]
    rank = F.element_at(F.lit(before).cast("array<long>"), F.col("part") + 1) + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))).withColumn("most", cap * F.col("source_size"))
    # A source whose cap lies below the level is at its cap; what it does not take raises the level of the others.
    level, known = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("w")
        s = by.agg(F.count_if(full).alias("n"), F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if s["n"] == known or not s["w"]:
            break
        known, level = s["n"], (share * s["all"] - cap * (s["full"] or 0)) / s["w"]
    target = F.least("most", F.lit(level) * F.col("w")) if s["w"] else F.col("most")
    return by.withColumn("target", target.cast("double")).select("source", "source_size", "units", "target", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("ratio"))


@scoped
def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Rows of documents -> doc_id, source, size, source_size, target, copies: one per row, copies whole."""
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes", keep=True)
    targets = written(source_targets(rows, weights, share, cap), "targets")
    most = targets.agg(F.max("units")).first()[0] or 0
    t = targets.select(F.col("source").alias("s"), "source_size", "units", "target", "ratio")
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    u = units.join(t, units["source"].eqNullSafe(t["s"])).drop("s").withColumn("whole", F.floor("ratio")).withColumn("fraction", F.col("ratio") - F.col("whole")).withColumn("mass", (F.col("size") * F.col("n")).cast("double"))
    u = u.withColumn("large", F.col("mass") * HEAD > F.col("source_size")).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.ceil(F.col("units") / LEAF)))
    u = written(u.select("doc_id", "source", "size", "mass", "block", "fraction", "whole", "source_size", "target", "large"), "units")
    schema = u.drop("large").schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", others double, rest double"
    none = F.lit(0.0)

    # The large documents of a source, a bounded number, against the pool of all others.
    large = u.filter(F.col("large") & (F.col("fraction") > 0)).drop("large")
    whole = large.groupBy("source").agg(F.sum("mass").alias("m")).select(F.col("source").alias("s"), "m")
    large = large.join(whole, large["source"].eqNullSafe(whole["s"])).withColumns({"others": F.col("source_size") - F.col("m"), "rest": none}).drop("s", "m")
    head = written(large.groupBy("source").applyInArrow(lambda t: _pooled(t, seed), schema), "head")
    left = head.groupBy("source").agg(F.first("rest").alias("r")).select(F.col("source").alias("s"), "r")
    small = u.filter(~F.col("large") | (F.col("fraction") == 0)).drop("large").join(left, u["source"].eqNullSafe(left["s"]), "left")
    small = small.withColumns({"fraction": F.when(F.col("fraction") > 0, F.coalesce("r", "fraction")).otherwise(none), "others": none, "rest": none}).drop("s", "r")
    idle = (F.col("mass") == 0) | F.col("fraction").isin(0.0, 1.0)
    leaves = small.filter(~idle).groupBy("source", "block").applyInArrow(lambda t: _pooled(t, seed), schema)
    done = written(leaves.unionByName(small.filter(idle)).unionByName(head), "leaves", keep=True)

    open_ = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    parts, left, blocks = [done.filter(~open_)], done.filter(open_), -(-most // LEAF)
    while True:
        blocks = -(-blocks // FAN_IN)
        level = left.withColumn("block", F.floor(F.col("block") / FAN_IN)).groupBy("source", "block").applyInArrow(lambda t: _node(t, seed), schema)
        parts, left = [*parts, level.filter(~open_)], level.filter(open_)
        if blocks <= 1:
            break
    parts.append(left.groupBy("source").applyInArrow(lambda t: _last(t, seed), schema))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = chosen.select(*(F.col(c).alias(f"u_{c}") for c in ("doc_id", "source", "size")), "source_size", "target", (F.col("whole") + F.col("fraction")).cast("long").alias("copies"))
    on = [rows[c].eqNullSafe(chosen[f"u_{c}"]) for c in ("doc_id", "source", "size")]
    return rows.join(chosen, on).select("doc_id", "source", "size", "source_size", "target", "copies")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, whatever their names, each as often as it has copies."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    d = docs.select(own, F.col("doc_id").alias("id"), F.col("source").alias("from"), n_words(F.col("text")).alias("words"))
    m = mix(docs).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    joined = d.join(m, d["id"].eqNullSafe(m["doc_id"]) & d["from"].eqNullSafe(m["source"]) & (d["words"] == m["size"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
