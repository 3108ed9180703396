"""Embedding near-dedup with an inverted multi-index (operator 8).

Unit vectors are cut in halves; a codebook for each half, fitted on a bounded sample, makes a grid of cells. A label's
grid is sized by the label's vectors. Every vector is indexed in its cell. A vector looks for its neighbours by the
multi-sequence algorithm: it walks the grid from the cells that may lie nearest, by the sum of two lower bounds on squared
distances, one sequence for each half, until the target recall: until no further cell can hold a neighbour (1), or until
the bound within which the sample's links, and as many made ones, of the least cosine and any direction, have their cell
so often. What the visited cells hold is verified by exact cosine in double precision.

Equal vectors of a label are one class with a count. Of two cells the one with the lower number visits the other, and
both sides are counted. A cell is split into blocks, and its visitors into groups, so a full cell is many tasks' work; a
group returns counts and a spanning forest of its links, never the pairs.

Defined results: vectors with a null label, a null or empty embedding, a component that is null or not finite, or no
length link with nothing; labels of any type that has a text are compared by it; vectors of different dimension do not
compare; repeated rows are vectors of their own, linked with each other; a null id is no component id unless no other id
is reachable; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import partitions, read, scoped, written
from siftline.llm.components import components_sql, connected_components

#: Least cosine of a link, and the recall that the query asks of the index; sampled vectors at most; vectors of a cell on
#: average; centres of a codebook at most; of a block and a group of visitors.
COSINE, TARGET_RECALL, MAX_SAMPLE, PER_CELL, MAX_CENTRES, BLOCK = 0.98, 0.999, 20_000, 256, 1024, 1024


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres by Lloyd's rounds from spread-out starts; fewer if there are fewer distinct points."""
    x = np.unique(x, axis=0)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    order = np.random.default_rng(8).permutation(len(x))
    c = x[order[: min(k, len(x))]]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return squares(x, c).argmin(1)


def lower_bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance that x has at least from any point whose nearest centre is i: by the plane between i and its own centre."""
    d = squares(x, c)
    own = d.argmin(1)
    apart = np.sqrt(squares(c, c))[own]
    beyond = np.maximum(d - d[np.arange(len(x)), own][:, None], 0)
    return (beyond / (2 * np.maximum(apart, 1e-12))) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, until: float) -> Iterator[tuple[float, int, int]]:
    """Cells (i, j) by rising a[i] + b[j], as long as that is at most `until`."""
    u, v = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[u], b[v]
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= until:
        s, i, j = heapq.heappop(heap)
        yield s, int(u[i]), int(v[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[p] + b[q], p, q))


class MultiIndex:
    def __init__(self, sample: np.ndarray, k: int, cosine: float, target_recall: float = 1.0):
        half = (sample.shape[1] + 1) // 2
        unit = sample / np.linalg.norm(sample, axis=1)[:, None] if len(sample) else sample
        self.half, self.books = half, (codebook(unit[:, :half], k), codebook(unit[:, half:], k))
        self.until = 2 - 2 * cosine + 1e-9
        if target_recall < 1 and len(unit):
            self.until = self._needed(unit[:2000], cosine, target_recall)

    def _needed(self, unit: np.ndarray, cosine: float, target: float) -> float:
        """The bound within which the target's part of links have their cell: of links of the sample, and of pairs that are
        made at the least cosine in any direction, whichever need more."""
        a, b = self.bounds(unit)

        def part(i: np.ndarray, other: np.ndarray) -> float:
            c1, c2 = self.cells(other)
            return float(np.quantile(a[i, c1] + b[i, c2], target))

        away = np.random.default_rng(88).normal(size=unit.shape)
        away -= (away * unit).sum(1)[:, None] * unit
        length = np.linalg.norm(away, axis=1)
        some = np.flatnonzero(length > 0)
        out = [part(some, cosine * unit[some] + np.sqrt(1 - cosine**2) * away[some] / length[some, None])] if len(some) else []
        i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
        out += [part(i, unit[j])] if len(i) else []
        return min(max(out, default=self.until) + 1e-12, self.until)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(unit[:, : self.half], self.books[0]), nearest(unit[:, self.half :], self.books[1])

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lower_bounds(unit[:, : self.half], self.books[0]), lower_bounds(unit[:, self.half :], self.books[1])

    def visits(self, unit: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """For each vector the cells to look into, its likeliest first."""
        a, b = self.bounds(unit)
        for p, q in zip(a, b, strict=True):
            yield [(i, j) for _, i, j in multi_sequence(p, q, self.until)]


def forest(linked: np.ndarray, own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest's edges, by id, of the rows and columns of a boolean matrix."""
    rows, cols = linked.any(1), linked.any(0)
    m, own, other = linked[np.ix_(rows, cols)], own[rows], other[cols]
    if not m.size:
        return []
    of_row, of_col = own.copy(), other.copy()
    big = np.iinfo(np.int64).max
    while True:
        r = np.minimum(of_row, np.where(m, of_col[None], big).min(1))
        c = np.minimum(of_col, np.where(m, r[:, None], big).min(0))
        if (r == of_row).all() and (c == of_col).all():
            return [(int(x), int(y)) for x, y in [*zip(own, of_row, strict=True), *zip(other, of_col, strict=True)] if x != y]
        of_row, of_col = r, c


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with their largest component at 1: an extreme scale is taken out first, so that lengths neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1, initial=1e-300)[:, None]


_ROW = "label string, k int, dim int, cell long, visiting boolean, uid long, n long, vector binary"
_ARROW = pa.schema([("label", pa.string()), ("k", pa.int32()), ("dim", pa.int32()), ("cell", pa.int64()), ("visiting", pa.bool_()), ("uid", pa.int64()), ("n", pa.int64()), ("vector", pa.binary())])
_FOUND = "uid long, n_links long, other long"


def verified(t: pa.Table, cosine: float) -> pa.Table:
    """A block of a cell and a group of its visitors, or with itself: (uid, n_links, null) counts of both and (uid, null, other) edges."""
    visiting = t.column("visiting").to_numpy()
    uid, n = t.column("uid").to_numpy(), t.column("n").to_numpy()
    x = np.frombuffer(b"".join(v.as_buffer() for v in t.column("vector")), float).reshape(t.num_rows, -1)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    own = np.flatnonzero(~visiting)
    other = own if t.column("grp")[0].as_py() == -1 else np.flatnonzero(visiting)
    linked = (x[other] @ x[own].T >= cosine) & (uid[other][:, None] != uid[own][None])
    counts = [(uid[other], linked @ n[own])] + ([] if other is own else [(uid[own], n[other] @ linked)])
    ids, sums = (np.concatenate(c) for c in zip(*counts, strict=True))
    edges = np.array(forest(linked, uid[other], uid[own]), np.int64).reshape(-1, 2)
    some = sums > 0
    none = lambda k: pa.nulls(k, pa.int64())
    columns = [(pa.array(ids[some]), pa.array(edges[:, 0])), (pa.array(sums[some].astype(np.int64)), none(len(edges))), (none(int(some.sum())), pa.array(edges[:, 1]))]
    return pa.table([pa.concat_arrays(c) for c in columns], names=["uid", "n_links", "other"])


def links(classes: DataFrame, cosine: float = COSINE, target_recall: float = 1.0) -> DataFrame:
    """classes (uid long, label string, vector array<double>, n long) -> (uid, n_links or null, other or null) rows: counts
    to be summed, and edges that connect all that is linked."""
    spark = classes.sparkSession
    sizes = classes.groupBy("label").agg(F.count("*").alias("size"))
    # Centres of each codebook: the power of two, from 2 on, that comes nearest to PER_CELL vectors in a cell.
    k = sum((F.when(F.col("size") >= PER_CELL * 2 ** (2 * e + 1), 1).otherwise(0) for e in range(1, int(np.log2(MAX_CENTRES)))), F.lit(1))
    sizes = written(sizes.select(F.col("label").alias("own"), "size", F.pow(F.lit(2), k).cast("int").alias("k")), "labels")
    total, ks = sizes.agg(F.sum("size"), F.collect_set("k")).first()
    part = min(1.0, MAX_SAMPLE / max(total or 0, 1))
    drawn = classes.filter(F.pmod(F.xxhash64("uid", F.lit(8)), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * MAX_SAMPLE).select("uid", "vector").toArrow().sort_by("uid")
    lengths = np.array([len(v) for v in drawn.column("vector")], int)
    dims = classes.agg(F.collect_set(F.size("vector"))).first()[0]
    samples = {d: scaled(np.array(drawn.column("vector").filter(pa.array(lengths == d)).combine_chunks().flatten(), float).reshape(-1, d)) for d in dims}
    indexes = {(d, c): MultiIndex(samples[d], c, cosine, target_recall) for d in dims for c in ks}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector in its own cell, and one for each cell of a higher number that it visits."""
        for b in batches:
            dim, kinds = np.array([len(v) for v in b.column("vector")], int), b.column("k").to_numpy()
            for d, c in sorted({*zip(dim.tolist(), kinds.tolist(), strict=True)}):
                rows = b.filter(pa.array((dim == d) & (kinds == c)))
                x, index = scaled(rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)), indexes[d, c]
                for at in range(0, len(x), 512):
                    y = x[at : at + 512]
                    unit = y / np.linalg.norm(y, axis=1)[:, None]
                    home = [int(p) << 32 | int(q) for p, q in zip(*index.cells(unit), strict=True)]
                    cells, owner = [], []
                    for i, visits in enumerate(index.visits(unit)):
                        beyond = [z for p, q in visits if (z := p << 32 | q) > home[i]]
                        cells += [home[i], *beyond]
                        owner += [i] * (1 + len(beyond))
                    take = pa.array(owner) if owner else pa.array([], pa.int64())
                    part = rows.slice(at, 512)
                    first = np.concatenate([[True], np.diff(owner) > 0]) if owner else np.zeros(0, bool)
                    vector = pa.array([v.tobytes() for v in y], pa.binary())
                    columns = [part.column("label").take(take), part.column("k").take(take), pa.array(np.full(len(owner), d, np.int32)), pa.array(cells, pa.int64()), pa.array(~first), part.column("uid").take(take), part.column("n").take(take), vector.take(take)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    sized = classes.join(sizes, F.col("label") == F.col("own")).select("label", "k", "uid", "vector", "n")
    rows = written(sized.mapInArrow(placed, _ROW), "cells")
    key = ["label", "dim", "cell"]
    count = rows.groupBy(key).agg(F.ceil(F.count_if(~F.col("visiting")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("visiting") / BLOCK).cast("int").alias("groups"))
    count = written(count.filter("blocks > 0"), "sizes")  # what visits an empty cell finds nothing
    spot = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(n)).cast("int")
    to = lambda a, b: F.filter(F.sequence(F.least(a, b), b), lambda x: x >= a)
    names = [*key, "block", "grp", "visiting", "uid", "n", "vector"]
    held = rows.filter("not visiting").join(count, key).withColumn("own", spot("blocks", 1))
    # A block meets itself (group -1), the blocks behind it (group -2 - block), and the groups of visitors.
    behind = F.transform(to(F.col("own") + 1, F.col("blocks") - 1), lambda x: -2 - x)
    meets = F.concat(F.array(F.lit(-1)), behind, to(F.lit(0), F.col("groups") - 1))
    as_block = held.withColumn("block", F.col("own")).withColumn("grp", F.explode(meets)).select(names)
    as_visitor = held.withColumn("grp", -2 - F.col("own")).withColumn("block", F.explode(to(F.lit(0), F.col("own") - 1))).withColumn("visiting", F.lit(True)).select(names)
    visitors = rows.filter("visiting").join(count, key).withColumn("grp", spot("groups", 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(names)
    both = as_block.unionByName(as_visitor).unionByName(visitors).repartition(partitions(spark), *key, "block", "grp")
    return both.groupBy(*key, "block", "grp").applyInArrow(lambda t: verified(t, cosine), _FOUND)


@scoped
def near_duplicates(vectors: DataFrame, cosine: float = COSINE, target_recall: float = 1.0) -> DataFrame:
    """(vec_id, embedding, label) -> a row per row: vec_id, n_links, component_id, kept."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = written(vectors.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("uid"), F.when(sound, F.col("label").cast("string")).alias("label"), F.when(sound, v).alias("vector")), "vectors", keep=True)
    good = rows.filter("label is not null")
    classes = written(good.groupBy("label", "vector").agg(F.min("uid").alias("uid"), F.count("*").alias("n")), "classes")
    found = written(links(classes, cosine, target_recall), "links")
    counts = found.filter("n_links is not null").groupBy("uid").agg(F.sum("n_links").alias("n_links"))
    parts = connected_components(found.filter("other is not null").select(F.col("uid").alias("u"), F.col("other").alias("v")))
    c = classes.join(counts, "uid", "left").join(parts.withColumnRenamed("id", "uid"), "uid", "left")
    c = c.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    member = written(good.join(c, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("uid", "vec_id", "n_links", "component"), "members", keep=True)
    least = member.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    joined = member.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.filter("label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), COSINE, TARGET_RECALL)


def oracle() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT p.r AS a, q.r AS b FROM sound p JOIN sound q ON p.label = q.label AND p.r < q.r WHERE CASE WHEN len(p.e) = len(q.e) THEN list_cosine_similarity(p.e, q.e) >= {COSINE} ELSE false END),
{components_sql("v", "edges")},
counts AS (SELECT r, COUNT(*) AS n FROM (SELECT a AS r FROM edges UNION ALL SELECT b FROM edges) GROUP BY r)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, least AS component_id, id = least AS kept FROM v JOIN least USING (r) LEFT JOIN counts USING (r)"""
