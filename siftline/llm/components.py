"""Connected components of a distributed edge table by alternating large and small stars.

Stars shorten paths until a constant number of edges is left, which one task then finishes; larger tables never meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import drop, written


#: Edges that one task finishes: a constant, some 50 MB.
ONE_TASK = 1 << 20


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, is linked to the least of them. Edges point down here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges of one task -> (id, component)."""
    held = [*batches]
    if not held:
        return
    t = pa.Table.from_batches(held)
    ids, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    a, b = at[: t.num_rows], at[t.num_rows :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for end in (label[a], label[b]):
            np.minimum.at(after, end, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    for k in range(0, len(ids), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 65_536]), pa.array(ids[label[k : k + 65_536]])], names=["id", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v) long -> (id, component): each id on an edge, and the smallest id that it reaches.

    Self-loops, repeated edges and either direction are fine; ids on no edge have no row; no edges give no rows.
    Only counts come to the driver. Hubs are safe: minima are combined before the shuffle, and the joins
    that follow can be split by AQE. Rounds grow with the logarithm of the longest path.
    """
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= one_task:
            return e.coalesce(1).mapInArrow(_labels, "id long, component long")
        if state == seen:
            break
        seen = state
        after = written(_small(_large(e)), "edges")
        drop(e)
        e = after
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def components_sql(nodes: str, edges: str) -> str:
    """DuckDB SQL for (r, least): the least id that each row r of nodes (r, id) reaches by edges (a, b) both ways."""
    return f"""reach(a, b) AS (SELECT r, r FROM {nodes} UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}) e ON reach.b = e.a),
least AS (SELECT reach.a AS r, MIN(n.id) AS least FROM reach JOIN {nodes} n ON n.r = reach.b GROUP BY reach.a)"""
