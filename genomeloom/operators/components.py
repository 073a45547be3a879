"""Connected components by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomeloom.sources.shared import staged

#: Edges that a task contracts at a time.
HELD = 1 << 18


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these edges reach) of every node but the smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    hung = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[hung], nodes[low[hung]]


def _within(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with those of a task contracted to stars, HELD edges at a time; nodes of other types than numbers are left as they are."""
    kinds = [f.dataType.simpleString() for f in edges.schema]
    if not set(kinds) <= {"int", "bigint"}:
        return edges

    def contracted(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        star = lambda: _stars(*(np.concatenate(x) for x in zip(*held)))
        out = lambda x: pa.record_batch([pa.array(x[0]), pa.array(x[1])], names=["u", "v"])
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= HELD:
                held = [star()]
                rows = len(held[0][0])
                # stars that fill half the room have done their part
                if rows > HELD // 2:
                    yield out(held[0])
                    held, rows = [], 0
        if held:
            yield out(star())

    return edges.select(*(F.col(c).cast("long") for c in "uv")).mapInArrow(contracted, "u long, v long").select(*(F.col(c).cast(k) for c, k in zip("uv", kinds)))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns (node, component).

    Tasks contract the edges they hold to stars. Each round then hangs larger neighbours
    under the smallest one (large star), then smaller neighbours under the smallest (small
    star), until all is stars: each node hangs once, under one that hangs nowhere;
    the number of rounds grows with the logarithm of the longest path, and edges that
    fit one task take none. The minimum
    per node is a partial aggregate and is joined back, so a hub of any degree is
    summed map-side and its join can be split by adaptive execution. Every round is
    written to the shared folder. Nulls and self-loops are dropped; an empty edge
    table gives an empty result.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now = staged(_within(now), "components")
    while True:
        ends = now.select(u.alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(now.select(v.alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("holds")).where("n > 1 OR n = 1 AND holds = 1").isEmpty():
            break
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where(u != v).distinct()
        now = staged(_within(small), "components")
    stars = now.select(u.alias("node"), v.alias("component"))
    roots = now.select(v.alias("node"), v.alias("component")).distinct()
    return stars.unionByName(roots)
