"""Connected components on DataFrames: edges are contracted in bounded pieces, then alternating large-star and small-star rounds,
each written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import discard, written

#: Edges that one task contracts, about 100 MB of arrays.
PIECE = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) in place of edges (u, v): components stay the same, and no path is longer than 2."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, np.concatenate((x, y)), np.concatenate((low, low)))  # roots hook on to smaller ones
        while (label[label] != label).any():
            label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches):
    got = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if got:
        u, v = contracted(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """edges (a, b) of longs, in any direction, repeats and loops allowed -> (node, component): the smallest id reachable.

    Nodes without an edge to another node don't appear; the caller keeps them as their own component. Edges are dealt to as many
    tasks as they need at piece edges each, which contract what they hold. If that is one, all is done; else rounds follow, each
    a min-aggregate (combined before its shuffle) and a join back, so that a hub costs no task more than its edges.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    parts = -(-e.count() // piece)
    dealt = e.coalesce(1) if parts <= 1 else e.repartition(parts)
    first = written(dealt.mapInArrow(_contract, "u long, v long"), "edges")
    discard(e)
    e, seen = first, None
    while parts > 1:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if state == seen:
            break
        seen = state
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
