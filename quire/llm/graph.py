"""Connected components of an edge table, by alternating star contractions; nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

#: Edges that one local contraction holds at a time.
_LOCAL = 1_000_000


def _contract(batches):
    """Within a task, replace edges by edges to the least node known to be linked; that alone removes most long paths."""

    def stars(pairs: np.ndarray) -> pa.RecordBatch:
        nodes, flat = np.unique(pairs, return_inverse=True)
        a, b = flat.reshape(pairs.shape).T
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            fresh = label.copy()
            np.minimum.at(fresh, label[a], low)
            np.minimum.at(fresh, label[b], low)
            np.minimum.at(fresh, a, low)
            np.minimum.at(fresh, b, low)
            while not np.array_equal(fresh, jump := fresh[fresh]):
                fresh = jump
            if np.array_equal(fresh, label):
                break
            label = fresh
        moved = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]).astype(np.int64))
        n += len(held[-1])
        if n >= _LOCAL:
            yield stars(np.concatenate(held))
            held, n = [], 0
    if n:
        yield stars(np.concatenate(held))


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(stars.select("v", "v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of edges (a, b): component_id is the least node that is reachable.

    Nodes whose edges are all loops don't appear. As many edges as one local contraction holds are finished by it. Beyond
    that, rounds alternate stars among greater and smaller neighbours until
    nothing changes, in about the logarithm of the longest path; each round is cut through the checkpoint folder.
    """
    ends = "cast(greatest(a, b) as bigint) u", "cast(least(a, b) as bigint) v"
    df = cut(edges.selectExpr(*ends).filter("u > v").mapInArrow(_contract, "u long, v long").distinct())
    if df.count() <= _LOCAL:
        return _labels(cut(df.coalesce(1).mapInArrow(_contract, "u long, v long")))
    seen = None
    while True:
        state = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return _labels(df)
        seen = state
        both = df.union(df.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        df = cut(small.union(least).distinct())
