"""Connected components of an edge table.

A table of many edges is contracted by alternating large-star and small-star
rounds: each is two joins of the edges with each node's least neighbour; a node
with very many edges is combined before the shuffle in the aggregation and
split by skew handling in the join.  Rounds are tables in the shared folder, so
lineage stays short and lost executors lose nothing.  A table that is counted
to have at most SMALL edges is labelled by one task, whose memory that bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, stored, tidy

#: Edges that one task labels (16 bytes each).
SMALL = 1 << 20


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    of = np.arange(len(nodes))
    while True:
        low = np.minimum(of[x], of[y])
        new = of.copy()
        np.minimum.at(new, of[x], low)
        np.minimum.at(new, of[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == of).all():
            return nodes, nodes[of]
        of = new


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """(a, b) pairs, both directions wanted by the caller: links each b that `keep` accepts to the least of a and its b's."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a").where(keep)


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, class) for every node of edges (a, b): class is the least id of its component."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= small:

        def run(batches):
            parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if parts:
                node, of = labels(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(of)], ["id", "class"])

        return now.coalesce(1).mapInArrow(tidy(run), "id long, class long")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        downward = large.where("a <> b").distinct()
        near = _star(downward, "true")
        near = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(near.select("a", F.col("m").alias("b")))
        old, now = now, stored(near.where("a <> b").distinct(), "edges")
        discard(old)
    return now.select(F.col("a").alias("id"), F.col("b").alias("class")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())
