"""Connected components by alternating stars: joins and sums only, no group is ever gathered."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.worker import tidied
from parley.sources.store import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def shrink(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever the links between ``a`` and ``b`` join: one for each node but the least of its group."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a):]
    least = np.arange(len(nodes))
    while (least[left] != least[right]).any():
        x, y = least[left], least[right]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != least[least]).any():
            least = least[least]
    rest = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[rest]], nodes[rest]


def forest(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Links (a, b) that join whatever the links (a, b) of ``edges`` join: of each ``block`` links one for each node but the least of its group.

    A dense group has far more links than nodes; the joins that follow then meet the nodes only. Links hold no nulls.
    """
    def shrunk(held: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in shrink(*(np.concatenate(x) for x in zip(*held)))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            rows += len(batch)
            if rows >= block:
                yield shrunk(held)
                held, rows = [], 0
        if rows:
            yield shrunk(held)

    return edges.select("a", "b").coalesce(max(1, -(-edges.count() // block))).mapInArrow(tidied(run), "a long, b long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node with an edge to another, the least node it can reach.

    Every round is written to the shared folder, so a lost executor rereads it and plans stay short. Edges with a
    null end and loops say nothing and are left out; repeated edges count once; no edges give no rows.
    """
    state = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        state = materialise(_small_star(_large_star(state)), "stars")
        now = tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def groups(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link (a, b) to another, the least of each group included."""
    joined = materialise(components(edges, "a", "b"), "joined")
    return joined.unionByName(joined.select(F.col("component").alias("node"), "component")).distinct()
