"""Nearest neighbours by cosine: a graph from NN-descent, searched greedily.

Equal vectors are one node. The graph starts from cells of neighbours along random directions; each round joins every node's neighbours
(and those it is a neighbour of) with their vectors, compares them with each other, and keeps for each node the best it
has met. The finished lists, both ways, are stored bucketed by node with the neighbours' vectors, so a search step moves only the nodes
to be opened. A search opens the most promising nodes of its pool, round by round, until none in the pool is unopened; the pool
grows with the root of the number of nodes. Vectors travel as unit vectors of 32-bit floats and are compared in 64 bits; whatever the
rounding leaves undecided is scored on the original vectors.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.store import materialise, new_table_path

_GRAPH = "node long, near binary, sims binary"
#: By how much rounding the two unit vectors to 32 bits can move a cosine, at most.
ROUNDING = 2.0 ** -22


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``key``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
        if last:
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _once(table: pa.Table) -> pa.Table:
    """Each (node, other) once, in order."""
    owner, other = table.column("node").to_numpy(), table.column("other").to_numpy()
    order = np.lexsort((other, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (other[order][1:] != other[order][:-1])
    return table.take(order[new])


def _bytes_of(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _units(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    x = _bytes_of(column, "<f4", width).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(owner: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (owner, near) pairs, repeated ones and loops aside, the ``k`` most alike of each owner, with their rank."""
    keep = owner != near
    owner, near, sims = owner[keep], near[keep], sims[keep]
    order = np.lexsort((near, owner))
    owner, near, sims = owner[order], near[order], sims[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
    owner, near, sims = owner[new], near[new], sims[new]
    order = np.lexsort((near, -sims, owner))
    owner, near, sims = owner[order], near[order], sims[order]
    begin = np.ones(len(owner), bool)
    begin[1:] = owner[1:] != owner[:-1]
    first = np.flatnonzero(begin)
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    top = rank < k
    return owner[top], near[top], sims[top], rank[top]


def _lists(owner: np.ndarray, near: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """One row for each owner (sorted): its neighbours and similarities as bytes."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(owner))
    near, sims = near.astype("<i8"), sims.astype("<f8")
    return pa.record_batch([
        pa.array(owner[first], pa.int64()), pa.array([near[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
        pa.array([sims[a:b].tobytes() for a, b in zip(first, last)], pa.binary())], ["node", "near", "sims"])


def _merge(proposals: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all lists proposed for a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "node"):
            sizes = [len(x) // 8 for x in table.column("near").to_pylist()]
            owner = np.repeat(table.column("node").to_numpy(), sizes)
            near, sims = _bytes_of(table.column("near"), "<i8", 1)[:, 0], _bytes_of(table.column("sims"), "<f8", 1)[:, 0]
            owner, near, sims, _ = _best(owner, near, sims, k)
            yield _lists(owner, near, sims)

    return proposals.repartition("node").sortWithinPartitions("node").mapInArrow(run, _GRAPH)


def _start(nodes: DataFrame, width: int, k: int, rounds: int, cell: int, seed: int) -> DataFrame:
    """Neighbours within cells of nodes that lie next to each other along random directions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            vectors = _units(batch.column("vec"), width)
            for lo in range(0, len(ids), cell):
                part, own = vectors[lo: lo + cell], ids[lo: lo + cell]
                sims = part @ part.T
                n = len(own)
                yield _lists(*_best(np.repeat(own, n), np.tile(own, n), sims.ravel(), k)[:3])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for r in range(rounds):
        direction = np.random.default_rng(seed + r).standard_normal(width)

        @F.pandas_udf("double")
        def along(vec, direction=direction):
            import pandas as pd

            return pd.Series(np.frombuffer(b"".join(vec), "<f4").reshape(-1, width) @ direction)

        placed = materialise(nodes.select("node", "vec", along("vec").alias("along")), "directions")
        part = placed.repartitionByRange(n, "along").sortWithinPartitions("along").mapInArrow(run, _GRAPH)
        out = part if out is None else out.unionByName(part)
    return out


def _edges(graph: DataFrame, back: int) -> DataFrame:
    """(node, other): the neighbours of each node and the ``back`` most alike of those it is a neighbour of; some come twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near").to_pylist()
            node = np.repeat(batch.column("node").to_numpy(), [len(x) // 8 for x in near])
            yield pa.record_batch([pa.array(node), pa.array(np.frombuffer(b"".join(near), "<i8")),
                                   pa.array(np.frombuffer(b"".join(batch.column("sims").to_pylist()), "<f8"))], ["node", "other", "sim"])

    flat = graph.mapInArrow(run, "node long, other long, sim double")
    rank = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("sim"), "node"))
    reverse = flat.withColumn("r", rank).where(F.col("r") <= back).select(F.col("other").alias("node"), F.col("node").alias("other"))
    return flat.select("node", "other").unionByName(reverse)


def _descend(graph: DataFrame, nodes: DataFrame, width: int, k: int, offer: int) -> DataFrame:
    """One round: neighbours of neighbours get to know each other; each keeps the best."""
    members = _edges(graph, k)
    met = members.join(nodes.select(F.col("node").alias("other"), "vec"), "other").select("node", "other", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in map(_once, _runs(batches, "node")):
            owner, ids = table.column("node").to_numpy(), table.column("other").to_numpy()
            vectors = _units(table.column("vec"), width)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(first, len(owner)))
            for lo in range(0, len(first), 256):
                a, most = first[lo: lo + 256], int(sizes[lo: lo + 256].max())
                take = a[:, None] + np.arange(most)[None, :]
                real = np.arange(most)[None, :] < sizes[lo: lo + 256, None]
                take = np.where(real, take, a[:, None])
                own = vectors[take]
                sims = own @ own.transpose(0, 2, 1)
                sims[~(real[:, :, None] & real[:, None, :])] = -2
                sims[:, np.arange(most), np.arange(most)] = -2
                n = min(offer, most - 1)
                if n < 1:
                    continue
                best = np.argpartition(-sims, n - 1, axis=2)[:, :, :n]
                value = np.take_along_axis(sims, best, axis=2)
                group, member = np.nonzero(real)
                near = ids[take[group[:, None], best[group, member]]].astype("<i8")
                value = value[group, member].astype("<f8")
                fine = value > -1.5
                yield pa.record_batch([
                    pa.array(ids[take[group, member]], pa.int64()),
                    pa.array([x[f].tobytes() for x, f in zip(near, fine)], pa.binary()),
                    pa.array([x[f].tobytes() for x, f in zip(value, fine)], pa.binary())], ["node", "near", "sims"])

    offers = met.repartition("node").sortWithinPartitions("node").mapInArrow(run, _GRAPH)
    return _merge(graph.unionByName(offers), k)


def build_graph(nodes: DataFrame, width: int, k: int = 24, rounds: int = 4, starts: int = 4, cell: int = 256, offer: int = 8, seed: int = 11) -> DataFrame:
    """(node, near, sims): up to ``k`` near nodes of each, from ``nodes`` (node, vec: ``width`` 32-bit floats as bytes)."""
    graph = materialise(_merge(_start(nodes, width, k, starts, cell, seed), k), "graph")
    for _ in range(rounds):
        graph = materialise(_descend(graph, nodes, width, k, offer), "graph")
    return graph


def _adjacent(graph: DataFrame, nodes: DataFrame, width: int, back: int) -> DataFrame:
    """The graph both ways with the neighbours' vectors, stored bucketed by node in rows of some 4 KB, so that batches stay small."""
    spark, per = graph.sparkSession, max(1, 1024 // width)
    met = _edges(graph, back).join(nodes.select(F.col("node").alias("other"), "vec"), "other").select("node", "other", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in map(_once, _runs(batches, "node")):
            owner, ids = table.column("node").to_numpy(), table.column("other").to_numpy().astype("<i8")
            vectors = _bytes_of(table.column("vec"), "<f4", width)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            first = np.concatenate([np.arange(a, b, per) for a, b in zip(first, np.append(first[1:], len(owner)))])
            last = np.append(first[1:], len(owner))
            yield pa.record_batch([
                pa.array(owner[first]), pa.array([ids[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                pa.array([vectors[a:b].tobytes() for a, b in zip(first, last)], pa.binary())], ["node", "near", "vecs"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = met.repartition(n, "node").sortWithinPartitions("node").mapInArrow(run, "node long, near binary, vecs binary")
    name = f"parley_graph_{uuid.uuid4().hex}"
    lists.write.format("parquet").option("path", new_table_path(spark, "adjacent")).bucketBy(n, "node").saveAsTable(name)
    return spark.table(name)


_POOL = "query long, own binary, near binary, sims binary, opened binary, unopened int"

_COLUMNS = ["query", "own", "near", "sims", "opened", "unopened"]


def _pool_step(pool: int, sure: int) -> Callable:
    """Merges what a round found into each query's pool of the most alike nodes, opened ones marked.

    The pool holds ``pool`` nodes and all that the rounding of vectors cannot tell from the one at place ``sure``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "query"):
            sizes = [len(x) // 8 for x in table.column("near").to_pylist()]
            owner = np.repeat(table.column("query").to_numpy(), sizes)
            near, sims = _bytes_of(table.column("near"), "<i8", 1)[:, 0], _bytes_of(table.column("sims"), "<f8", 1)[:, 0]
            opened = _bytes_of(table.column("opened"), "u1", 1)[:, 0]
            own = {q: v for q, v in zip(table.column("query").to_pylist(), table.column("own").to_pylist()) if v is not None}
            order = np.lexsort((1 - opened, near, owner))
            owner, near, sims, opened = owner[order], near[order], sims[order], opened[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
            owner, near, sims, opened = owner[new], near[new], sims[new], opened[new]
            order = np.lexsort((near, -sims, owner))
            owner, near, sims, opened = owner[order], near[order], sims[order], opened[order]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            end = np.append(first[1:], len(owner))
            least = sims[np.minimum(first + sure, end) - 1] - 2 * ROUNDING
            tied = np.add.reduceat(sims >= np.repeat(least, end - first), first, dtype=np.int64)
            last = np.minimum(end, first + np.maximum(pool, tied))
            unopened = [int((opened[a:b] == 0).sum()) for a, b in zip(first, last)]
            yield pa.record_batch([
                pa.array(owner[first]), pa.array([own[q] for q in owner[first].tolist()], pa.binary()),
                *(pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(first, last)], pa.binary())
                  for x, kind in ((near, "<i8"), (sims, "<f8"), (opened, "u1"))), pa.array(unopened, pa.int32())], _COLUMNS)
    return run


def greedy_search(adjacent: DataFrame, queries: DataFrame, width: int, pool: int, sure: int) -> DataFrame:
    """(query, near, sims): the pool each of ``queries`` (query: a node, vec) ends with, itself included.

    Every round opens the most alike unopened nodes of each pool, an eighth of its size or 100; a query ends when its whole pool is opened.
    """
    beam = max(100, -(-pool // 8))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("query").to_numpy().astype("<i8")
            yield pa.record_batch([batch.column("query"), batch.column("vec"), pa.array([i.tobytes() for i in ids], pa.binary()),
                                   pa.array([np.array([2], "<f8").tobytes()] * len(ids), pa.binary()), pa.array([b"\0"] * len(ids), pa.binary()),
                                   pa.array([1] * len(ids), pa.int32())], _COLUMNS)

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, own, node = [], [], []
            for row in batch.to_pylist():
                near, opened = np.frombuffer(row["near"], "<i8"), np.frombuffer(row["opened"], "u1")
                some = near[opened == 0][:beam].tolist()
                query += [row["query"]] * len(some)
                own += [row["own"]] * len(some)
                node += some
            yield pa.record_batch([pa.array(query, pa.int64()), pa.array(own, pa.binary()), pa.array(node, pa.int64())], ["query", "own", "to_node"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (row for lo in range(0, len(batch), 256) for row in batch.slice(lo, 256).to_pylist()):
                vectors, own = np.frombuffer(row["vecs"], "<f4").reshape(-1, width).astype(np.float64), np.frombuffer(row["own"], "<f4").astype(np.float64)
                sims = vectors @ own / np.sqrt(np.einsum("ij,ij->i", vectors, vectors) * (own @ own))
                out.append((row["query"], None, row["near"], sims.astype("<f8").tobytes(), bytes(len(sims)), 0))
            yield pa.record_batch([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), *[pa.binary()] * 4, pa.int32()))], _COLUMNS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for raw in batch.column("opened").to_pylist():
                opened = np.frombuffer(raw, "u1").copy()
                opened[np.flatnonzero(opened == 0)[:beam]] = 1
                flags.append(opened.tobytes())
            yield batch.set_column(batch.schema.get_field_index("opened"), "opened", pa.array(flags, pa.binary()))

    state, done = materialise(queries.mapInArrow(begin, _POOL), "pool"), []
    while not state.isEmpty():
        asked = state.mapInArrow(frontier, "query long, own binary, to_node long")
        found = adjacent.join(asked.hint("shuffle_hash"), adjacent["node"] == asked["to_node"]).select("query", "own", "near", "vecs").mapInArrow(look, _POOL)
        both = state.mapInArrow(mark, _POOL).unionByName(found)
        pools = materialise(both.repartition("query").sortWithinPartitions("query").mapInArrow(_pool_step(pool, sure), _POOL), "pool")
        done.append(pools.where("unopened = 0"))
        state = pools.where("unopened > 0")
    return reduce(DataFrame.unionByName, done, state).select("query", "near", "sims")


def nearest(embeddings: DataFrame, is_query, k: int = 5, graph_k: int = 24, rounds: int = 4, pool_root: float = 3.6) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` picks, the ``k`` nearest other rows found, by cosine.

    Equal vectors are one node, of which the ``k`` + 1 least vec_ids stand for all: no more can be among the nearest of a
    query. Ties go to the smaller vec_id; fewer than ``k`` others give fewer rows. Vectors that are null, zero, hold null or
    non-finite components, have no vec_id, or another length than the most frequent one take no part; rows
    that repeat a vec_id and its vector count once. Other columns are not read. A search keeps ``pool_root`` times the root of the
    number of unlike vectors in its pool, and ends when it has opened them all.
    """
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fine = raw.where("vec_id is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(
        F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])
    usual = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = usual["n"]
    vectors = materialise(fine.where(F.size("v") == width), "vectors")
    member = Window.partitionBy("v").orderBy("vec_id")
    firsts = materialise(vectors.withColumn("place", F.row_number().over(member)).where(F.col("place") <= k + 1), "members")
    heads = materialise(firsts.where("place = 1").select(F.col("vec_id").alias("node"), "v"), "heads")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
            yield pa.record_batch([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "vec"])

    nodes = materialise(heads.mapInArrow(small, "node long, vec binary"), "nodes")
    graph = build_graph(nodes, width, graph_k, rounds)
    adjacent = _adjacent(graph, nodes, width, graph_k)
    tied = firsts.select(F.col("vec_id").alias("member"), "v", "place")
    by_node = materialise(tied.join(heads, "v").select("node", "member", "place"), "by-node")
    asking = materialise(vectors.where(is_query).join(heads, "v").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "asking")
    starts = asking.select("query").distinct().join(nodes.withColumnRenamed("node", "query"), "query")
    pool = max(8 * k, math.ceil(pool_root * math.sqrt(nodes.count())))
    found = greedy_search(adjacent, starts, width, pool, 2 * k + 1)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for near, sims in zip(batch.column("near").to_pylist(), batch.column("sims").to_pylist()):
                sims = np.frombuffer(sims, "<f8")
                # what lies further below place 2k + 1 than rounding reaches cannot come among the first
                rows.append(np.frombuffer(near, "<i8")[sims >= sims[: 2 * k + 1][-1] - 2 * ROUNDING])
            query = np.repeat(batch.column("query").to_numpy(), [len(x) for x in rows])
            yield pa.record_batch([pa.array(query), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], ["query", "node"])

    pairs = found.mapInArrow(top, "query long, node long").unionByName(starts.select("query", F.col("query").alias("node"))).distinct()
    own = heads.select(F.col("node").alias("query"), F.col("v").alias("qv"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(own, "query").join(heads, "node").select(
        "query", "node", (dot("qv", "v") / F.sqrt(dot("qv", "qv")) / F.sqrt(dot("v", "v"))).alias("score"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = scored.withColumn("r", F.row_number().over(near)).where(F.col("r") <= 2 * k + 1).drop("r")
    others = asking.join(scored, "query").join(by_node, "node").where("member <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "member"))
    return others.select("query_id", rank.alias("rank"), F.col("member").alias("vec_id"), "score").where(F.col("rank") <= k)
