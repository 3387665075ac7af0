"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in every shard.

Equal vectors form a class, and classes are what is indexed: of a class only the smallest ids can be
among the nearest, since ties go to the smaller id. Classes are dealt to shards by a hash. A shard's
graph grows in batches: a greedy beam search from the entry node proposes neighbours, and relaxed
distance pruning keeps diverse ones (a candidate is dropped if a kept neighbour is nearer to it,
by the factor ``ALPHA``, than the node is). Back edges are added and pruned the same way. Nodes that
the entry doesn't reach become entries themselves.

Distances in the graph are those of the vectors with one more component that gives all the same
length; nearest by this distance then means largest inner product, whatever the lengths.

Queries are searched in blocks: each block meets each shard in one task. A task holds a shard's graph and a
block of queries, both of bounded size. Found vectors are scored again in double precision.

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do null ids. Rows that
repeat id and vector count once; an id with two vectors stands for both. Vectors of different lengths are
never compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stellwerk.llm.batches import stored

NEAREST = 20
DEGREE = 32
BUILD_BEAM = 32
SEARCH_BEAM = 64
ALPHA = 1.2
LEAST_SHARDS = 16
SHARD_ROWS = 20_000
BLOCK_QUERIES = 4_096
_BATCH = 512


def _scored(vectors: np.ndarray, nodes: np.ndarray, points: np.ndarray, squares: np.ndarray | None) -> np.ndarray:
    """Row-wise distance of ``points`` to ``nodes`` (-1: infinite): squared, or the negative inner product."""
    product = np.einsum("bkd,bd->bk", vectors[nodes], points, optimize=True)
    distance = -product if squares is None else squares[nodes] - 2 * product + np.einsum("bd,bd->b", points, points)[:, None]
    return np.where(nodes < 0, np.inf, distance)


def beam_search(
    vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, points: np.ndarray, beam: int, squares: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the nearest nodes found for each point, nearest first; -1 where there are fewer.

    Each step follows the edges of every point's nearest node not yet followed.
    """
    n, rows = len(points), np.arange(len(points))[:, None]
    seen = np.zeros((n, len(vectors)), bool)
    start = entries[: max(beam, 1)]
    nodes = np.full((n, beam), -1)
    nodes[:, : len(start)] = start
    seen[:, start] = True
    distance = _scored(vectors, nodes, points, squares)
    followed = nodes < 0
    while True:
        active = np.flatnonzero(~followed.all(axis=1))
        if not len(active):
            break
        open_distance = np.where(followed[active], np.inf, distance[active])
        nearest = open_distance.argmin(axis=1)
        followed[active, nearest] = True
        reached = graph[nodes[active, nearest]]
        fresh = (reached >= 0) & ~seen[active[:, None], reached]
        reached = np.where(fresh, reached, -1)
        seen[np.broadcast_to(active[:, None], reached.shape)[fresh], reached[fresh]] = True
        found = _scored(vectors, reached, points[active], squares)
        all_nodes = np.concatenate([nodes[active], reached], axis=1)
        all_distance = np.concatenate([distance[active], found], axis=1)
        all_followed = np.concatenate([followed[active], reached < 0], axis=1)
        keep = np.argpartition(all_distance, beam - 1, axis=1)[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, keep, 1)
        distance[active] = np.take_along_axis(all_distance, keep, 1)
        followed[active] = np.take_along_axis(all_followed, keep, 1)
    order = np.argsort(distance, axis=1, kind="stable")
    return nodes[rows, order], distance[rows, order]


def robust_prune(vectors: np.ndarray, squares: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each node of ``points`` out of its candidates (-1: none)."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    # A candidate that stands twice counts once.
    order = np.argsort(candidates, axis=1)
    ranked = np.take_along_axis(candidates, order, 1)
    ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
    distance = _scored(vectors, ranked, vectors[points], squares)
    order = np.argsort(distance, axis=1, kind="stable")
    ranked, distance = np.take_along_axis(ranked, order, 1), np.take_along_axis(distance, order, 1)
    gathered, lengths = vectors[ranked], squares[ranked]
    alive = ranked >= 0
    kept, rows = np.full((len(points), degree), -1), np.arange(len(points))
    for place in range(degree):
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        kept[has, place] = ranked[has, pick[has]]
        chosen = gathered[rows, pick]
        apart = lengths - 2 * np.einsum("bkd,bd->bk", gathered, chosen, optimize=True) + lengths[rows, pick][:, None]
        # Distances are squared, and so is the factor.
        alive &= ~((alpha**2 * apart <= distance) & has[:, None])
        alive[rows, pick] = False
    return kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each node, -1 where fewer; entry nodes) for rows of equal length."""
    n = len(vectors)
    if n <= degree + 1:
        others = np.array([[j for j in range(n) if j != i] + [-1] * (degree - n + 1) for i in range(n)], np.int64)
        return others.reshape(n, degree), np.arange(min(n, 1))
    generator = np.random.default_rng(seed)
    squares = np.einsum("nd,nd->n", vectors, vectors)
    entry = np.array([int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))])
    graph = generator.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    for relaxed in (1.0, alpha):
        order = generator.permutation(n)
        for first in range(0, n, _BATCH):
            points = order[first : first + _BATCH]
            found, _ = beam_search(vectors, graph, entry, vectors[points], beam, squares)
            graph[points] = robust_prune(vectors, squares, points, np.concatenate([found, graph[points]], axis=1), degree, relaxed)
            _add_back_edges(vectors, squares, graph, points, relaxed)
    return graph, np.concatenate([entry, _unreached(graph, entry)])


def _add_back_edges(vectors: np.ndarray, squares: np.ndarray, graph: np.ndarray, points: np.ndarray, alpha: float) -> None:
    degree = graph.shape[1]
    source, target = np.repeat(points, degree), graph[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    # At most as many new edges again as a node has.
    count = np.minimum(count, 2 * degree)
    new = np.full((len(nodes), int(count.max(initial=0))), -1)
    for place in range(new.shape[1]):
        has = count > place
        new[has, place] = source[first[has] + place]
    both = np.concatenate([graph[nodes], new], axis=1)
    new = np.where((new[:, :, None] == graph[nodes][:, None, :]).any(axis=2), -1, new)
    both[:, degree:] = new
    room = (both >= 0).sum(axis=1) <= degree
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    graph[nodes[room]] = packed[room, :degree]
    full = np.flatnonzero(~room)
    for at in range(0, len(full), 2 * _BATCH):
        part = full[at : at + 2 * _BATCH]
        graph[nodes[part]] = robust_prune(vectors, squares, nodes[part], both[part], degree, alpha)


def _unreached(graph: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """One node of each part of the graph that ``entry`` doesn't lead to."""
    reached, extra = np.zeros(len(graph), bool), []
    front = entry
    while True:
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0)]
            front = front[~reached[front]]
        left = np.flatnonzero(~reached)
        if not len(left):
            return np.array(extra, np.int64)
        front = left[:1]
        extra.append(int(left[0]))


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part, each once."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select("vec_id", vector.alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
        .filter(F.exists("embedding", lambda x: x != 0))
        .withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    )


def _classes(vectors: DataFrame, ids: int) -> DataFrame:
    """``class, embedding, ids``: each distinct vector with its ``ids`` smallest ids.

    A vector that very many rows share is cut to those ids before the shuffle.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = vectors.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= ids)
    return (
        first.groupBy("embedding")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .withColumn("class", F.element_at("ids", 1))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def index(spark: SparkSession, vectors: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """``shard, size, node, ids, embedding, neighbours, entry``: the written graphs of all shards."""
    # The dense rank above keeps all rows with one of the smallest ids, one more than can be asked for.
    classes = stored(_classes(vectors, nearest + 1), "vector-classes")
    most = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))).first()
    shards = max(LEAST_SHARDS, -(-most[0] // SHARD_ROWS))
    longest = float(most[1] or 1.0)
    dealt = classes.withColumn("size", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        exact = _matrix(group.column("embedding")) / longest
        last = np.sqrt(np.maximum(1 - (exact**2).sum(axis=1), 0))
        graph, entries = build_graph(np.concatenate([exact, last[:, None]], axis=1).astype(np.float32))
        is_entry = np.zeros(len(graph), bool)
        is_entry[entries] = True
        return pa.table(
            {
                "shard": group.column("shard"),
                "size": group.column("size"),
                "node": pa.array(np.arange(len(graph), dtype=np.int32)),
                "ids": group.column("ids"),
                "embedding": group.column("embedding"),
                "neighbours": pa.array(list(graph.astype(np.int32)), pa.list_(pa.int32())),
                "entry": pa.array(is_entry),
            }
        )

    graph = dealt.select("shard", "size", "ids", "embedding").groupBy("shard", "size").applyInArrow(
        build, "shard int, size int, node int, ids array<bigint>, embedding array<double>, neighbours array<int>, entry boolean"
    )
    return stored(graph, "vector-graph")


def search(spark: SparkSession, graph: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest found for each of ``queries`` (``vec_id, embedding``).

    A row's own id is never among its results; there are fewer where there are fewer candidates.
    """
    points = stored(queries.groupBy("embedding").agg(F.min("vec_id").alias("point")), "query-points")
    blocks = -(-points.count() // BLOCK_QUERIES) or 1
    dealt = points.withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int")).withColumn("size", F.size("embedding"))
    shards = graph.select(F.col("shard").alias("to_shard"), F.col("size").alias("to_size")).distinct()
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = dealt.join(shards, F.col("size") == F.col("to_size"))

    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("point", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(nodes) or not len(asked):
            return schema.empty_table()
        nodes = nodes.sort_by("node")
        exact, points = _matrix(nodes.column("embedding")), _matrix(asked.column("embedding"))
        vectors = exact.astype(np.float32)
        edges = _matrix(nodes.column("neighbours")).astype(np.int64)
        entries = np.flatnonzero(nodes.column("entry").to_numpy())
        lists = nodes.column("ids").combine_chunks()
        first, all_ids = lists.offsets.to_numpy(), lists.values.to_numpy()
        width = min(max(beam, nearest + 1, len(entries)), len(vectors))
        out = []
        for at in range(0, len(points), _BATCH):
            part = points[at : at + _BATCH]
            found, _ = beam_search(vectors, edges, entries, part.astype(np.float32), width)
            row, place = np.nonzero(found >= 0)
            node = found[row, place]
            score = np.einsum("nd,nd->n", part[row], exact[node])
            # Each node stands for the ids of its class.
            times = first[node + 1] - first[node]
            which = np.repeat(np.arange(len(node)), times)
            ids = all_ids[np.repeat(first[node] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            order = np.lexsort((ids, -score[which], row[which]))
            owner = row[which][order]
            ranked = np.arange(len(owner)) - np.searchsorted(owner, owner)
            keep = order[ranked <= nearest]
            out.append(pa.table([asked.column("point").combine_chunks().take(pa.array(at + row[which][keep])), ids[keep], score[which][keep]], schema=schema))
        return pa.concat_tables(out)

    pairs = left.groupBy("shard", "size", "block").cogroup(right.groupBy("to_shard", "to_size", "block"))
    found = pairs.applyInArrow(run, "point bigint, vec_id bigint, score double")
    near = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    # One more than is asked for, since the query itself may be among them.
    found = found.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= nearest + 1)
    lists = found.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding").join(points, "embedding").select("query_id", "point")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    return (
        asked.distinct()
        .join(lists, "point")
        .select("query_id", F.posexplode(others).alias("place", "f"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
    )


def nearest_neighbours(spark: SparkSession, rows: DataFrame, is_query, nearest: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """Search ``vec_id, embedding`` for the rows that ``is_query`` (a condition) picks."""
    vectors = valid_vectors(rows)
    return search(spark, index(spark, vectors, nearest), vectors.filter(is_query), nearest, beam)
