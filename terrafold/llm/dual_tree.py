"""Centroid clustering by dual-tree Lloyd: a cover tree over each block of vectors, a tree over the centroids a round.

Vectors are stored in blocks with a cover tree each, built once: a node stands for all vectors of a run of rows, its first
row is its centre, its children have half its reach, cover its rows and are farther apart than that from each other. In a
round a block walks pairs of nodes, one of its tree and one of the centroids' tree, from both roots down. A node's nearest
centroid is no farther for any of its vectors than the least distance of its centre to a centroid plus its reach; pairs that
lie farther for certain are pruned, and a node with one centroid left is settled whole, by the sum of its vectors. Pairs of leaves are
compared exactly. All distances are squares of integers and exact; bounds have a margin above the error of their roots.

Nothing but the sums of each centroid leaves a task. The driver holds k centroids, k and their dimension being
parameters of the call.

Defined results: rows whose array is null, of another length, or has a null or non-finite component are left out; a null id counts as empty text where ids are
hashed, and comes out null; of equal ids the vector decides the order; repeated rows count each; fewer vectors than k give as many centroids;
empty tables give empty results. A component beyond 2**27 in units is an error, because squared distances would not fit a long.
Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import stored

DIM, K, ROUNDS = 64, 16, 3
#: Units of a component, and the largest one in units.
SCALE, LARGEST = 64, 1 << 27
#: Vectors of a block.
BLOCK = 256
#: Up to this size components have distances that doubles hold exactly.
EXACT = 1 << 22
#: Relative margin of pruning, far above the error of a root of an exact square.
MARGIN = 1e-9


def kept_vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, q``: usable vectors as whole numbers of units."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    unit = lambda x: F.when(F.abs(x * scale) > LARGEST, F.raise_error(F.lit(f"a component beyond {LARGEST} units")).cast("int")).otherwise(F.floor(x * scale).cast("int"))
    return rows.where(v.isNotNull() & (F.size(v) == dim) & sound).select(F.col(id_col).alias("id"), F.transform(v, unit).alias("q"))


def first_centroids(kept: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors of the smallest hashes of their ids, in that order."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.q for r in kept.select(hashed.alias("hash"), "q").orderBy("hash", "q").limit(k).collect()], np.int64)  # k rows


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``_numbers``."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _numbers(*tables: np.ndarray) -> list[np.ndarray]:
    """The tables as doubles where these hold every squared distance exactly, else as longs."""
    small = all(np.abs(x).max(initial=0) <= EXACT for x in tables)
    return [x.astype(np.float64 if small else np.int64) for x in tables]


def _pairwise(q: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a block."""
    x, = _numbers(q)
    if x.dtype == np.int64:
        return np.stack([_squares(x, row) for row in x])
    own = np.einsum("ij,ij->i", x, x)
    return (own[:, None] + own - 2 * (x @ x.T)).astype(np.int64)


def cover_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and the nodes (start, end, first child, end of children, squared reach) over runs of that order.

    A node's centre is its first row. Children follow each other; a leaf, whose rows are all equal, has none. The root is node 0.
    """
    order, nodes, apart = np.arange(len(q)), [], _pairwise(q)

    def settle(start: int, end: int) -> None:
        nodes.append([start, end, 0, 0, int(apart[order[start], order[start:end]].max())])

    settle(0, len(q))
    at = 0
    while at < len(nodes):
        start, end, _, _, reach = nodes[at]
        if reach:
            rows, parts = order[start:end], []
            while len(rows):  # the centre first: it is a child of itself
                near = 4 * apart[rows[0], rows] <= reach
                parts.append(rows[near])
                rows = rows[~near]
            order[start:end] = np.concatenate(parts)
            nodes[at][2] = len(nodes)
            for part in parts:
                settle(start, start + len(part))
                start += len(part)
            nodes[at][3] = len(nodes)
        at += 1
    return order, np.array(nodes, np.int64)


def _spread(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from first to end of each pair, one after the other."""
    n = end - first
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def nearest(q: np.ndarray, nodes: np.ndarray, centroids: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """Runs (start, end, cluster) that cover all rows of ``q``, each with its nearest centroid (of equals the smaller number),
    and how many pairs of rows were compared.

    ``q`` is in the order of its tree ``nodes``; ``tree`` is the cover tree of the centroids.
    """
    order, branches = tree
    q, centroids = _numbers(q, centroids)
    root_of = lambda n: np.sqrt(n.astype(np.float64))
    mine, theirs = root_of(nodes[:, 4]), root_of(branches[:, 4])
    number = order[branches[:, 0]]  # rows keep their order within a node, so this is the smallest number of a leaf
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes; those of one node of vectors stand together
    runs, compared = [], 0
    while len(a):
        square = _squares(q[nodes[a, 0]], centroids[number[b]])
        d, compared = root_of(square), compared + len(a)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        most = np.minimum.reduceat(d, first) + mine[a[first]]  # no vector of the node is farther from its nearest centroid
        keep = (d - mine[a] - theirs[b]) * (1 - MARGIN) - MARGIN <= np.repeat(most, np.diff(np.r_[first, len(a)])) * (1 + MARGIN)
        a, b, square = a[keep], b[keep], square[keep]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        held = np.diff(np.r_[first, len(a)])
        widest = np.maximum.reduceat(np.where(branches[b, 2] > 0, theirs[b], -1.0), first)
        leaf = nodes[a[first], 2] == 0
        # One centroid left, or a leaf among leaves, whose distances are those of its vectors: the nearest one is known.
        settled = (widest < 0) & (leaf | (held == 1))
        at = np.repeat(settled, held)
        by = np.lexsort((number[b[at]], square[at], a[at]))
        best = by[np.flatnonzero(np.r_[True, np.diff(a[at]) != 0])] if len(by) else by
        runs.append(np.column_stack([nodes[a[at][best], 0], nodes[a[at][best], 1], number[b[at][best]]]))
        # Of every other node the wider side goes down: its own children, each with all that the node has left, or the centroids' nodes.
        down = np.repeat(~settled & ~leaf & (mine[a[first]] >= widest), held)
        a1, b1 = _spread(nodes[a[down], 2], nodes[a[down], 3]), np.repeat(b[down], nodes[a[down], 3] - nodes[a[down], 2])
        a2, b2 = a[~down & ~at], b[~down & ~at]
        kids = branches[b2, 2] > 0
        low, high = np.where(kids, branches[b2, 2], b2), np.where(kids, branches[b2, 3], b2 + 1)
        a, b = np.r_[a1, np.repeat(a2, high - low)], np.r_[b1, _spread(low, high)]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
    return np.concatenate(runs), compared


BLOCKS = "n int, ids binary, known binary, q binary, nodes binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("q")
        dim = len(lists[0]) if len(lists) else 0
        every = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim)
        ids, known = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        for at in range(0, len(every), BLOCK):
            q = every[at : at + BLOCK]
            order, nodes = cover_tree(q)
            parts = [ids[at : at + BLOCK][order], known[at : at + BLOCK][order].astype(np.uint8), q[order], nodes]
            yield pa.RecordBatch.from_arrays([pa.array([len(q)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["n", "ids", "known", "q", "nodes"])


def blocks_of(kept: DataFrame) -> DataFrame:
    """The vectors in blocks with their cover trees, written to the shared folder; ids are longs."""
    return stored(kept.select(F.col("id").cast("long").alias("id"), "q").mapInArrow(_build, BLOCKS), "vector-blocks")


def _each(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        for row in range(batch.num_rows):
            n, ids, known, q, nodes = (batch.column(c)[row] for c in ("n", "ids", "known", "q", "nodes"))
            if n.as_py():
                yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(known.as_buffer(), np.uint8).astype(bool), np.frombuffer(q.as_buffer(), np.int32).reshape(-1, dim), np.frombuffer(nodes.as_buffer(), np.int64).reshape(-1, 5)


def _sums(centroids: np.ndarray):
    """A function that adds up the vectors of each centroid: one row a task, centroid and dimension, and one for the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        tree, totals = cover_tree(centroids), np.zeros((k, dim + 1), object)  # Python's integers don't overflow
        for _, _, q, nodes in _each(batches, dim):
            before = np.zeros((len(q) + 1, dim), np.int64)
            np.cumsum(q, axis=0, out=before[1:])
            for start, end, cluster in nearest(q, nodes, centroids, tree)[0]:
                totals[cluster, :dim] += before[end] - before[start]
                totals[cluster, dim] += end - start
        at = [(c, j) for c in range(k) if totals[c, dim] for j in range(dim + 1)]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([int(totals[x]) for x in at], pa.int64())], names=["cluster", "place", "total"])

    return run


def _assignment(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = cover_tree(centroids)
        for ids, known, q, nodes in _each(batches, centroids.shape[1]):
            cluster = np.empty(len(q), np.int32)
            for start, end, c in nearest(q, nodes, centroids, tree)[0]:
                cluster[start:end] = c
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~known), pa.array(cluster), pa.array(_squares(*_numbers(q, centroids[cluster])).astype(np.int64))], names=["id", "cluster", "distance"])

    return run


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors; those without vectors stay."""
    dim = centroids.shape[1]
    sums = blocks.mapInArrow(_sums(centroids), "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {(r.cluster, r.place): int(r.total) for r in sums.collect()}  # k * (dim + 1) rows
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := found.get((c, dim)):
            out[c] = [found[c, j] // n for j in range(dim)]
    return out


def lloyd(kept: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of every vector, and the centroids it was last compared with."""
    centroids, spark = first_centroids(kept, k), kept.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    blocks = blocks_of(kept)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    return stored(blocks.mapInArrow(_assignment(centroids), "id long, cluster int, distance long"), "clusters"), centroids


def op12_dual_tree(spark, sf_dir: str) -> DataFrame:
    found, centroids = lloyd(stored(kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "kept-vectors"))
    told = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    of_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    of_all = of_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    about = spark.createDataFrame(told, "cluster int, centroid_sha256 string").join(of_cluster, "cluster").crossJoin(of_all)  # k rows
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_round(n: int) -> str:
    """Assignment ``a{n}`` to the centroids ``c{n}``, and their successors."""
    return f"""a{n} AS MATERIALIZED (SELECT i, arg_min(num, [d, num]) AS num, min(d) AS d FROM (SELECT v.i, c.num, list_sum(list_transform(range(1, {DIM + 1}), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j])))::BIGINT AS d FROM v, c{n} c) GROUP BY i),
c{n + 1} AS MATERIALIZED (SELECT c.num, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN (SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM (SELECT num, j, sum(v.q[j])::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (i), (SELECT unnest(range(1, {DIM + 1})) AS j) GROUP BY ALL) GROUP BY num) m USING (num))"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, q FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIM})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS num, q FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {K})),
{", ".join(_sql_round(n) for n in range(ROUNDS))},
{_sql_round(ROUNDS)},
s AS (SELECT num, sum(d) AS cluster_inertia FROM a{ROUNDS} GROUP BY num)
SELECT vec_id, num::INTEGER AS cluster, d AS distance, cluster_inertia::BIGINT AS cluster_inertia, (SELECT sum(d) FROM a{ROUNDS})::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (i) JOIN s USING (num) JOIN c{ROUNDS} c USING (num)"""
