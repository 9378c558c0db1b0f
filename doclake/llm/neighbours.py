"""Nearest vectors by largest inner product: vantage-point trees per shard, with relaxed pruning.

An inner product becomes a distance by one more coordinate, ``sqrt(M**2 - |x|**2)`` for a stored vector
(``M`` the largest norm) and 0 for a query: then ``|q - x|**2 = |q|**2 + M**2 - 2 q.x``, so the nearest are
those of the largest inner product and the triangle inequality holds. A branch is left out when it is
farther than the worst of the best found, divided by ``factor``: 1 is exact, a larger one prunes more.

If ``M`` or ``|q|`` were far above the norms of the vectors, all distances would be about alike, and a relaxed
search would leave out nearly everything. So a shard has a tree for each band of norms within a factor of
``BAND``, with the ``M`` of its own vectors, and queries are scaled to that norm, which changes no ranking.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from doclake.llm.common import partitions_for, staged

K = 20
#: Chosen on the given vectors for a recall above 0.99; see the README.
FACTOR = 2.0
SHARD_ROWS = 8192
QUERY_ROWS = 4096
#: Queries of up to so many bytes are broadcast to the shards.
BROADCAST_BYTES = 64 << 20
LEAF = 256
#: The largest norm of a tree is at most so many times its smallest.
BAND = 1.25


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` (double precision) and ``dim`` of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(~odd & some).select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.size(vector).alias("dim")
    )


class Tree:
    """A vantage-point tree over the rows of ``points`` in the distance described above."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.ids, self.points = ids, points
        norms = np.einsum("nd,nd->n", points, points)
        self.reach = float(norms.max())
        self.extra = np.sqrt(np.maximum(0.0, self.reach - norms))
        self.leaf = leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        pivot = rows[len(rows) // 2]
        gap = self.points[rows] - self.points[pivot]
        far = np.sqrt(np.einsum("nd,nd->n", gap, gap) + (self.extra[rows] - self.extra[pivot]) ** 2)
        cut = np.median(far)
        left = far <= cut
        if left.all():
            left = far < cut  # many at the same distance, such as copies
        if not left.any() or left.all():
            return rows
        inside, outside = float(far[left].max()), float(far[~left].min())
        return pivot, inside, outside, self._build(rows[left]), self._build(rows[~left])


def banded(ids: np.ndarray, points: np.ndarray, band: float = BAND) -> list[Tree]:
    """A tree for each band of norms, the largest norms first."""
    norms = np.sqrt(np.einsum("nd,nd->n", points, points))
    level = np.floor(np.log(np.maximum(norms, np.finfo(float).tiny)) / np.log(band))
    return [Tree(ids[level == one], points[level == one]) for one in np.unique(level)[::-1]]


def search(trees: list[Tree], queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float):
    """Scores and ids of the ``k`` best of ``trees`` for every query but rows with the query's own id;
    where fewer exist the score is -inf. Ties go to the smaller id. Queries go down together, and not into
    trees whose norms are too small for them."""
    n = len(queries)
    best, best_ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    lengths = np.sqrt(np.einsum("nd,nd->n", queries, queries))
    for tree in trees:
        most = lengths * np.sqrt(tree.reach) * (1 + 1e-9)
        _search(tree, np.flatnonzero(most >= best[:, -1]), queries, query_ids, lengths, best, best_ids, factor)
    return best, best_ids


def _search(tree: Tree, all_: np.ndarray, queries, query_ids, lengths, best, best_ids, factor: float) -> None:
    """Betters ``best`` and ``best_ids`` of the queries ``all_`` by the vectors of one tree."""
    ids, k = tree.ids, best.shape[1]
    scale = np.where(lengths > 0, np.sqrt(tree.reach) / np.where(lengths > 0, lengths, 1.0), 1.0)
    norms = (lengths * scale) ** 2
    slack = 1e-7 * np.sqrt(tree.reach)

    def offer(some: np.ndarray, rows: np.ndarray) -> None:
        for begin in range(0, len(rows), 256):
            part = rows[begin : begin + 256]
            scores = np.einsum("qd,nd->qn", queries[some], tree.points[part])
            scores[query_ids[some][:, None] == ids[part][None, :]] = -np.inf
            hopeful = scores.max(1) >= best[some, -1]
            at, scores = some[hopeful], scores[hopeful]
            all_scores = np.concatenate([best[at], scores], 1)
            all_ids = np.concatenate([best_ids[at], np.broadcast_to(ids[part], scores.shape)], 1)
            all_ids[all_scores == -np.inf] = np.iinfo(np.int64).max
            order = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
            best[at], best_ids[at] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def reach_of(some: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norms[some] + tree.reach - 2 * scale[some] * best[some, -1])) / factor + slack

    def descend(node, some: np.ndarray) -> None:
        if not len(some):
            return
        if isinstance(node, np.ndarray):
            offer(some, node)
            return
        pivot, inside, outside, left, right = node
        products = scale[some] * (queries[some] @ tree.points[pivot])
        far = np.sqrt(np.maximum(0.0, norms[some] + tree.reach - 2 * products))
        nearer = far <= (inside + outside) / 2
        for first, second, chosen in ((left, right, nearer), (right, left, ~nearer)):
            mine, gap = some[chosen], far[chosen]
            descend(first, mine)
            bound = outside - gap if second is right else gap - inside
            descend(second, mine[bound <= reach_of(mine)])

    descend(tree.root, all_)


def _matrix(table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vector").combine_chunks()
    flat = np.concatenate([c.values.to_numpy() for c in flat.chunks]) if hasattr(flat, "chunks") else flat.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def _forests(stored: DataFrame, shards: int) -> DataFrame:
    """``dim``, ``shard`` and the serialised trees of every shard, built once."""

    def build(rows):
        import pyarrow as pa

        ids, points = _matrix(rows)
        forest = pickle.dumps(banded(ids, points), protocol=5)
        return pa.table([rows.column("dim")[:1], rows.column("shard")[:1], pa.array([forest], pa.binary())], names=["dim", "shard", "forest"])

    dealt = stored.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, forest binary")


def _blocks(asked: DataFrame, blocks: int) -> DataFrame:
    """``dim``, ``block`` and the queries of every block, packed."""

    def pack(rows):
        import pyarrow as pa

        ids, points = _matrix(rows)
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([points.ravel()], pa.list_(pa.float64()))]
        return pa.table([rows.column("dim")[:1], rows.column("block")[:1], *columns], names=["dim", "block", "ids", "queries"])

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids array<long>, queries array<double>")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest found of ``vectors`` for
    every row of ``queries``, both with ``vec_id`` and ``embedding``.

    Rows with a null id, and vectors null, empty, zero or with null or non-finite components take no
    part; vectors of another dimension than the query's are no candidates. Of queries with the same id
    one is asked; a repeated stored row is a candidate each time. Empty tables give no rows. Other
    columns are ignored.

    Shards are dealt by a hash of the id, so equal vectors are spread; the trees of a shard are built once and
    written. Every block of queries meets every shard: queries of up to ``broadcast_bytes`` travel to the trees,
    which stay where they are; more meet them by a shuffle, a pair of block and shard at a time. A pair sends on
    ``k`` rows per query.
    """
    spark = vectors.sparkSession
    stored, asked = staged(usable(vectors), "vectors"), staged(usable(queries).dropDuplicates(["vec_id"]), "queries")
    shards = partitions_for(spark, stored.count(), shard_rows)
    n, size = asked.agg(F.count("*"), F.sum(F.col("dim") * 8)).first()
    blocks = max(1, -(-n // query_rows))
    forests, packed = staged(_forests(stored, shards), "forests"), staged(_blocks(asked, blocks), "blocks")

    def every(number: str, parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(number)

    if (size or 0) <= broadcast_bytes:
        pairs = forests.join(F.broadcast(packed), "dim")
    else:
        pairs = forests.select("*", every("block", blocks)).join(packed.select("*", every("shard", shards)), ["dim", "shard", "block"])

    def within(batches):
        import pyarrow as pa

        for batch in batches:
            for forest, ids, rows in zip(*(batch.column(c) for c in ("forest", "ids", "queries"))):
                query_ids = ids.values.to_numpy()
                points = rows.values.to_numpy().reshape(len(query_ids), -1)
                scores, near = search(pickle.loads(forest.as_buffer()), points, query_ids, k, factor)
                q, rank = np.nonzero(scores > -np.inf)
                columns = [pa.array(c) for c in (query_ids[q], near[q, rank], scores[q, rank])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    found = pairs.select("forest", "ids", "queries").mapInArrow(within, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
