"""Exact top-k inner-product search with a KD-tree per shard.

Vectors become integers, floor(scale * x). They are dealt over shards of bounded size; every shard builds a KD-tree by median splits of the
widest dimension, with tight bounding boxes. A query walks a shard's tree best first: a box promises at most the
inner product with its best corner, and boxes that promise less than the k-th score so far are left out. The k-th
scores that a first shard yields are propagated to all other shards, so those start with a bound. Queries travel in
blocks; every shard returns at most k rows per query, and the best k overall are kept, ties to the smaller id.

Null vectors, vectors with a null or non-finite component and rows with a null id take no part; vectors are compared
with vectors of the same dimension only. Rows with the query's id are its own. A repeated row is a candidate as
often as it occurs; a repeated query id is answered once, for its largest vector. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carecheck.llm.common import stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 512
LEAF = 128


def integers(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    return vectors.filter(
        F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()
        & F.expr(f"forall(`{vector_column}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    ).select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.expr(f"transform(`{vector_column}`, x -> floor({scale}D * double(x)))").cast("array<bigint>").alias("v"),
        F.size(vector_column).alias("dim"),
    )


class Tree:
    """Median splits down to leaves; a node is (low corner, high corner, children or rows)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int] | np.ndarray] = []
        self.root = self._node(np.arange(len(ids)))

    def _node(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.below)
        self.low.append(low)
        self.high.append(high)
        self.below.append(rows)
        if len(rows) > LEAF and len(low):
            axis = int(np.argmax(high - low))
            if high[axis] > low[axis]:
                order = np.argpartition(own[:, axis], len(rows) // 2)
                self.below[at] = (self._node(rows[order[:len(rows) // 2]]), self._node(rows[order[len(rows) // 2:]]))
        return at

    def search(self, query_id: int, query: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """The best (score, id) with scores of ``least`` and more, best first."""
        promise = lambda node: np.maximum(query * self.low[node], query * self.high[node]).sum()
        best: list[tuple[float, int]] = []
        heap = [(-promise(self.root), self.root)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            below = self.below[node]
            if isinstance(below, tuple):
                for child in below:
                    if (p := promise(child)) >= least:
                        heapq.heappush(heap, (-p, child))
                continue
            scores = self.points[below] @ query
            found = np.flatnonzero((scores >= least) & (self.ids[below] != query_id))
            if len(found):
                best = sorted([*best, *zip(scores[found].tolist(), self.ids[below[found]].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    least = max(least, best[-1][0])
        return best


def _numbers(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(lists), 0), np.int64)


def _exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles where all inner products stay exact in them, else as Python integers."""
    top = [float(np.abs(x).max(initial=0)) for x in (points, queries)]
    kind = np.float64 if max(top[0], 1) * max(top[1], 1) * max(points.shape[1], 1) < 2 ** 52 else object
    return points.astype(kind), queries.astype(kind)


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_shard(k: int):
    """For a cogroup of a shard's vectors (vec_id, v, dim) with query blocks (ids, vectors, bounds)."""

    def run(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        if not shard.num_rows or not blocks.num_rows:
            return RESULT.empty_table()
        dim = shard.column("dim")[0].as_py()
        ids = np.concatenate([np.asarray(x) for x in blocks.column("ids").to_pylist()])
        queries = np.concatenate([np.asarray(x, np.int64).reshape(-1, dim) for x in blocks.column("vectors").to_pylist()])
        least = np.concatenate([np.asarray(x, float) for x in blocks.column("bounds").to_pylist()])
        points, queries = _exact(_numbers(shard.column("v"), dim), queries)
        tree = Tree(shard.column("vec_id").to_numpy(), points)
        rows = [
            (query_id, vec_id, int(score))
            for query_id, query, bound in zip(ids.tolist(), queries, least.tolist(), strict=True)
            for score, vec_id in tree.search(query_id, query, k, bound)
        ]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [[], [], []], schema=RESULT)

    return run


def _blocks(queries: DataFrame, shards: DataFrame, n_blocks: int) -> DataFrame:
    """Query blocks, once for each shard of their dimension; 16 blocks at most meet a shard in one task."""
    packed = queries.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "v", "bound")).alias("q")
    ).select("dim", "block", F.col("q.vec_id").alias("ids"), F.col("q.v").alias("vectors"), F.col("q.bound").alias("bounds"))
    return packed.join(shards, "dim").withColumn("part", F.floor(F.col("block") / 16))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS,
          id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for every query row."""
    points = integers(vectors, scale, id_column, vector_column)
    asked = integers(queries, scale, id_column, vector_column)
    asked = stored(asked.groupBy("vec_id").agg(F.max_by(F.struct("v", "dim"), F.struct("dim", "v")).alias("m")).select("vec_id", "m.*"))
    shards, n_blocks = max(1, -(-points.count() // shard_rows)), max(1, -(-asked.count() // BLOCK_QUERIES))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    dealt = stored(dealt.repartition("shard"))
    dims = stored(dealt.select("dim", "shard").distinct())
    parts = dealt.sparkSession.range(-(-n_blocks // 16)).select(F.col("id").alias("part"))

    def search(who: DataFrame, where: DataFrame, bounded: DataFrame) -> DataFrame:
        left = where.crossJoin(F.broadcast(parts)) if n_blocks > 16 else where.withColumn("part", F.lit(0).cast("bigint"))
        blocks = _blocks(bounded, dims.join(who, ["dim", "shard"], "left_semi"), n_blocks)
        return left.groupBy("dim", "shard", "part").cogroup(blocks.groupBy("dim", "shard", "part")).applyInArrow(
            search_shard(k), "query_id bigint, vec_id bigint, score bigint")

    pilot = dims.groupBy("dim").agg(F.min("shard").alias("shard"))
    pilots = dealt.join(F.broadcast(pilot), ["dim", "shard"], "left_semi")
    first = stored(search(pilot, pilots, asked.withColumn("bound", F.lit(float("-inf")))))
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    bounded = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select(
        "vec_id", "v", "dim", F.when(F.col("n") == k, F.col("kth").cast("double")).otherwise(float("-inf")).alias("bound"))
    others = dims.join(pilot, ["dim", "shard"], "left_anti")
    rest = search(others, dealt.join(F.broadcast(pilot), ["dim", "shard"], "left_anti"), bounded)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
