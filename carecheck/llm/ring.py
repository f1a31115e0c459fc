"""Consistent-hash ring with virtual nodes and bounded loads.

Shards own virtual nodes on a ring of 64-bit positions; a row stands at the hash of its key and belongs to the
next node clockwise. No shard takes more than its bound: what overflows a full shard goes on clockwise to the next
node whose shard has room. With ``slack`` 0 the bounds add up to the number of rows, so counts differ by at most
one (the law ``rows``); more slack moves fewer rows when shards come or go.

How it runs: rows of an arc (the stretch before a node) are only counted; the driver fills the shards arc by arc
(shards x nodes counts, a fixed number) and returns intervals of ranks within an arc; rows look their rank up.
Ranks within an arc are made in cells of bounded size: the arc's rows are dealt over cells by row number, so that
a key that a third of all rows carry is ranked by many tasks. The narrow rows are written to the shared folder
first, so that row numbers stay what they are if an executor is lost.

A null text is empty (size 16, checksum 0); a null id is a key of its own; rows with equal ids are told apart by
their row number; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carecheck.llm.common import stored

NODES = 64  # virtual nodes of a shard
CELL_ROWS = 20_000  # rows that one task ranks together


def _nodes(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order."""
    made = spark.range(shards * nodes).select(
        F.xxhash64(F.lit("node"), (F.col("id") % shards), F.floor(F.col("id") / shards)).alias("at"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )
    return sorted((r["at"], r["shard"]) for r in made.collect())


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: the even share, the first shards one more, and ``slack`` of it on top."""
    return [int((rows // shards + (s < rows % shards)) * (1 + slack)) for s in range(shards)]


def fill(ring: list[int], counts: dict[int, int], most: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of every stretch, filling shards arc by arc, clockwise on overflow.

    ``ring`` has each node's shard in ring order; arc a ends at node a.
    """
    room, used = list(most), [0] * len(most)
    after = list(range(1, len(ring) + 1))  # the next node that may have room, with path halving
    after[-1] = 0
    out = []
    for arc in range(len(ring)):
        left, rank, at = counts.get(arc, 0), 0, arc
        while left:
            while not room[ring[at]]:
                after[at] = after[after[at]] if not room[ring[after[at]]] else after[at]
                at = after[at]
            take = min(left, room[ring[at]])
            out.append((arc, rank, rank + take, ring[at], used[ring[at]]))
            room[ring[at]] -= take
            used[ring[at]] += take
            left, rank = left - take, rank + take
    return out


def assign(docs: DataFrame, shards: int = 40, slack: float = 0.0, nodes: int = NODES, cell_rows: int = CELL_ROWS,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, and the row's ``home_shard``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    ring = _nodes(spark, shards, nodes)
    narrow = stored(docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(F.lit("row"), F.col(id_column)).alias("at"),
        F.monotonically_increasing_id().alias("row"),
    ))
    arcs = spark.createDataFrame(
        [(k, (ring[k - 1][0] if k else -(1 << 63)), at, s) for k, (at, s) in enumerate(ring)]
        + [(0, ring[-1][0], (1 << 63) - 1, ring[0][1])],
        "arc int, low bigint, high bigint, home_shard int",
    )
    # the ring cut into 4096 even buckets; each meets the few arcs that cross it
    bucket = lambda c: F.shiftright(c, 52).cast("int")
    cut = arcs.select("*", F.explode(F.sequence(bucket("low"), bucket("high"))).alias("bucket"))
    rows = narrow.withColumn("bucket", bucket("at")).join(F.broadcast(cut), "bucket").filter(
        ((F.col("at") > F.col("low")) | ((F.col("low") == -(1 << 63)) & (F.col("at") == F.col("low")))) & (F.col("at") <= F.col("high"))
    ).select("id", "size", "text_crc32", "row", "arc", "home_shard")
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}
    total = sum(counts.values())
    plan = fill([s for _, s in ring], counts, bounds(total, shards, slack))
    cells = max(1, -(-max(counts.values(), default=0) // cell_rows))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    per_cell = rows.groupBy("arc", "cell").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    ).select("arc", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.withColumn(
        "place", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("row")) - 1
    ).join(per_cell, ["arc", "cell"]).withColumn("rank", F.col("place") + F.col("before"))
    stretches = spark.createDataFrame(plan, "arc int, first bigint, end bigint, shard int, slots bigint")
    return ranked.join(F.broadcast(stretches), "arc").filter("rank >= first AND rank < end").select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slots") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )
