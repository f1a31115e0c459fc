"""Changes between two versions of a table, as a feed that other jobs take in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, BEFORE, AFTER, DELETE = "insert", "update_before", "update_after", "delete"


def _row_hash(df: DataFrame, key: str) -> Column:
    """Digest of a row's other columns, by name; nulls count as values."""
    rest = sorted(c for c in df.columns if c != key)
    return F.sha2(F.to_json(F.struct(F.lit(0).alias("_"), *rest), {"ignoreNullFields": "false"}), 256)


def feed_from_versions(old: DataFrame, new: DataFrame, key: str, version: int) -> DataFrame:
    """What turned ``old`` into ``new``: their columns, ``change`` and ``version``.

    A row that came is an ``insert``, one that went a ``delete``; of a changed row there are two images, ``update_before``
    and ``update_after``. Unchanged rows give nothing. Keys and digests alone meet in a full outer join; the rows of
    changed keys are fetched after it, so the tables' texts are shuffled only where few keys changed or not at all.
    Both versions need the same columns; a key may be null and must be unique in a version, else the feed raises.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"versions have different columns: {old.columns}, {new.columns}")
    if {"change", "version"} & set(old.columns):
        raise ValueError("the columns change and version belong to the feed")

    def digests(df: DataFrame, name: str) -> DataFrame:
        # repeated keys would pair up below: one row per key with their number shows them
        return df.select(F.col(key).alias("_key"), _row_hash(df, key).alias("_hash")).groupBy("_key").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_hash")
        ).select("_key", F.when(F.col("_n") > 1, F.raise_error(F.concat(
            F.lit(f"key not unique in the {name} version: "), F.coalesce(F.col("_key").cast("string"), F.lit("null"))
        )).cast("string")).otherwise(F.col("_hash")).alias(f"_{name}"))

    was, now = digests(old, "old"), digests(new, "new").withColumnRenamed("_key", "_new_key")
    met = was.join(now, F.col("_key").eqNullSafe(F.col("_new_key")), "full_outer")
    kind = F.when(F.col("_old").isNull(), INSERT).when(F.col("_new").isNull(), DELETE).when(F.col("_old") != F.col("_new"), "update")
    changed = met.select(F.when(F.col("_old").isNull(), F.col("_new_key")).otherwise(F.col("_key")).alias("_key"), kind.alias("_kind")).where(
        "_kind IS NOT NULL")

    def images(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
        wanted = changed.where(F.col("_kind").isin(list(kinds)))
        named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("_kind")]
        return df.join(wanted, F.col(key).eqNullSafe(F.col("_key"))).select(
            *old.columns, named.alias("change"), F.lit(version).cast("bigint").alias("version"))

    return images(old, {DELETE: DELETE, "update": BEFORE}).unionByName(images(new, {INSERT: INSERT, "update": AFTER}))


def apply_feed(old: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The version that one version's feed makes of ``old``."""
    gone = feed.where(F.col("change").isin(DELETE, BEFORE)).select(F.col(key).alias("_key"))
    came = feed.where(F.col("change").isin(INSERT, AFTER)).select(*old.columns)
    return old.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(came)


def index_changes(feed: DataFrame, key: str, text: str) -> DataFrame:
    """The feed as rows (doc_id, version, text, deleted) for an index; before-images say nothing there."""
    deleted = F.col("change") == DELETE
    return feed.where(F.col("change") != BEFORE).select(
        F.col(key).alias("doc_id"), "version", F.when(~deleted, F.col(text)).alias("text"), deleted.alias("deleted"))
