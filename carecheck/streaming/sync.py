"""Incremental work on streams: the search index and the rules.

The index is a folder of batches. A batch holds the postings and the keys of the documents that
changed in it, and a commit row that is written last; readers see committed batches only. What a
reader sees is, per document, its largest version (the later batch where versions are equal); a
version that is marked as deleted hides the document. Writing a batch again replaces it, and
batches carry the id of their stream, so neither a replay nor a new stream overwrites other work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carecheck.functions import text as tx
from carecheck.operators import clean as cl
from carecheck.operators import search, trust
from carecheck.session import cut_lineage, spread

TERM_BUCKETS = 8  # folders of a batch's postings; a search reads those of its terms
CHANGES_PER_TASK = 4_000  # a task holds the postings of so many documents, most of them distinct, in memory


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest row per document of (doc_id, version, text) and, if given, ``deleted``."""
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    return changes.withColumn("deleted", deleted).groupBy("doc_id").agg(
        F.max_by(F.struct("text", "deleted"), "version").alias("row"), F.max("version").alias("version")
    ).select("doc_id", "version", F.coalesce("row.text", F.lit("")).alias("text"), "row.deleted")


def _term_bucket():
    return F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")


def _write(keys: DataFrame, posts: DataFrame, batch: str, number: int, folder: str) -> None:
    keys.write.mode("overwrite").parquet(f"{folder}/keys/batch={batch}")
    posts.withColumn("term_bucket", _term_bucket()).write.mode("overwrite").partitionBy("term_bucket").parquet(
        f"{folder}/postings/batch={batch}")
    commit = keys.sparkSession.createDataFrame([(number,)], "number bigint")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")


def index_batch(changes: DataFrame, batch_id: int, folder: str, stream: str = "batch") -> None:
    # picking versions sorts texts: where a task reads a file of one row group, it would sort the whole file
    newest = latest_changes(spread(changes, "doc_id", CHANGES_PER_TASK)).persist()
    try:
        # a document's length is on its own row; one without an id has no key
        keys = newest.where(F.col("doc_id").isNotNull()).select(
            "doc_id", "version", "deleted", F.size(tx.terms(F.col("text"))).alias("length"))
        posts = search.postings(newest.where("NOT deleted"), "doc_id", "text")
        _write(keys, posts, f"{stream}-{batch_id:010d}", batch_id, folder)
    finally:
        newest.unpersist()


def sync_index(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in all changes that have arrived since the last run, then stop."""

    def take_in(batch: DataFrame, batch_id: int) -> None:
        # the query's id is kept in its checkpoint: the same for a replay, another for a new stream
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        index_batch(batch, batch_id, folder, stream)

    return (
        changes.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _last_keys(spark: SparkSession, folder: str) -> DataFrame:
    commits = spark.read.parquet(f"{folder}/commits")
    keys = spark.read.parquet(f"{folder}/keys").join(commits, "batch")
    return keys.groupBy("doc_id").agg(
        F.max_by(F.struct("batch", "length", "deleted", "version"), F.struct("version", "number", "batch")).alias("row")
    ).select("doc_id", "row.*")


def live_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, batch, length, version) of the documents that are not deleted."""
    return _last_keys(spark, folder).where("NOT deleted").drop("deleted")


def live_postings(
    spark: SparkSession, folder: str, terms: DataFrame | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Postings of the version that counts of each document; ``terms`` (column ``term``) keeps some terms only.

    ``keys`` are the live keys, where the caller has them already.
    """
    posts = spark.read.parquet(f"{folder}/postings")
    if terms is not None:
        posts = posts.join(terms.select("term", _term_bucket().alias("term_bucket")).distinct(), ["term_bucket", "term"], "left_semi")
    keys = live_keys(spark, folder) if keys is None else keys
    return posts.join(keys.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch", "term_bucket")


def compact_index(spark: SparkSession, folder: str, target: str) -> None:
    """Write what counts as one batch of a new folder; deletions stay, so that an older version cannot come back."""
    keys = _last_keys(spark, folder).select("doc_id", "version", "deleted", "length")
    _write(keys, live_postings(spark, folder), f"compact-{uuid.uuid4().hex}", -1, target)


def search_index(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """BM25 top-k over the stored index. Starts jobs when called: postings and totals are made once, for all that reads them."""
    keys = live_keys(spark, folder)
    posts = cut_lineage(live_postings(spark, folder, search.query_terms(queries), keys))
    n_docs, mean_length, n = search.totals(keys)
    return search.bm25_rank(queries, posts, n_docs, mean_length, floors=n > search.FLOOR_DOCS)


def flag_stream(raw: DataFrame, boxes: DataFrame, aliases: DataFrame, as_of: str) -> DataFrame:
    """Raw facility rows of a stream, cleaned, flagged and scored; the rules keep no state."""
    return trust.flagged(cl.clean(raw, boxes, aliases, as_of), boxes)


def append_flagged(flagged: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        flagged.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
