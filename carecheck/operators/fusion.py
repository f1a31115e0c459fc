"""Exact reciprocal-rank fusion of keyword and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.operators import search
from carecheck.operators.topk import top_k
from carecheck.session import cut_lineage

RRF = 60  # a document at rank r of a list gets 1 / (RRF + r) from it
DIGITS = 8  # of a fused score


def fusion_depth(k):
    """How deep both lists are read so that no document outside of both can be among the ``k`` best.

    Unless both lists end before k documents (then they are read whole), one of them holds k documents with votes of
    1 / (RRF + k) or more. A document that neither list shows to depth d has at most 2 / (RRF + d + 1), which is less, by
    more than rounding hides, from twice k + RRF on; an eighth is added for that.
    """
    return 2 * (k + RRF) + F.ceil((k + RRF) / 8)


def _vote(rank):
    return F.lit(1.0) / (RRF + F.col(rank))


def hybrid_top_k(
    queries: DataFrame, docs: DataFrame, key: str, text: str, query_vectors: DataFrame, corpus: DataFrame,
) -> DataFrame:
    """The ``k`` best documents of each query by both of their ranks, counted over the whole lists.

    Both searches return a query's first documents, to the depth at which no unseen one can win (the test of the
    threshold algorithm, met in one round). A document that one list shows and the other does not, and that its best
    possible rank there could bring among the k best, is looked up: its exact rank is counted, not listed. Documents
    without a term of the query, or without a usable vector, get no vote from that list. Starts jobs when called.
    """
    def deep(asked: DataFrame) -> DataFrame:
        return asked.withColumn("k", fusion_depth(F.col("k")).cast("int"))

    # postings and totals serve both the lists and the counting, so they are made once
    posts = cut_lineage(search.postings(docs, key, text, only=search.query_terms(queries)))
    total = search.tokenized(docs, key, text).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    stats = F.lit(float(max(total["n"], 1))), F.lit(total["mean"] or 0.0)
    keyword = search.bm25_rank(deep(queries), posts, *stats, floors=total["n"] > search.FLOOR_DOCS).select("query_id", "doc_id", F.col("rank").alias("keyword_rank"))
    placement = search.place(corpus)
    vector = search.vector_top_k(deep(query_vectors), placement or corpus)
    lists = cut_lineage(keyword.join(
        vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank")), ["query_id", "doc_id"], "full_outer"))

    asked = queries.select("query_id", "k").unionByName(query_vectors.select("query_id", "k")).groupBy("query_id").agg(F.max("k").alias("k"))
    candidates = cut_lineage(_candidates(lists, asked))
    no_keyword = candidates.where("keyword_rank IS NULL AND keyword_open").select("query_id", "doc_id")
    no_vector = candidates.where("vector_rank IS NULL AND vector_open").select("query_id", "doc_id")
    found = candidates.join(
        search.bm25_ranks(no_keyword, queries, posts, *stats).withColumnRenamed("rank", "keyword_found"), ["query_id", "doc_id"], "left")
    if placement is not None:
        found = found.join(
            search.vector_ranks(no_vector, query_vectors, placement).withColumnRenamed("rank", "vector_found"), ["query_id", "doc_id"], "left")
    else:
        found = found.withColumn("vector_found", F.lit(None).cast("bigint"))
    votes = [F.coalesce(F.lit(1.0) / (RRF + F.coalesce(f"{x}_rank", f"{x}_found")), F.lit(0.0)) for x in ("keyword", "vector")]
    fused = found.select("query_id", "doc_id", "k", F.round(votes[0] + votes[1], DIGITS).alias("score"))
    return top_k(fused, ["query_id"], [F.desc("score"), F.col("doc_id")], F.col("k"), ["doc_id"]).drop("k")


def _candidates(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """The documents of both lists that may be among the k best, with k and whether each list goes on below its depth."""
    depth = fusion_depth(F.col("k"))
    ends = lists.groupBy("query_id").agg(F.max("keyword_rank").alias("keyword_last"), F.max("vector_rank").alias("vector_last"))
    goes_on = {x: F.coalesce(F.col(f"{x}_last") >= depth, F.lit(False)) for x in ("keyword", "vector")}
    of_query = asked.join(ends, "query_id").select(
        "query_id", "k", depth.alias("depth"), *[c.alias(f"{x}_open") for x, c in goes_on.items()])
    vote = {x: F.coalesce(_vote(f"{x}_rank"), F.lit(0.0)) for x in ("keyword", "vector")}
    best = {
        x: F.coalesce(_vote(f"{x}_rank"), F.when(F.col(f"{x}_open"), F.lit(1.0) / (RRF + 1 + F.col("depth"))).otherwise(0.0))
        for x in ("keyword", "vector")
    }
    bounded = lists.join(of_query, "query_id").select(
        "*", (vote["keyword"] + vote["vector"]).alias("low"), (best["keyword"] + best["vector"]).alias("high"))
    sure = top_k(bounded.select("query_id", "k", "doc_id", "low"), ["query_id"], [F.desc("low"), F.col("doc_id")], F.col("k"), ["doc_id"])
    least = sure.where("rank = k").select("query_id", F.col("low").alias("least"))
    slack = 10.0 ** (1 - DIGITS)
    return bounded.join(least, "query_id", "left").where(F.col("high") >= F.coalesce("least", F.lit(0.0)) - slack).select(
        "query_id", "doc_id", "k", "keyword_rank", "vector_rank", "keyword_open", "vector_open")
