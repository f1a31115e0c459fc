"""Keyword, vector and hybrid top-k for tables of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecheck.functions import text as tx
from carecheck.operators.topk import top_k
from carecheck.session import cut_lineage

K1, B = 1.2, 0.75
CHUNK_DOCS, BLOCK_QUERIES = 1024, 256
BLOCK_DOCS = 64  # documents of a chunk that share one highest part per term
FLOOR_CHUNKS, FLOOR_DOCS = 16, 64 * CHUNK_DOCS  # one chunk of so many gives the first k-th scores, from so many documents on


# --- keyword half ---------------------------------------------------------------------

def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, length, tokens) per document."""
    tokens = tx.terms(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("doc_id"), tokens.alias("tokens")).select(
        "doc_id", F.size("tokens").alias("length"), "tokens"
    )


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, length, tf). ``only`` (column ``term``) keeps the terms of interest.

    Terms of no interest are dropped before anything is shuffled, and repeats of a term
    are added up in the task that read the document.
    """
    rows = tokenized(docs, key, text).select(
        "doc_id", "length", F.explode_outer("tokens").alias("term")
    ).where(F.col("term").isNotNull())
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term once per query."""
    return queries.select("query_id", F.explode(F.array_distinct(tx.terms(F.col("query")))).alias("term"))


def weighted_terms(queries: DataFrame, posts: DataFrame, n_docs: Column) -> DataFrame:
    """(query_id, k, term, idf) for the query terms that occur in the corpus."""
    # counting over ``tf`` keeps the plan below equal to the postings', so Spark computes it once
    frequency = posts.groupBy("term").agg(F.count("tf").cast("double").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (
        query_terms(queries).join(queries.select("query_id", "k"), "query_id")
        .join(frequency, "term").select("query_id", "k", "term", idf.alias("idf"))
    )


class Blocks:
    """A chunk's postings by term and document, in blocks of documents, with the highest part of every term and block."""

    def __init__(self, posts: pd.DataFrame):
        self.ids, doc = np.unique(posts["doc_id"].to_numpy(), return_inverse=True)
        self.terms, term = np.unique(posts["term"].to_numpy(), return_inverse=True)
        order = np.lexsort((doc, term))
        self.doc, self.part = doc[order], posts["part"].to_numpy()[order]
        self.width = -(-len(self.ids) // BLOCK_DOCS)
        cell = term[order] * self.width + self.doc // BLOCK_DOCS
        self.at = np.searchsorted(cell, np.arange(len(self.terms) * self.width + 1))
        cut = np.flatnonzero(np.diff(cell, prepend=-1))
        high = np.zeros(len(self.at) - 1)
        high[cell[cut]] = np.maximum.reduceat(self.part, cut)
        self.high = high.reshape(len(self.terms), self.width)
        self.scored = 0  # postings that were added up

    def asked(self, queries: np.ndarray, asked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, term, idf) of the asked terms that the chunk holds, by query and term."""
        term = np.minimum(np.searchsorted(self.terms, asked["term"].to_numpy()), len(self.terms) - 1)
        held = self.terms[term] == asked["term"].to_numpy()
        query, term, idf = np.searchsorted(queries, asked["query_id"].to_numpy())[held], term[held], asked["idf"].to_numpy()[held]
        order = np.lexsort((term, query))
        return query[order], term[order], idf[order]

    def bounds(self, n: int, query: np.ndarray, term: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What a document of a block can score at most, by query and block."""
        out = np.zeros((n, self.width))
        np.add.at(out, query, idf[:, None] * self.high[term])
        return out

    def add(self, scores: np.ndarray, wanted: np.ndarray, query: np.ndarray, term: np.ndarray, idf: np.ndarray) -> None:
        """Add the parts of the wanted (query, block) pairs to ``scores`` (query, document)."""
        row, block = np.nonzero(wanted[query])
        cell = term[row] * self.width + block
        many = self.at[cell + 1] - self.at[cell]
        posting = np.repeat(self.at[cell] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        row = np.repeat(row, many)
        place = query[row] * scores.shape[1] + self.doc[posting]
        scores += np.bincount(place, idf[row] * self.part[posting], scores.size).reshape(scores.shape)
        self.scored += len(posting)


ROUNDING = 1e-6  # scores are rounded to six digits


def _best_of_chunk(blocks: Blocks, queries: np.ndarray, asked: pd.DataFrame, k: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Scores (query, document), 0 where a document cannot be among the ``k`` best of its query and reach its floor.

    The block of highest bound is scored first; then only those whose bound reaches the k-th score found there.
    """
    rows = blocks.asked(queries, asked)
    bound = blocks.bounds(len(queries), *rows)
    scores = np.zeros((len(queries), len(blocks.ids)))
    first = (bound == bound.max(axis=1, keepdims=True)) & (bound.cumsum(axis=1) > 0)
    first &= first.cumsum(axis=1) == 1
    blocks.add(scores, first & (bound >= floor[:, None] - ROUNDING), *rows)
    for i, depth in enumerate(k):
        if depth <= scores.shape[1]:
            floor[i] = max(floor[i], np.partition(scores[i], -depth)[-depth])
    blocks.add(scores, ~first & (bound > 0) & (bound >= floor[:, None] - ROUNDING), *rows)
    return np.round(scores, 6)


def _score_chunk(key: tuple, posts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Best documents of one chunk for every query of one block."""
    out = []
    if len(posts) and len(asked):
        per_query = asked.groupby("query_id").agg(k=("k", "first"), floor=("floor", "first"))
        queries, k, floor = per_query.index.to_numpy(), per_query["k"].to_numpy(), per_query["floor"].to_numpy().copy()
        blocks = Blocks(posts)
        scores = _best_of_chunk(blocks, queries, asked, k, floor.copy())
        for i, query_id in enumerate(queries):
            some = np.flatnonzero((scores[i] > 0) & (scores[i] >= floor[i]))
            best = some[np.argsort(-scores[i, some], kind="stable")[:k[i]]]
            out.append(pd.DataFrame({"query_id": query_id, "k": k[i], "doc_id": blocks.ids[best], "score": scores[i, best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
        {"query_id": [], "k": [], "doc_id": [], "score": []})


def _meeting(queries: DataFrame, posts: DataFrame, n_docs: Column, mean_length: Column) -> tuple[DataFrame, DataFrame]:
    """Postings by (chunk, to_block) and weighted query terms by (to_chunk, block), for those that have to meet."""
    n_chunks = F.ceil(n_docs / CHUNK_DOCS).cast("int")
    n_blocks = queries.agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int")).scalar()
    tf = F.col("tf").cast("double")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / mean_length)
    asked = weighted_terms(queries, posts, n_docs)

    held = posts.select(
        "doc_id", "term", (tf * (K1 + 1) / (tf + norm)).alias("part"),
        F.pmod(F.xxhash64("doc_id"), n_chunks).cast("int").alias("chunk"),
    )
    wanted = asked.select("*", F.pmod(F.xxhash64("query_id"), n_blocks).cast("int").alias("block"))
    # postings go to the blocks that ask for their term, terms to the chunks that hold them
    left = held.join(wanted.select("term", F.col("block").alias("to_block")).distinct(), "term")
    right = wanted.join(held.select("term", F.col("chunk").alias("to_chunk")).distinct(), "term")
    return left, right


def bm25_rank(queries: DataFrame, posts: DataFrame, n_docs: Column, mean_length: Column, floors: bool = False) -> DataFrame:
    """The ``k`` best documents of each query from the postings of its terms.

    Documents are cut into chunks and queries into blocks of bounded size. A chunk meets the
    blocks that ask for one of its terms and returns its best k per query, so the (query, document) pairs that a
    frequent term makes never leave the task; a hot term is spread over all chunks. Within a chunk, blocks of documents
    whose highest parts cannot reach a query's k-th score are skipped. With ``floors`` a first pass over some of the chunks
    gives every query a score that its k-th best document has at least, and what is below it is never scored or sent on.
    """
    left, right = _meeting(queries, posts, n_docs, mean_length)
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (posts, "doc_id"))}

    def ranked(left: DataFrame, right: DataFrame) -> DataFrame:
        best = left.groupBy("chunk", "to_block").cogroup(right.groupBy("to_chunk", "block")).applyInPandas(
            _score_chunk, f"query_id {types['query_id']}, k int, doc_id {types['doc_id']}, score double"
        )
        return top_k(best, ["query_id"], [F.desc("score"), F.col("doc_id")], F.col("k"), ["doc_id"])

    right = right.withColumn("floor", F.lit(0.0))
    if floors:
        some = ranked(left.where(F.col("chunk") % FLOOR_CHUNKS == 0), right.where(F.col("to_chunk") % FLOOR_CHUNKS == 0))
        least = some.where("rank = k").select("query_id", F.col("score").alias("least"))
        right = right.join(least, "query_id", "left").withColumn("floor", F.coalesce("least", F.lit(0.0))).drop("least")
    return ranked(left, right).drop("k")


def count_before(ids: np.ndarray, scores: np.ndarray, probe_ids: np.ndarray, probe_scores: np.ndarray) -> np.ndarray:
    """How many of the documents (ids ascending) stand before each probe: higher scores, or equal ones and smaller ids."""
    order = np.argsort(scores, kind="stable")
    ascending = scores[order]
    above = len(scores) - np.searchsorted(ascending, probe_scores, side="right")
    for i, (lo, hi) in enumerate(zip(np.searchsorted(ascending, probe_scores), np.searchsorted(ascending, probe_scores, side="right"))):
        if hi > lo:
            above[i] += np.searchsorted(ids[order[lo:hi]], probe_ids[i])
    return above


def probe_lists(probes: DataFrame, score: str) -> DataFrame:
    """(query_id, probe_ids, probe_scores): a query's probes in two arrays."""
    return probes.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", score)).alias("p")).select(
        "query_id", F.col("p.doc_id").alias("probe_ids"), F.col(f"p.{score}").alias("probe_scores"))


def _count_chunk(key: tuple, posts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """How many documents of one chunk stand before each probe of each query of one block."""
    out = []
    if len(posts) and len(asked):
        probes = asked[asked["probe_ids"].notna()].set_index("query_id")
        blocks, queries = Blocks(posts), np.unique(probes.index.to_numpy())
        rows = blocks.asked(queries, asked[asked["term"].notna()])
        least = np.array([min(probes.at[q, "probe_scores"]) for q in queries])
        scores = np.zeros((len(queries), len(blocks.ids)))
        bound = blocks.bounds(len(queries), *rows)
        blocks.add(scores, (bound > 0) & (bound >= least[:, None] - ROUNDING), *rows)
        for own, query_id in zip(np.round(scores, 6), queries):
            some = own > 0
            out.append(pd.DataFrame({"query_id": query_id, "doc_id": probes.at[query_id, "probe_ids"], "n": count_before(
                blocks.ids[some], own[some], np.asarray(probes.at[query_id, "probe_ids"]),
                np.asarray(probes.at[query_id, "probe_scores"], "float64"))}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "doc_id": [], "n": []})


def bm25_ranks(probes: DataFrame, queries: DataFrame, posts: DataFrame, n_docs: Column, mean_length: Column) -> DataFrame:
    """(query_id, doc_id, rank) of given documents (query_id, doc_id) in their queries' full lists; documents outside have no row.

    A document's rank is one more than the number of those before it, which the chunks count; no list is formed.
    """
    queries = queries.join(probes.select("query_id").distinct(), "query_id", "left_semi")
    left, right = _meeting(queries, posts, n_docs, mean_length)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / mean_length)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    scored = (
        probes.join(posts, "doc_id").join(weighted_terms(queries, posts, n_docs).drop("k"), ["query_id", "term"])
        .groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * part), 6).alias("score"))
    )
    lists = probe_lists(scored, "score")
    visits = right.select("query_id", "to_chunk", "block").distinct().join(lists, "query_id")
    right = right.join(lists.select("query_id"), "query_id", "left_semi").unionByName(visits, allowMissingColumns=True)
    types = {c: probes.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    counted = left.groupBy("chunk", "to_block").cogroup(right.groupBy("to_chunk", "block")).applyInPandas(
        _count_chunk, f"query_id {types['query_id']}, doc_id {types['doc_id']}, n bigint")
    return counted.groupBy("query_id", "doc_id").agg((F.sum("n") + 1).alias("rank"))


def totals(lengths: DataFrame) -> tuple[Column, Column, int]:
    """Number of documents and mean length as literals, and the number itself, from a column ``length``; one job."""
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    return F.lit(float(max(total["n"], 1))), F.lit(total["mean"] or 0.0), total["n"]


def bm25_top_k(queries: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The ``k`` best documents of each query (query_id, query, k). Starts jobs when called.

    The postings of the queries' terms are stored, as weights, both sides of the meeting and the first pass read them.
    """
    posts = cut_lineage(postings(docs, key, text, only=query_terms(queries)))
    n_docs, mean_length, n = totals(tokenized(docs, key, text))
    return bm25_rank(queries, posts, n_docs, mean_length, floors=n > FLOOR_DOCS)


# --- vector half ----------------------------------------------------------------------

PIVOTS = 64
CHUNK_VECTORS, CHUNK_QUERIES = 4096, 4096


def _unit(vectors: pd.Series) -> np.ndarray:
    stacked = np.stack(vectors.to_numpy()).astype("float64")
    length = np.linalg.norm(stacked, axis=1, keepdims=True)
    return np.divide(stacked, length, out=np.zeros_like(stacked), where=length > 0)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(
        "vector IS NOT NULL AND size(vector) > 0"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )


def _cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Corpus vectors with the nearest pivot (cell) and the angle to it."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                angle = _angles(_unit(batch["vector"]), pivots)
                cell = angle.argmin(axis=1)
                yield batch.assign(cell=cell, angle=angle[np.arange(len(batch)), cell])

    schema = T.StructType(corpus.schema.fields + [
        T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()),
    ])
    return corpus.mapInPandas(assign, schema)


def _visits(queries: DataFrame, pivots: np.ndarray, stats: pd.DataFrame) -> DataFrame:
    """Queries with the cells that can hold one of their ``k`` nearest.

    A member of a cell lies within [angle to pivot − far, angle to pivot + far] of the
    query. Cells filled up in order of their upper bound give a bound on the k-th angle;
    cells whose lower bound exceeds it cannot matter.
    """
    cell, near, far, size = (stats[c].to_numpy() for c in ("cell", "near", "far", "n"))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            angle = _angles(_unit(batch["vector"]), pivots[cell])
            low = np.maximum(np.maximum(near - angle, angle - far), 0.0)
            high = np.minimum(angle + far, np.pi)
            order = high.argsort(axis=1)
            filled = size[order].cumsum(axis=1)
            enough = (filled >= batch["k"].to_numpy()[:, None]).argmax(axis=1)
            covered = filled[:, -1] >= batch["k"].to_numpy()
            row = np.arange(len(batch))
            bound = np.where(covered, high[row, order[row, enough]], np.pi)
            wanted = low <= bound[:, None] + 1e-6  # rounding slack
            yield batch.assign(cells=[cell[w].tolist() for w in wanted])

    schema = T.StructType(queries.schema.fields + [T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return queries.mapInPandas(visit, schema)


def _chunk_best(key: tuple, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Best of one chunk of vectors for every query that visits it."""
    out = []
    if len(docs) and len(queries):
        docs = docs.sort_values("doc_id").reset_index(drop=True)
        unit, ids = _unit(docs["vector"]), docs["doc_id"].to_numpy()
        for start in range(0, len(queries), 512):
            block = queries.iloc[start:start + 512]
            similarity = np.round(_unit(block["vector"]) @ unit.T, 6) + 0.0
            ranked = np.argsort(-similarity, axis=1, kind="stable")
            for i, (query_id, k) in enumerate(zip(block["query_id"], block["k"])):
                best = ranked[i, :k]
                out.append(pd.DataFrame(
                    {"query_id": query_id, "k": k, "doc_id": ids[best], "similarity": similarity[i, best]}
                ))
    if not out:
        return pd.DataFrame({"query_id": [], "k": [], "doc_id": [], "similarity": []})
    return pd.concat(out, ignore_index=True)


@dataclass
class Placement:
    """Corpus vectors in cells around pivots, written once, and what is known of every cell."""

    placed: DataFrame
    pivots: np.ndarray
    stats: pd.DataFrame

    @property
    def chunks(self) -> dict[int, int]:
        """Chunks of each cell, so that none holds more than about ``CHUNK_VECTORS``."""
        return {int(c): int(-(-n // CHUNK_VECTORS)) for c, n in zip(self.stats["cell"], self.stats["n"])}


def place(corpus: DataFrame) -> Placement | None:
    """The usable vectors of (doc_id, vector) in cells; None where there are none. Starts jobs."""
    corpus = _usable(corpus).select("doc_id", "vector")
    chosen = corpus.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(PIVOTS).collect()
    if not chosen:
        return None
    pivots = _unit(pd.Series([np.array(r.vector) for r in chosen]))
    placed = cut_lineage(_cells(corpus, pivots))
    stats = placed.groupBy("cell").agg(
        F.min("angle").alias("near"), F.max("angle").alias("far"), F.count(F.lit(1)).alias("n")
    ).toPandas()
    return Placement(placed, pivots, stats)


_VISIT = ["cell", "chunk", "block"]


def _spread(placement: Placement, visits: DataFrame, n_queries: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and visiting queries (with ``cells``) by cell, chunk of the cell and block of queries."""
    blocks = max(1, -(-n_queries // CHUNK_QUERIES))
    per_cell = F.create_map(*[F.lit(x) for pair in placement.chunks.items() for x in pair])

    def up_to(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    spread = placement.placed.select(
        "doc_id", "vector", "cell",
        F.pmod(F.xxhash64("doc_id"), per_cell[F.col("cell")]).cast("int").alias("chunk"),
        F.explode(up_to(F.lit(blocks))).alias("block"),
    )
    visits = visits.withColumn("cell", F.explode("cells")).drop("cells").select(
        "*", F.explode(up_to(per_cell[F.col("cell")])).alias("chunk"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
    )
    return spread, visits


def vector_top_k(queries: DataFrame, corpus: DataFrame | Placement | None) -> DataFrame:
    """Exact cosine top-k: (query_id, vector, k) against (doc_id, vector), or their placement. Starts jobs.

    The corpus is cut into cells around pivot vectors and cells into chunks of bounded
    size; a query visits only the cells that bounds on the angle cannot rule out. Chunks
    return their best k per query, never all pairs. The driver reads ``PIVOTS`` vectors,
    one row per cell and a count.

    Vectors that are null, empty or hold a null or a non-finite component take no part, on
    either side; without any vector left there are no rows.
    """
    id_type = (corpus.schema if isinstance(corpus, DataFrame) else corpus.placed.schema)["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    placement = place(corpus) if isinstance(corpus, DataFrame) else corpus
    queries = _usable(queries)
    if placement is None:
        return queries.sparkSession.createDataFrame([], f"query_id {query_type}, doc_id {id_type}, similarity double, rank int")
    visits = _visits(queries.select("query_id", "vector", "k"), placement.pivots, placement.stats)
    spread, visits = _spread(placement, visits, queries.count())
    best = spread.groupBy(*_VISIT).cogroup(visits.groupBy(*_VISIT)).applyInPandas(
        _chunk_best, f"query_id {query_type}, k int, doc_id {id_type}, similarity double"
    )
    order = [F.desc("similarity"), F.col("doc_id")]
    return top_k(best, ["query_id"], order, F.col("k"), ["doc_id"]).drop("k")


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Probes with their similarity, as the search rounds it."""
    for batch in batches:
        if len(batch):
            cosine = (_unit(batch["vector"]) * _unit(batch["doc_vector"])).sum(axis=1)
            yield batch[["query_id", "doc_id"]].assign(similarity=np.round(cosine, 6) + 0.0)


def _count_vectors(key: tuple, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """How many vectors of one chunk stand before each probe of the visiting queries."""
    out = []
    if len(docs) and len(queries):
        docs = docs.sort_values("doc_id").reset_index(drop=True)
        unit, ids = _unit(docs["vector"]), docs["doc_id"].to_numpy()
        for start in range(0, len(queries), 512):
            block = queries.iloc[start:start + 512]
            similarity = np.round(_unit(block["vector"]) @ unit.T, 6) + 0.0
            for own, query_id, probe_ids, scores in zip(similarity, block["query_id"], block["probe_ids"], block["probe_scores"]):
                out.append(pd.DataFrame({"query_id": query_id, "doc_id": probe_ids, "n": count_before(
                    ids, own, np.asarray(probe_ids), np.asarray(scores, "float64"))}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "doc_id": [], "n": []})


def vector_ranks(probes: DataFrame, queries: DataFrame, placement: Placement) -> DataFrame:
    """(query_id, doc_id, rank) of given documents (query_id, doc_id) among all vectors; those without a vector have no row.

    Only cells that may hold a vector nearer than a query's farthest probe are visited, to count.
    """
    types = {c: probes.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    vectors = placement.placed.select("doc_id", F.col("vector").alias("doc_vector"))
    asked = _usable(queries).select("query_id", "vector")
    scored = cut_lineage(probes.join(vectors, "doc_id").join(asked, "query_id").select(
        "query_id", "doc_id", "vector", "doc_vector").mapInPandas(
        _similar, f"query_id {types['query_id']}, doc_id {types['doc_id']}, similarity double"))
    cell, near, far = (placement.stats[c].to_numpy() for c in ("cell", "near", "far"))
    pivots = placement.pivots[cell]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                angle = _angles(_unit(batch["vector"]), pivots)
                low = np.maximum(np.maximum(near - angle, angle - far), 0.0)
                bound = np.arccos(np.clip([min(s) for s in batch["probe_scores"]], -1.0, 1.0))
                wanted = low <= bound[:, None] + 1e-3  # similarities are rounded
                yield batch.assign(cells=[cell[w].tolist() for w in wanted])

    listed = asked.join(probe_lists(scored, "similarity"), "query_id")
    schema = T.StructType(listed.schema.fields + [T.StructField("cells", T.ArrayType(T.IntegerType()))])
    spread, visits = _spread(placement, listed.mapInPandas(visit, schema), listed.count())
    counted = spread.groupBy(*_VISIT).cogroup(visits.groupBy(*_VISIT)).applyInPandas(
        _count_vectors, f"query_id {types['query_id']}, doc_id {types['doc_id']}, n bigint")
    return counted.groupBy("query_id", "doc_id").agg((F.sum("n") + 1).alias("rank"))


# --- display --------------------------------------------------------------------------

def show_facilities(hits: DataFrame, facilities: DataFrame) -> DataFrame:
    """Ranked hits with the display columns of the facilities found."""
    shown = facilities.select(
        F.col("facility_id").alias("doc_id"), "name", "city", "state", "facility_type", "description"
    )
    return hits.join(shown, "doc_id").withColumnRenamed("doc_id", "facility_id")
