"""A stored vector index: inverted lists around trained centres, product-quantised codes, exact re-ranking.

The index is a folder. ``model`` holds the centres and codebooks; it is trained on the first batch and kept, so that
batches written years apart agree. Each batch adds the codes (by list), the vectors and the keys of the documents that
changed, and a commit row last, in the layout of the keyword index: readers see committed batches only, a document's
largest version counts, a deleted one hides it. ``rebuild`` trains a model for what the index holds by then.

The number of lists is the square root of the number of vectors, so both a list and the table of centres grow with that
root. Centres are trained in two steps, a few top cells on the driver and the lists inside every cell by the cluster, on a
sample of ``PER_LIST`` distinct vectors per list; codebooks on ``CODE_SAMPLE`` vectors. All vectors are indexed.

Vectors that are null, empty or hold a null or a non-finite component are not indexed; they hide an earlier version.
Vectors of another length than the model's raise.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carecheck.operators import search
from carecheck.operators.topk import top_k
from carecheck.session import cut_lineage
from carecheck.streaming import sync

PER_LIST = 64  # sampled vectors per list
CODE_SAMPLE = 16_384  # vectors that the codebooks are trained on
WIDTH, WORDS = 4, 256  # components of a sub-vector, words of a codebook
ROUNDS = 8  # of k-means
CHUNK = 8192  # codes of a list that one task scans
# Share of the lists that a query visits (four at least) and candidates per asked row that are re-ranked. Vectors without
# clusters need so many lists for a recall of 0.9; for clustered ones a few per cent do.
PROBES, RERANK = 0.7, 8


def kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centres; the rows come in no particular order, so the first ones are where it starts."""
    centres = rows[:k].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def _parts(rows: np.ndarray) -> np.ndarray:
    """Rows as (row, part, component), with zeros where the last part is short."""
    width = -(-rows.shape[1] // WIDTH) * WIDTH
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))).reshape(len(rows), -1, WIDTH)


@dataclass
class Model:
    centres: np.ndarray  # (list, component)
    words: np.ndarray  # (part, word, component of the part)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of unit vectors."""
        if unit.shape[1] != self.centres.shape[1]:
            raise ValueError(f"vectors have {unit.shape[1]} components, the index {self.centres.shape[1]}")
        lists = nearest(unit, self.centres)
        rest = _parts(unit - self.centres[lists])
        codes = [nearest(rest[:, p], self.words[p]) for p in range(rest.shape[1])]
        return lists, np.stack(codes, axis=1).astype(np.uint8)

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [("centre", i, 0, c.tolist()) for i, c in enumerate(self.centres)]
        rows += [("word", p, w, x.tolist()) for p, book in enumerate(self.words) for w, x in enumerate(book)]
        spark.createDataFrame(rows, "kind string, number int, word int, vector array<double>").coalesce(1).write.mode(
            "overwrite").parquet(f"{folder}/model")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Model:
        rows = spark.read.parquet(f"{folder}/model").orderBy("kind", "number", "word").collect()
        words = np.array([r.vector for r in rows if r.kind == "word"])
        parts = 1 + max(r.number for r in rows if r.kind == "word")
        return cls(np.array([r.vector for r in rows if r.kind == "centre"]), words.reshape(parts, -1, WIDTH))


def train(vectors: DataFrame) -> Model:
    """A model for (doc_id, vector), all usable, one at least."""
    n = vectors.count()
    lists = max(1, round(n**0.5))
    top = max(1, round(lists**0.5))
    order = F.xxhash64("doc_id")

    def sampled(rows: int) -> DataFrame:
        return vectors.where(F.pmod(order, F.lit(1 << 20)) <= F.lit(int((1 << 20) * min(1.0, rows / n)))).select("vector").dropDuplicates()

    def collected(rows: int) -> np.ndarray:
        picked = sampled(2 * rows).orderBy(F.xxhash64("vector")).limit(rows).toPandas()
        return search._unit(picked["vector"])

    cells = kmeans(collected(PER_LIST * top), top)
    sample = sampled(PER_LIST * lists)
    share = lists / max(1, sample.count())

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=nearest(search._unit(batch["vector"]), cells))

    def centres_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        unit = search._unit(rows["vector"])
        unit = unit[np.lexsort(unit.T)][np.random.default_rng(key[0]).permutation(len(unit))]
        return pd.DataFrame({"cell": key[0], "vector": kmeans(unit, max(1, round(share * len(unit)))).tolist()})

    kind = vectors.schema["vector"].dataType.simpleString()
    found = sample.mapInPandas(cell, f"vector {kind}, cell int").groupBy("cell").applyInPandas(centres_of, "cell int, vector array<double>")
    centres = np.array([r.vector for r in found.orderBy("cell", "vector").collect()])
    unit = collected(CODE_SAMPLE)
    rest = _parts(unit - centres[nearest(unit, centres)])
    return Model(centres, np.stack([kmeans(rest[:, p], WORDS) for p in range(rest.shape[1])]))


def _model(vectors: DataFrame, folder: str) -> Model | None:
    """The folder's model, trained on these vectors if there is none yet; None without a vector to train on."""
    spark = vectors.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/model/_SUCCESS")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return Model.load(spark, folder)
    if vectors.isEmpty():
        return None
    model = train(vectors)
    model.save(spark, folder)
    return model


def index_vectors(changes: DataFrame, batch_id: int, folder: str, stream: str = "batch") -> None:
    """Take in the newest row per document of (doc_id, version, vector) and, if given, ``deleted``."""
    spark = changes.sparkSession
    gone = F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    newest = cut_lineage(changes.withColumn("deleted", gone).groupBy("doc_id").agg(
        F.max_by(F.struct("vector", "deleted"), "version").alias("row"), F.max("version").alias("version")
    ).select("doc_id", "version", "row.vector", "row.deleted"))
    live = search._usable(newest.where("NOT deleted")).select("doc_id", "vector")
    model = _model(live, folder)
    batch = f"{stream}-{batch_id:010d}"
    keys = newest.join(live.select("doc_id", F.lit(True).alias("_live")), "doc_id", "left").select(
        "doc_id", "version", F.col("_live").isNull().alias("deleted"), F.coalesce(F.size("vector"), F.lit(0)).alias("length"))
    if model is not None:
        shared = spark.sparkContext.broadcast(model)  # sqrt(n) centres

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    lists, codes = shared.value.place(search._unit(rows["vector"]))
                    yield rows.assign(list=lists, codes=[c.tobytes() for c in codes])

        kind = {c: live.schema[c].dataType.simpleString() for c in live.columns}
        coded = cut_lineage(live.mapInPandas(encode, f"doc_id {kind['doc_id']}, vector {kind['vector']}, list int, codes binary"))
        # by list, so that a reader's filter on lists skips most of the files and row groups
        coded.select("list", "doc_id", "codes").repartitionByRange("list").sortWithinPartitions("list").write.mode(
            "overwrite").parquet(f"{folder}/codes/batch={batch}")
        coded.select("list", "doc_id", "vector").repartitionByRange("list").sortWithinPartitions("list").write.mode(
            "overwrite").parquet(f"{folder}/vectors/batch={batch}")
    keys.write.mode("overwrite").parquet(f"{folder}/keys/batch={batch}")
    spark.createDataFrame([(batch_id,)], "number bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")


def sync_vectors(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in all changes of a stream that have arrived since the last run, then stop."""

    def take_in(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        index_vectors(batch, batch_id, folder, stream)

    return changes.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, version, vector) of what the index holds."""
    keys = sync.live_keys(spark, folder).select("doc_id", "batch", "version")
    return spark.read.parquet(f"{folder}/vectors").join(keys, ["doc_id", "batch"]).select("doc_id", "version", "vector")


def rebuild(spark: SparkSession, folder: str, target: str) -> None:
    """The index anew in another folder, with a model for what it holds; deletions stay, so that no older version comes back."""
    gone = sync._last_keys(spark, folder).where("deleted").select("doc_id", "version", F.lit(True).alias("deleted"))
    rows = live_vectors(spark, folder).withColumn("deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True)
    index_vectors(rows, 0, target, f"rebuilt-{uuid.uuid4().hex}")


def _visits(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """Queries with the lists of nearest centres, one row each."""
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                unit = search._unit(rows["vector"])
                score = unit @ model.centres.T - (model.centres**2).sum(axis=1) / 2
                yield rows.assign(lists=np.argsort(-score, axis=1, kind="stable")[:, :probes].tolist())

    kind = {c: queries.schema[c].dataType.simpleString() for c in queries.columns}
    visited = queries.mapInPandas(visit, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", lists array<int>")
    return visited.withColumn("list", F.explode("lists")).drop("lists")


def _scan(model: Model, rerank: int):
    """Best codes of one chunk of a list for every query that visits it."""

    def scan(key: tuple, codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(queries):
            codes = codes.sort_values("doc_id")
            ids = codes["doc_id"].to_numpy()
            code = np.frombuffer(b"".join(codes["codes"]), np.uint8).reshape(len(ids), -1)
            unit = search._unit(queries["vector"])
            base, tables = unit @ model.centres[key[0]], np.einsum("qpc,pwc->qpw", _parts(unit), model.words)
            for query_id, k, b, table in zip(queries["query_id"], queries["k"], base, tables):
                score = b + table[np.arange(code.shape[1]), code].sum(axis=1)
                best = np.argsort(-score, kind="stable")[:rerank * k]
                out.append(pd.DataFrame({"query_id": query_id, "k": k, "list": key[0], "doc_id": ids[best], "guess": score[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "k": [], "list": [], "doc_id": [], "guess": []})

    return scan


def search_vectors(queries: DataFrame, folder: str, probes: float = PROBES, rerank: int = RERANK) -> DataFrame:
    """Cosine top-k of (query_id, vector, k): query_id, doc_id, similarity, rank.

    Queries visit the lists of the nearest centres, codes give the candidates, and the candidates' own vectors their
    similarity; a neighbour in a list that is not visited is missed (the tests hold recall to 0.9). With all lists
    visited and enough candidates the answer is exact.
    """
    spark = queries.sparkSession
    model = Model.load(spark, folder)
    keys = sync.live_keys(spark, folder).select("doc_id", "batch")
    codes = spark.read.parquet(f"{folder}/codes").join(keys, ["doc_id", "batch"], "left_semi")
    asked = search._usable(queries).select("query_id", "vector", "k")
    visits = _visits(asked, model, min(len(model.centres), max(4, round(probes * len(model.centres)))))
    sizes = codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    codes = codes.join(F.broadcast(sizes), "list").select(  # a row per list
        "list", "doc_id", "codes", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"))
    visits = visits.join(F.broadcast(sizes), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    kind = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": codes.schema["doc_id"].dataType.simpleString()}
    found = codes.groupBy("list", "chunk").cogroup(visits.groupBy("list", "chunk")).applyInPandas(
        _scan(model, rerank), f"query_id {kind['query_id']}, k int, list int, doc_id {kind['doc_id']}, guess double")
    order = [F.desc("guess"), F.col("doc_id")]
    candidates = top_k(found, ["query_id"], order, F.col("k") * rerank, ["doc_id"]).drop("rank", "guess")
    vectors = spark.read.parquet(f"{folder}/vectors").join(keys, ["doc_id", "batch"], "left_semi").withColumnRenamed("vector", "doc_vector")
    exact = candidates.join(vectors, ["list", "doc_id"]).join(asked.select("query_id", "vector"), "query_id").select(
        "query_id", "k", "doc_id", "vector", "doc_vector")

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, scored in ((b, search._similar(iter([b]))) for b in batches):
            for out in scored:
                yield out.assign(k=rows["k"])

    scored = exact.mapInPandas(similar, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, similarity double, k int")
    return top_k(scored, ["query_id"], [F.desc("similarity"), F.col("doc_id")], F.col("k"), ["doc_id"]).drop("k")
