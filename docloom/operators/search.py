"""Exact vector search, rerank by section, and diversification of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.lineage import cut, small
from ..functions.shards import QUERY_ROWS, Nearest, by_width, every_shard, grid, in_grid, meet, shard_of
from ..functions.text import first_tokens, jaccard
from ..functions.vectors import cosine_of_l2, final_score, section_weight
from .embedding import Embedder

#: Queries that are sent to every task that scans the corpus; more meet it in shards.
BROADCAST_QUERIES = 4096
#: Hits that are sent to the tasks that read the chunks' texts; more are joined by shuffle.
BROADCAST_HITS = 1_000_000
HITS = "query_id long, chunk_id long, distance double"


def vectors_of(df: DataFrame, id_col: str, vector: str, *keep: str) -> DataFrame:
    """id, v and ``keep``: the rows of ``df`` with an id and a vector without nulls, as doubles."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), *keep)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", F.isnull))


def hits_of(found: Nearest, ids: np.ndarray) -> pa.RecordBatch:
    """What was found for a block of queries of these ids, as rows of ``HITS``."""
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[found.of]), pa.array(found.ids), pa.array(found.near)], names=["query_id", "chunk_id", "distance"]
    )


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    most: int = BROADCAST_QUERIES,
    shards: int | None = None,
) -> DataFrame:
    """query_id, chunk_id, distance, rank: the ``k`` nearest by squared L2 distance, ties to the smaller id.

    Up to ``most`` queries go to the tasks that scan the corpus, and no vector of
    it is shuffled. More are a table like the corpus: the corpus is dealt into
    shards once, every query is sent to each shard, and a shard answers with its k
    best of each query, so the corpus is read once however many queries there are.
    There are as many shards as the corpus takes, or as the root of the tasks; more
    tasks share a shard's queries, so neither table is sent to every task.
    Vectors with a null, or of another width than the query, take no part.
    ``corpus`` should be a table, as its rows are counted for the shards.
    """
    asked, rows = vectors_of(queries, query_id, vector), vectors_of(corpus, chunk_id, vector)
    few = asked.limit(most + 1).toArrow()
    if few.num_rows <= most:
        ids = few.column("id").to_numpy()
        blocks = [(ids[at], m) for at, m in by_width(few.column("v").combine_chunks())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for of, points in by_width(batch.column("v")):
                    names = batch.column("id").to_numpy(zero_copy_only=False)[of]
                    for own, matrix in blocks:
                        for at in range(0, len(own) if matrix.shape[1] == points.shape[1] else 0, QUERY_ROWS):
                            found = Nearest(matrix[at : at + QUERY_ROWS], k)
                            found.add(points, names)
                            yield hits_of(found, own[at : at + QUERY_ROWS])

        hits = rows.mapInArrow(run, HITS)
    else:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n, blocks = (shards, 1) if shards else grid(rows.count(), tasks)
        # floats travel as floats; a task takes all components as doubles
        floats = all(dict(df.dtypes)[vector] == "array<float>" for df in (queries, corpus))
        sent, points = (df.withColumn("v", F.col("v").cast("array<float>" if floats else "array<double>")) for df in (asked, rows))
        dealt = in_grid(points.withColumn("shard", shard_of(F.col("id"), n)), every_shard(sent, n), F.col("id"), blocks)
        hits = meet(*dealt, n * blocks, held_points, answer_nearest(k), HITS)
    best = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def held_points(parts: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A shard's ids and vectors, by width."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in parts:
        for at, points in by_width(batch.column("v")):
            found.setdefault(points.shape[1], []).append((batch.column("id").to_numpy(zero_copy_only=False)[at], points))
    return {w: (np.concatenate([i for i, _ in each]), np.concatenate([p for _, p in each])) for w, each in found.items()}


def answer_nearest(k: int):
    """A shard's k best for each of a block of queries (id, v)."""

    def answer(held: dict[int, tuple[np.ndarray, np.ndarray]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, matrix in by_width(batch.column("v")):
            if matrix.shape[1] in held:
                found = Nearest(matrix, k)
                names, points = held[matrix.shape[1]]
                found.add(points, names)
                yield hits_of(found, batch.column("id").to_numpy(zero_copy_only=False)[at])

    return answer


def rerank(hits: DataFrame, config: EngineConfig, apply_weights: bool) -> DataFrame:
    """Hits with section_weight, final_score and a rank by final score; ties keep the order of retrieval."""
    weight = section_weight(F.col("section"), config) if apply_weights else F.lit(1.0)
    scored = hits.withColumn("section_weight", weight).withColumn(
        "final_score", final_score(F.col("similarity_score"), F.col("section_weight"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "retrieval_rank")
    return scored.withColumn("rank", F.row_number().over(order))


def search(
    queries: DataFrame, corpus: DataFrame, config: EngineConfig, top_k: int | None = None, apply_weights: bool | None = None
) -> DataFrame:
    """query_id, rank, chunk_id, text, section, original_doc_id, similarity_score, section_weight, final_score.

    At least ``search_candidates`` neighbours are fetched, scored, reranked if
    asked for, and cut to ``top_k`` (0 or None: the default).
    """
    k = top_k or config.top_k
    weigh = config.use_section_rerank if apply_weights is None else apply_weights
    near = knn(queries, corpus, max(config.search_candidates, k)).select(
        "query_id",
        "chunk_id",
        F.col("rank").alias("retrieval_rank"),
        F.round(cosine_of_l2(F.col("distance")), 4).alias("similarity_score"),
    )
    # k rows a query: as long as they are few, the corpus and its texts stay where they are
    near = small(cut(near, "hits"), BROADCAST_HITS)
    hits = near.join(corpus.select("chunk_id", "text", "section", "original_doc_id"), "chunk_id")
    return rerank(hits, config, weigh).filter(F.col("rank") <= k).drop("retrieval_rank")


def diversify(hits: DataFrame, n: int, threshold: float = 0.6, n_tokens: int = 50) -> DataFrame:
    """query_id, place, and the hit: at most ``n`` hits a query, of different documents and no near-duplicates.

    Hits are walked in rank order; one of a document already kept, or whose first
    words overlap those of a kept hit by ``threshold`` or more, is skipped, and a
    skipped one does not use up its document. The list of a query is as long as
    its top-k.
    """
    hit = F.struct("rank", "chunk_id", "original_doc_id", "similarity_score", "section", first_tokens(F.col("text"), n_tokens).alias("tokens"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))

    def add(kept, h):
        seen = F.exists(kept, lambda x: x["original_doc_id"] == h["original_doc_id"])
        near = F.exists(kept, lambda x: jaccard(x["tokens"], h["tokens"]) >= threshold)
        return F.when((F.size(kept) >= n) | seen | near, kept).otherwise(F.concat(kept, F.array(h)))

    kind = dict(listed.dtypes)["hits"]
    kept = F.aggregate("hits", F.array().cast(kind), add)
    return listed.select("query_id", F.posexplode(kept).alias("place", "h")).select(
        "query_id", (F.col("place") + 1).alias("place"), "h.chunk_id", "h.original_doc_id", "h.similarity_score", "h.section"
    )


class SearchEngine:
    """A chunk table with vectors behind ``search``; the corpus is cached for repeated queries."""

    def __init__(self, corpus: DataFrame, embedder: Embedder, config: EngineConfig):
        self.config, self.embedder = config, embedder
        self.corpus = corpus.cache()

    def embed_query(self, queries: list[str]) -> DataFrame:
        rows = [(i, self.config.query_prefix + q) for i, q in enumerate(queries)]
        spark = self.corpus.sparkSession
        return self.embedder.embed(spark.createDataFrame(rows, "query_id long, text string"))

    def search(self, query: str, top_k: int | None = None, rerank: bool | None = None) -> list[dict]:
        if not query or len(query.strip()) < 2:
            raise ValueError("a query has two characters at least")
        found = search(self.embed_query([query]), self.corpus, self.config, top_k, rerank)
        return [r.asDict() for r in found.drop("query_id").orderBy("rank").collect()]

    def get_stats(self) -> dict:
        return {
            "total_chunks": self.corpus.count(),
            "model": self.config.st_model_name,
            "vector_dim": self.embedder.dimension,
        }
