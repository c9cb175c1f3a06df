"""Retrieval benchmark: relevance labels, precision a query, and the report."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import any_keyword, snippet
from .search import SearchEngine


def is_relevant(similarity: Column, text: Column, keywords: Column, threshold: float) -> Column:
    """Similar enough, and with a keyword if there are any."""
    return (similarity >= threshold) & ((F.size(keywords) == 0) | any_keyword(text, keywords))


def label_hits(hits: DataFrame, queries: DataFrame, config: EngineConfig) -> DataFrame:
    """Hits with ``relevant``; queries: query_id, query, keywords."""
    keyed = hits.join(queries.select("query_id", "keywords"), "query_id")
    return keyed.withColumn(
        "relevant", is_relevant(F.col("similarity_score"), F.col("text"), F.col("keywords"), config.benchmark_rel_threshold)
    ).drop("keywords")


def precision(labelled: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, num_results, accuracy of every query; a query without hits has accuracy 0."""
    counts = labelled.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("relevant").alias("r"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("num_results"),
        F.coalesce(F.try_divide(F.col("r"), F.col("n")), F.lit(0.0)).alias("accuracy"),
    )


def report(reranked: DataFrame, plain: DataFrame, queries: DataFrame, latency_ms_mean: float | None = None) -> DataFrame:
    """One row: macro accuracy with and without rerank, their difference, macro false positives, micro similarity.

    Headline figures are those of the reranked hits. Both inputs are labelled hits.
    """
    macro = lambda hits, name: precision(hits, queries).agg(
        F.count(F.lit(1)).alias(f"n_{name}"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias(name)
    ).withColumn("_k", F.lit(1))
    similar = reranked.agg(F.coalesce(F.avg("similarity_score"), F.lit(0.0)).alias("sim")).withColumn("_k", F.lit(1))
    row = macro(reranked, "acc").join(macro(plain, "acc_plain"), "_k").join(similar, "_k")
    return row.select(
        F.col("n_acc").alias("total_queries"),
        F.round("acc", 3).alias("accuracy"),
        F.round("acc_plain", 3).alias("accuracy_no_rerank"),
        F.round(F.col("acc") - F.col("acc_plain"), 3).alias("rerank_delta"),
        F.round(F.when(F.col("n_acc") > 0, 1 - F.col("acc")).otherwise(0.0), 3).alias("false_positive_rate"),
        F.round("sim", 3).alias("avg_similarity"),
        F.round(F.lit(latency_ms_mean).cast("double"), 1).alias("latency_ms_mean"),
    )


def timed_benchmark(engine: SearchEngine, queries: DataFrame) -> DataFrame:
    """``report`` of an engine over a query list (query_id, query, keywords), with the mean latency of its reranked searches.

    Queries are asked one by one, as users do; a latency includes the query's
    embedding. The list is a stated set of bounded size.
    """
    spark, config = queries.sparkSession, engine.config
    hits: dict[bool, list] = {True: [], False: []}
    took = []
    for r in queries.select("query_id", "query").collect():
        for weigh in (True, False):
            began = time.perf_counter()
            found = engine.search(r["query"], rerank=weigh)
            if weigh:
                took.append(1000 * (time.perf_counter() - began))
            hits[weigh] += [(r["query_id"], h["rank"], h["chunk_id"], h["text"], float(h["similarity_score"])) for h in found]
    schema = "query_id long, rank int, chunk_id long, text string, similarity_score double"
    labelled = {k: label_hits(spark.createDataFrame(v, schema), queries, config) for k, v in hits.items()}
    return report(labelled[True], labelled[False], queries, sum(took) / len(took) if took else None)


def nested_report(labelled: DataFrame, queries: DataFrame) -> DataFrame:
    """query, num_results, accuracy, results: one row a query with its hits in rank order."""
    hit = F.struct(
        "rank", "chunk_id", snippet(F.col("text"), 200).alias("text"), "section", F.col("similarity_score").alias("similarity"), "final_score", "relevant"
    )
    lists = labelled.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))
    found = queries.select("query_id", "query").join(precision(labelled, queries), "query_id").join(lists, "query_id", "left")
    return found.withColumn("accuracy", F.round("accuracy", 3))
