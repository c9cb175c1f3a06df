"""Semantic checks of vectors: coherence inside chunks, separability of sections, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import fresh_path
from ..functions.text import sentences
from ..functions.vectors import doubles, unit
from .embedding import Embedder
from .index import VectorIndex


def _sums(vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, n, own, norm2: number of unit vectors, sum of their squared lengths (0 for zero vectors, else 1) and squared length of their sum.

    The sum is taken component by component, so a group's vectors never meet in
    one task: each task adds up its own and only the sums are shuffled.
    """
    each = vectors.select(*keys, F.posexplode(unit(doubles(F.col("embedding")))).alias("i", "x"))
    sums = each.groupBy(*keys, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("own").alias("own"), F.sum(F.col("s") * F.col("s")).alias("norm2"))


def mean_pairwise_cosine(vectors: DataFrame, group: str) -> DataFrame:
    """group, n, coherence: mean cosine over the pairs of a group's vectors; null below two.

    The pairs' sum is half of |sum|^2 less the squared lengths, so no pair is formed.
    """
    pairs = F.col("n") * (F.col("n") - 1)
    return _sums(vectors, group).select(
        group, "n", F.round(F.try_divide(F.col("norm2") - F.col("own"), pairs), 6).alias("coherence")
    )


def coherence_summary(vectors: DataFrame, group: str, incoherent: float = 0.20) -> DataFrame:
    """One row: groups of two or more, mean, median, 10th percentile of the coherence, share below ``incoherent``."""
    c = F.col("coherence")
    return mean_pairwise_cosine(vectors, group).filter(c.isNotNull()).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.round(F.avg(c), 6).alias("mean_coherence"),
        F.round(F.median(c), 6).alias("median_coherence"),
        F.round(F.percentile(c, 0.1), 6).alias("p10_coherence"),
        F.round(F.avg((c < incoherent).cast("double")), 6).alias("incoherent_share"),
    )


def sentence_vectors(chunks: DataFrame, embedder: Embedder, chunk_id: str = "chunk_id") -> DataFrame:
    """chunk_id, embedding: a row for each sentence of the split chunks that have two sentences or more."""
    split = chunks.filter(~F.coalesce(F.col("is_atomic"), F.lit(False))).select(chunk_id, sentences(F.col("text")).alias("sents"))
    each = split.filter(F.size("sents") >= 2).select(chunk_id, F.explode("sents").alias("text"))
    return embedder.embed(each).select(chunk_id, "embedding")


def chunk_coherence(chunks: DataFrame, embedder: Embedder, chunk_id: str = "chunk_id") -> DataFrame:
    """chunk_id, n, coherence: mean cosine over the pairs of a chunk's sentences."""
    return mean_pairwise_cosine(sentence_vectors(chunks, embedder, chunk_id), chunk_id)


def within_section(vectors: DataFrame, section: str = "section") -> DataFrame:
    """section, n, mean cosine within each section of two vectors or more."""
    return mean_pairwise_cosine(vectors, section).filter("n >= 2").select(section, "n", F.col("coherence").alias("within"))


def separability(vectors: DataFrame, section: str = "section") -> DataFrame:
    """One row: pair-pooled mean cosine within and across sections, and their margin; sections of one vector are left out."""
    groups = _sums(vectors, section).filter("n >= 2").select(section, F.col("n").alias("m"), "own", "norm2")
    within = groups.agg(
        F.sum((F.col("norm2") - F.col("own")) / 2).alias("w_sum"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("w_pairs")
    ).withColumn("_k", F.lit(1))
    kept = vectors.join(groups.select(section), section, "left_semi").withColumn("_k", F.lit(1))
    whole = _sums(kept, "_k").select("_k", ((F.col("norm2") - F.col("own")) / 2).alias("sum"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    both = within.join(whole, "_k")
    mean_within = F.try_divide(F.col("w_sum"), F.col("w_pairs"))
    cross = F.try_divide(F.col("sum") - F.col("w_sum"), F.col("pairs") - F.col("w_pairs"))
    return both.select(
        F.round(mean_within, 6).alias("mean_within"), F.round(cross, 6).alias("mean_cross"), F.round(mean_within - cross, 6).alias("margin")
    )


def redundancy(probes: DataFrame, corpus: DataFrame, threshold: float = 0.95, doc: str = "original_doc_id") -> DataFrame:
    """One row: probes, and the share whose single nearest other chunk is as near as ``threshold`` and of another document.

    The unit vectors are dealt into cells around pivots. A probe first meets its own
    cell, and is then copied only to the cells whose borders the distance found
    there reaches, so the whole corpus can be the probes. Chunk ids are keys.
    """
    units = lambda df: df.withColumn("embedding", unit(doubles(F.col("embedding"))))
    index = VectorIndex.build(units(corpus), fresh_path(corpus.sparkSession, "pivots"), keep=(doc,))
    asked = units(probes).select(F.col("chunk_id").alias("query_id"), F.col(doc).alias("doc"), "embedding")
    near = index.search(asked, 1, others=True)
    met = near.select("query_id", "chunk_id", (1 - F.col("distance") / 2).alias("cosine"))
    met = met.join(corpus.select("chunk_id", F.col(doc).alias("other")), "chunk_id").join(asked.select("query_id", "doc"), "query_id")
    hit = (F.round("cosine", 9) >= threshold) & (F.col("other") != F.col("doc"))
    return met.agg(F.count(F.lit(1)).alias("n_probes"), F.count_if(hit).alias("n_redundant")).withColumn(
        "rate", F.round(F.try_divide(F.col("n_redundant"), F.col("n_probes")), 6)
    )
