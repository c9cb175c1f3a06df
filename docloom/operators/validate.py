"""Checks of a chunk table: invariants, undetected sections, word coverage, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ATOMIC, GENERAL, SECTIONS, EngineConfig
from ..functions.lineage import cut, small
from ..functions.text import strip, words
from .chunking import chunk_decisions, with_pieces

#: Repeated ids that are sent to the tasks that read the texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def check_invariants(chunks: DataFrame, config: EngineConfig) -> DataFrame:
    """chunk_id, rule: one row per violation; a chunk can violate several rules."""
    long = F.col("length")
    rules = {
        "empty text": strip(F.col("text")) == "",
        "invalid section": ~F.coalesce(F.col("section").isin(*SECTIONS), F.lit(False)),
        "length differs": long != F.length("text"),
        "atomic in another section": F.col("is_atomic") & ~F.col("section").isin(*ATOMIC),
        "atomic too long": F.col("is_atomic") & (long > config.max_atomic_chars),
        "split too long": ~F.col("is_atomic") & (long > config.chunk_size),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    each = chunks.select("chunk_id", F.explode(broken).alias("rule"))
    again = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeats = again.select("chunk_id", F.explode(F.array_repeat(F.lit("duplicate chunk_id"), (F.col("n") - 1).cast("int"))).alias("rule"))
    return each.unionByName(repeats)


def general_rate(chunks: DataFrame) -> DataFrame:
    """One row: documents with chunks, those with general chunks only, and their percentage."""
    docs = chunks.groupBy("original_doc_id").agg(F.bool_and(F.col("section") == GENERAL).alias("only"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("only").alias("n_general")).withColumn(
        "pct", F.round(100.0 * F.col("n_general") / F.greatest(F.col("n_docs"), F.lit(1)), 6)
    )


def word_coverage(docs: DataFrame, config: EngineConfig, id_col: str = "doc_id", order_col: str | None = None) -> DataFrame:
    """doc, n_words, n_covered, coverage: share of a text's words that the chunks of its id hold.

    Of the texts of a repeated id the last by ``order_col`` counts (without one, the
    last by code point); its chunks are those of all of them. Texts without words
    are left out. Words stay in arrays: no word is a row. Where an id is single, as
    ids mostly are, its row is chunked and covered in place, and neither its text nor
    its words are shuffled; rows of repeated ids alone meet under their id.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), "text", (F.col(f"`{order_col}`") if order_col else F.col("text")).alias("ord"))
    repeated = cut(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc").alias("again")), "repeated")
    met = F.col("doc").eqNullSafe(F.col("again"))
    again = small(repeated, BROADCAST_IDS)
    alone = with_pieces(rows.join(again, met, "left_anti"), config, "doc")
    alone = alone.select("doc", words(F.col("text")).alias("w"), F.array_distinct(F.flatten(F.transform("pieces", words))).alias("own"))
    shared = rows.join(again, met, "left_semi")
    last = shared.groupBy("doc").agg(F.max_by("text", F.struct("ord", "text")).alias("text")).select("doc", words(F.col("text")).alias("w"))
    each = chunk_decisions(shared, config, "doc").select(F.col("doc").alias("of"), words(F.col("text")).alias("w"))
    own = each.groupBy("of").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("own"))
    both = alone.unionByName(last.join(own, F.col("doc").eqNullSafe(F.col("of")), "left").select("doc", "w", "own"))
    covered = both.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.coalesce(F.size(F.array_intersect("w", "own")), F.lit(0)).cast("long").alias("n_covered"),
    )
    return covered.filter("n_words > 0").withColumn("coverage", F.round(F.col("n_covered") / F.col("n_words"), 6))


def coverage_summary(docs: DataFrame, config: EngineConfig, id_col: str = "doc_id", order_col: str | None = None) -> DataFrame:
    """One row: mean and worst coverage; documents without words are left out."""
    return word_coverage(docs, config, id_col, order_col).agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.min("coverage").alias("worst_coverage")
    )


def overlaps(a: Column, b: Column, overlap: int, least: int = 15) -> Column:
    """Whether the end of one chunk and the beginning of the next share ``least`` characters."""
    tail, head = F.right(a, F.lit(2 * overlap)), F.left(b, F.lit(2 * overlap))
    last = F.length(head) - least
    return F.when(last < 0, F.lit(False)).otherwise(
        F.exists(F.sequence(F.lit(0), last), lambda i: F.contains(tail, F.substring(head, i + 1, F.lit(least))))
    )


def chunk_overlap(chunks: DataFrame, config: EngineConfig) -> DataFrame:
    """doc, section, n_pairs, n_overlap of the consecutive split chunks of each section (input: ``chunk_decisions``)."""
    nxt = F.lead("text").over(Window.partitionBy("doc", "sec_ord").orderBy("piece_ord"))
    pairs = chunks.filter(~F.col("is_atomic")).withColumn("next", nxt).filter(F.col("next").isNotNull())
    hit = overlaps(F.col("text"), F.col("next"), config.chunk_overlap)
    return pairs.groupBy("doc", "section").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(hit).alias("n_overlap"))
