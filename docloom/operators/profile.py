"""Profile of a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import unused
from ..functions.text import seeded_order, text_of
from .chunking import share_of

REPLACEMENT = "�"


def length_stats(docs: DataFrame, by: str | None = None) -> DataFrame:
    """n, min, max, mean, median and population deviation of the text lengths, of all or each group."""
    n = unused(docs, "n_")
    rows = docs.withColumn(n, F.length(text_of(F.col("text"))))
    return (rows.groupBy(by) if by else rows.groupBy()).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(n).cast("long").alias("min_len"),
        F.max(n).cast("long").alias("max_len"),
        F.round(F.avg(n), 6).alias("mean_len"),
        F.round(F.median(n), 6).alias("median_len"),
        F.round(F.stddev_pop(n), 6).alias("std_len"),
    )


def length_histogram(docs: DataFrame, bins: int = 10) -> DataFrame:
    """bin (from 1), n: equal-width histogram of the lengths, the last bin closed; one length only: half a unit around it."""
    rows = docs.select(F.length(text_of(F.col("text"))).alias("n_chars"))
    low, high = rows.agg(F.min("n_chars"), F.max("n_chars")).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    low, high = (low - 0.5, high + 0.5) if low == high else (float(low), float(high))
    place = F.least(F.width_bucket(F.col("n_chars").cast("double"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return rows.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def value_shares(docs: DataFrame, col: str = "source") -> DataFrame:
    return share_of(docs, col)


def null_counts(docs: DataFrame) -> DataFrame:
    """column, n_null, n_blank of each column; null texts count as blank, as they are read as empty."""
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            (F.count_if(F.col(f"`{c}`").isNull()) if c != "text" else F.lit(0).cast("long")).alias("n_null"),
            F.count_if(F.trim((text_of(F.col("text")) if c == "text" else F.col(f"`{c}`")).cast("string")) == "").alias("n_blank"),
        )
        for c in docs.columns
    ]
    return docs.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def duplicate_count(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct texts, repeats. Texts are counted by a digest, not shuffled whole."""
    key = F.sha2(text_of(F.col("text")).cast("binary"), 256)
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_distinct")).withColumn(
        "n_repeats", F.col("n") - F.col("n_distinct")
    )


def encoding_count(docs: DataFrame) -> DataFrame:
    """One row: documents that hold the replacement character."""
    return docs.agg(F.count_if(F.contains(text_of(F.col("text")), F.lit(REPLACEMENT))).alias("n_broken"))


def sample(docs: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``n`` rows without replacement, the same for any partitioning."""
    return docs.orderBy(seeded_order(F.col(f"`{id_col}`"), seed), id_col).limit(n)
