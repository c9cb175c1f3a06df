"""Cleaning of decisions: text, length filter, first of equal texts, and the report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.lineage import first_by, unused
from ..functions.text import clean_text, text_of
from .patterns import matching_patterns


#: Patterns that are tried on every text; of more, only those that can match it are.
MOST_CHAINED = 32


def clean(docs: DataFrame, patterns: Iterable[str] = (), text_col: str = "text", most: int = MOST_CHAINED) -> DataFrame:
    """The input with its text cleaned. Cleaning only takes away from a text, so what its patterns need is looked for in the raw one."""
    text, patterns = F.col(f"`{text_col}`"), list(patterns)
    if len(patterns) <= most:
        return docs.withColumn(text_col, clean_text(text, patterns))
    name = unused(docs, "places_")
    chosen = docs.withColumn(name, matching_patterns(docs.sparkSession, text, patterns))
    return chosen.withColumn(text_col, clean_text(text, patterns, F.col(name))).drop(name)


def long_enough(cleaned: DataFrame, config: EngineConfig, text_col: str = "text") -> DataFrame:
    """The rows whose text has ``min_text_chars`` or more.

    A plain filter would be moved below the cleaning and repeat all of it there; the
    outer form of a list of one or none stays above, so texts are cleaned once.
    """
    kept = F.filter(F.array(F.col(f"`{text_col}`")), lambda t: F.length(t) >= config.min_text_chars)
    return cleaned.withColumn(text_col, F.explode_outer(kept)).filter(F.col(f"`{text_col}`").isNotNull())


def clean_filter_dedup(
    docs: DataFrame, config: EngineConfig, patterns: Iterable[str] = (), order_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cleaned documents of ``min_text_chars`` or more, the first in order of each text.

    No replacement lengthens a text, so raw texts below the limit are left out
    before they are cleaned.
    """
    long = docs.filter(F.length(text_col) >= config.min_text_chars)
    cleaned = long_enough(clean(long, patterns, text_col), config, text_col)
    return first_by(cleaned, F.sha2(F.col(f"`{text_col}`").cast("binary"), 256), [order_col])


def clean_report(docs: DataFrame, config: EngineConfig, order_col: str = "doc_id") -> DataFrame:
    """One row: mean and median length before and after, and the share of characters removed."""
    lengths = lambda df, name: df.agg(
        F.round(F.avg(F.length(text_of(F.col("text")))), 6).alias(f"mean_{name}"),
        F.round(F.median(F.length(text_of(F.col("text")))), 6).alias(f"median_{name}"),
        F.coalesce(F.sum(F.length(text_of(F.col("text")))), F.lit(0)).alias(f"chars_{name}"),
    )
    before = lengths(docs, "before").withColumn("k", F.lit(1))
    after = lengths(clean_filter_dedup(docs, config, order_col=order_col), "after").withColumn("k", F.lit(1))
    reduction = 1.0 - F.col("chars_after") / F.greatest(F.col("chars_before"), F.lit(1))
    return before.join(after, "k").drop("k").withColumn("reduction", F.round(reduction, 6))
