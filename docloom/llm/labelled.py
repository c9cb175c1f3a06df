"""The bounded, reproducible sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, fold, pick

#: Characters of all texts of a sample together.
MOST_CHARS = 16_000_000


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held: int,
    most_rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """(id, label, text), a row an id, of at most ``most_rows`` labelled documents outside the held-out fold.

    Rows are taken in order of a hash of their id, so the sample is the same for
    any partitioning, and as long as their whole texts have ``most_chars``
    characters together; of contradicting labels of one id the larger counts, of
    its different texts the first by code point. Null ids, labels and held-out
    rows are never used. The result is a table in the shared folder.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id"), modulus) != held))
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most_rows)
    texts = pick(docs, id=id_col, text=text_col).filter(F.col("id").isNotNull())
    # the sample's rows are bounded by the parameter, so this side can be sent to every executor
    found = texts.join(F.broadcast(marks), "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = cut(found, "found")
    order = Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id").rowsBetween(Window.unboundedPreceding, 0)
    # of these most_rows rows only ids and lengths meet in one task
    upto = found.select("id", F.sum(F.length("text")).over(order).alias("upto")).filter(F.col("upto") <= most_chars)
    sample = cut(found.join(F.broadcast(upto.select("id")), "id", "left_semi"), "labelled")
    discard(found)
    return sample


def held_out(doc_id, modulus: int, held: int):
    """Whether a row belongs to the held-out fold; a null id does not."""
    return F.coalesce(fold(doc_id, modulus) == held, F.lit(False))
