"""Inspection of raw decisions: header candidates, ruling cues, detected sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GENERAL
from ..functions.text import strip, text_of
from .sections import explode_sections

HEADER_CANDIDATE = r"(?U)\b([A-ZÇĞİÖŞÜ]{2,}(?:\s+[A-ZÇĞİÖŞÜ]{2,}){0,3})\s*:"
#: Words of a ruling, in lower case.
CUES = (
    "karar veril", "hükmün", "bozulmasına", "onanmasına", "kabulüne",
    "reddine", "mahkumiyet", "beraat", "tazminat", "hüküm kurul",
    "temyiz", "istinaf",
)


def header_candidates(docs: DataFrame, top: int = 30) -> DataFrame:
    """header, n: upper-case words before a colon by occurrences."""
    found = docs.select(F.explode(F.regexp_extract_all(text_of(F.col("text")), F.lit(HEADER_CANDIDATE), F.lit(1))).alias("header"))
    counted = found.groupBy(strip(F.col("header")).alias("header")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "header").limit(top)


def cue_coverage(docs: DataFrame) -> DataFrame:
    """cue, n_docs: documents whose lower-cased text holds the cue; cues without any are left out."""
    cues = F.filter(F.array(*map(F.lit, CUES)), lambda c: F.contains(F.lower(text_of(F.col("text"))), c))
    return docs.select(F.explode(cues).alias("cue")).groupBy("cue").agg(F.count(F.lit(1)).alias("n_docs"))


def section_coverage(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """section, n_docs."""
    return explode_sections(docs, id_col).groupBy("section").agg(F.count_distinct("doc").alias("n_docs"))


def general_only(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents in which no section was detected."""
    only = explode_sections(docs, id_col).groupBy("doc").agg(F.bool_and(F.col("section") == GENERAL).alias("only"))
    return docs.join(only.filter("only").withColumnRenamed("doc", id_col).select(id_col), id_col, "left_semi")
