"""The corpus pipeline: documents through five stages.

toxicity -> near-duplicates -> benchmark decontamination -> secret scans
-> mixing. Each stage is one operator of ``docloom.llm`` applied to everything
its predecessor kept. ``run`` writes what a stage returns as Parquet to the shared
folder and reads it again as the next stage's documents.

Decisions are made by row, not by id: rows whose id is null or repeated are judged
by their own texts, and rows that differ are never merged. Empty tables, null and
empty texts pass: an empty table gives an empty result, an empty text is neither
toxic nor contaminated, and null, empty and blank texts are copies of each other.
Columns beside those of ``documents`` are left out at the beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WRITTEN, by_rows, cut, read_table, sweep
from docloom.llm.decontamination import find_leaks
from docloom.llm.mixing import mix_sources
from docloom.llm.secrets import redact_secrets
from docloom.llm.similar import similar_groups
from docloom.llm.toxicity import reject_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Keys of rejected rows that are broadcast at once (some 10 MB).
BROADCAST_IDS = 400_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The stage's input with a key of each row, written once so that the keys stay."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "keyed")


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose row is not among the rejected; no text is shuffled, however many these are."""
    rows = cut(rejected.select("row").distinct(), "rejected")
    return by_rows(keyed, rows, "left_anti", BROADCAST_IDS).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not mark as toxic."""
    return reject_toxic(docs, read_table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a five-word shingle similarity of 0.8 or more the row of the smallest id."""
    keyed = _keyed(docs)
    groups = similar_groups(keyed, "row").join(keyed.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = groups.groupBy("group").agg(first.alias("first")).select("first.row")
    return _without(keyed, keyed.select("row").join(kept, "row", "left_anti"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = _keyed(docs)
    return _without(keyed, find_leaks(keyed, read_table(spark, sf_dir, "benchmark"), id_col="row"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark of its kind."""
    return redact_secrets(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: id, source, size, source_size, target, quality, epochs, taken."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: The toxicity stage is a trained model and the near-duplicate stage a fixed point of links: no SQL for run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row for each document that remains."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    first = len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(spark, first, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
