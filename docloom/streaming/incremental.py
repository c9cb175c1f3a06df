"""Incremental ingest: new decision files cleaned and chunked as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..functions.lineage import unused
from ..functions.text import clean_text, fold
from ..operators.chunking import chunk_decisions
from ..operators.cleaning import long_enough


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """A folder's files as a stream, in order of arrival."""
    return spark.readStream.schema(schema).format(kind).load(path)


def clean_stream(docs: DataFrame, config: EngineConfig, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Cleaned decisions of enough length, the first to arrive of each text.

    Without a watermark (time column, delay) the keys of all texts are kept as state.
    """
    cleaned = long_enough(docs.withColumn("text", clean_text(F.col("text"))), config)
    name = unused(docs, "fold_")
    keyed = cleaned.withColumn(name, F.sha2(fold(F.col("text")).cast("binary"), 256))
    if watermark:
        return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark([name]).drop(name)
    return keyed.dropDuplicates([name]).drop(name)


def chunk_batches(
    docs: DataFrame, config: EngineConfig, out: str, checkpoint: str, id_col: str = "doc_id", once: bool = True
) -> StreamingQuery:
    """Chunks of every micro-batch written below ``out``, a folder a batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_decisions(batch, config, id_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
