"""Incremental ingest to a vector index: arriving decisions cleaned, reduced to the first of equal texts, embedded, appended.

The first of equal texts is the one of the smallest ``doc_ord``, as in the batch
pipeline, and not the one that arrives first. State is kept by text digest: it
holds the smallest order seen so far. A row that comes late and stands before it
takes its place: it goes on together with the order that it replaces, and the index
takes that one back. So whatever the order of arrival, the index ends as the batch
result.

State can be given a time-out. A text that arrives again after it is taken for a new
one; without a time-out the digests of all texts are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import EngineConfig
from ..functions.text import clean_text
from ..operators.cleaning import long_enough
from ..operators.embedding import Embedder
from ..operators.index import VectorIndex

#: The only state store with typed state variables.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FIRSTS = "digest string, doc_ord long, text string, replaced long"


class FirstByOrder(StatefulProcessor):
    """State of a digest: the smallest order of its rows. Gives a row whenever that becomes smaller."""

    def __init__(self, time_out_ms: int | None = None):
        self.time_out_ms = time_out_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "doc_ord long", self.time_out_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        least = min(rows, key=lambda r: r.doc_ord)
        known = self.first.get()
        if known is None or least.doc_ord < known[0]:
            self.first.update((least.doc_ord,))
            yield Row(digest=least.digest, doc_ord=least.doc_ord, text=least.text, replaced=known and known[0])

    def close(self) -> None:
        pass


def _first_of_each_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch the first row of each digest, so a frequent text reaches its key's task once a batch."""
    for batch in batches:
        rows = pa.table({"digest": batch.column(0), "doc_ord": batch.column(1), "place": pa.array(range(batch.num_rows), pa.int64())})
        order = rows.sort_by([("digest", "ascending"), ("doc_ord", "ascending")])
        first = order.group_by("digest", use_threads=False).aggregate([("place", "first")])
        yield batch.take(first.column("place_first").combine_chunks())


def first_texts(docs: DataFrame, config: EngineConfig, order_col: str = "doc_ord", text_col: str = "text", time_out: str | None = None) -> DataFrame:
    """digest, doc_ord, text, replaced: a stream of the cleaned decisions that are the first of their text so far.

    ``replaced`` is the order of the row that was the first until now, if there was
    one. Rows without an order or a text, or shorter than ``min_text_chars``, are left
    out. ``time_out`` is an interval such as ``7 days``, counted from a digest's last change.
    """
    rows = docs.select(F.col(f"`{order_col}`").cast("long").alias("doc_ord"), F.col(f"`{text_col}`").alias("text"))
    # no replacement lengthens a text
    rows = rows.filter(F.col("doc_ord").isNotNull() & (F.length("text") >= config.min_text_chars))
    rows = long_enough(rows.withColumn("text", clean_text(F.col("text"))), config)
    keyed = rows.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "doc_ord", "text")
    reduced = keyed.mapInArrow(_first_of_each_batch, "digest string, doc_ord long, text string")
    wait = None if time_out is None else int(pd.Timedelta(time_out).total_seconds() * 1000)
    return reduced.groupBy("digest").transformWithState(
        FirstByOrder(wait), FIRSTS, "update", "none" if wait is None else "processingTime"
    )


def index_batches(
    docs: DataFrame,
    config: EngineConfig,
    embedder: Embedder,
    index: VectorIndex,
    checkpoint: str,
    order_col: str = "doc_ord",
    text_col: str = "text",
    time_out: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Embed the first texts of every micro-batch and append them to the index; a batch that is repeated replaces itself.

    A vector's ``chunk_id`` is its decision's order. The vectors of a batch are written
    below the index first, so that the state is asked and a text is embedded once.
    """
    spark, firsts = docs.sparkSession, f"{index.path}/firsts"

    def write(batch: DataFrame, number: int) -> None:
        at = f"{firsts}/batch={number + 1}"
        made = embedder.embed(batch.select("digest", F.col("doc_ord").alias("chunk_id"), "replaced", "text")).drop("text")
        made.write.mode("overwrite").parquet(at)
        rows = batch.sparkSession.read.schema(made.schema).parquet(at)
        gone = rows.filter("replaced IS NOT NULL").select(F.col("replaced").alias("chunk_id"))
        index.append(rows, number + 1, keep=("digest",), gone=gone)

    # with a time-out Spark would plan batches without data for ever, and a run that should end would not
    settings = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(not once).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        first = first_texts(docs, config, order_col, text_col, time_out)
        writer = first.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        # the query has its own copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_arrivals(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder's Parquet files as a stream, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
