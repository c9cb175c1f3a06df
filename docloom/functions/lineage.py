"""Tables in the shared folder: durable ends of lineage, and what is built on them."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that ``cut`` has written in this process, in order.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs in one process may leave the setting out; it gets a
    folder below the SQL warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, hint: str) -> str:
    """A path of the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/docloom-{hint}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def cut(df: DataFrame, hint: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a durable table.

    A lost executor then costs a re-read, not a recomputation, and a table that
    is used twice is computed once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, hint)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned, when nothing reads it any more."""
    path = getattr(df, "_docloom_path", None)
    if path is not None:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path in the store that Spark writes to."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files behind results that are tables by now.

    Spark deletes them when the driver collects the plans that made them, which a
    driver with free memory puts off while the disks of the executors fill.
    """
    gc.collect()
    spark._jvm.System.gc()


def sweep(spark: SparkSession, first: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what was written since ``WRITTEN`` had ``first`` entries, but for the table of ``keep``."""
    kept = [p for p in WRITTEN[first:] if keep is not None and p == keep._docloom_path]
    for path in WRITTEN[first:]:
        if path not in kept:
            delete(spark, path)
    WRITTEN[first:] = kept


def small(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """Marked for broadcast if its rows, each counted as ``weight`` or 1, are ``most`` at most; else joined by shuffle.

    The frame is read for the count, so it should be a table that ``cut`` returned.
    """
    if weight is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    return F.broadcast(df) if (df.agg(F.sum(weight).alias("n")).first().n or 0) <= most else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def dense_ids(df: DataFrame, order: list[str], name: str = "chunk_id") -> DataFrame:
    """Ids 0..N-1 in the given order, without gathering the rows in one task.

    Rows are range-partitioned and sorted, numbered within their partition and
    written once; each partition's offset is the count of those before it, the
    only thing that reaches the driver.
    """
    part, row = unused(df, "part"), unused(df, "row")
    placed = cut(
        df.orderBy(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ids",
    )
    offsets, total = [], 0
    for p, n in sorted((r[part], r["count"]) for r in placed.groupBy(part).count().collect()):
        offsets += [F.lit(p), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*offsets), F.col(part)) if offsets else F.lit(0)
    return placed.withColumn(name, (start + F.col(row)).cast("long")).drop(part, row)


def first_by(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; a partial aggregate, so a frequent key is no hot task.

    ``key`` should be short: rows are shuffled under it, and a text among their columns then travels once.
    """
    least = df.groupBy(key.alias("key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("first"))
    return least.select("first.*")
