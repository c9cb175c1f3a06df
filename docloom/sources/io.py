"""Sources and sinks: decisions by alias, query lists, pattern and report files, stage outputs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import unused
from ..functions.text import strip
from ..schemas import ALIASES, DECISION, PATTERNS, TEST_QUERIES


class MissingInput(FileNotFoundError):
    """An input that an earlier stage should have written is not there."""


class RowMismatch(ValueError):
    """Two tables that should hold the same keys do not."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the store that Spark would read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def require(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if not exists(spark, path):
            raise MissingInput(path)


def map_columns(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Canonical columns, each from its first alias that is present and not null, else empty; and ``doc_ord``.

    File order is no column in Spark: pass ``order``, or ids in reading order are given.
    """
    pick = lambda names: F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in df.columns], F.lit(""))
    return df.select(
        (F.monotonically_increasing_id() if order is None else order).cast("long").alias("doc_ord"),
        *[pick(names).alias(name) for name, names in ALIASES.items()],
    )


def head(df: DataFrame, n: int, order: str = "doc_ord") -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(order).limit(n)


def first_files(spark: SparkSession, path: str, n: int) -> tuple[list[tuple[str, int]], int]:
    """The Parquet files, by name, that hold the first ``n`` rows, with their row counts; and how many files were asked.

    Counts come from the files' footers, of one file first and of four times as many each
    time more are needed, as Spark's own ``take`` does with partitions. Files after those
    are listed but not opened.
    """
    files = sorted(spark.read.parquet(path).inputFiles())
    found: list[tuple[str, int]] = []
    asked, step = 0, 1
    while asked < len(files) and sum(c for _, c in found) < n:
        rows = spark.read.parquet(*files[asked : asked + step]).groupBy(F.col("_metadata.file_path").alias("file")).count()
        found += sorted((r["file"], r["count"]) for r in rows.collect())  # a row a file
        asked, step = asked + step, step * 4
    held, kept = 0, []
    for file, count in found:
        if held >= n:
            break
        kept.append((file, count))
        held += count
    return kept, min(asked, len(files))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows of a Parquet table in reading order (files by name, rows as they stand), and ``doc_ord`` from 0.

    Only the files that hold them are read, in parallel and without a sort; the last one is cut by
    its row numbers. A table of fewer rows is read whole, none are asked for with n <= 0.
    """
    kept, _ = first_files(spark, path, n)
    schema = spark.read.parquet(path).schema
    if not kept:
        return spark.createDataFrame([], schema.add("doc_ord", "long"))
    starts, before = [], 0
    for file, count in kept:
        starts.append((file, before))
        before += count
    rows = spark.read.schema(schema).parquet(*[file for file, _ in kept])
    name, place = unused(rows, "file"), unused(rows, "place")
    rows = rows.select("*", F.col("_metadata.file_path").alias(name), F.col("_metadata.row_index").alias(place))
    offsets = spark.createDataFrame(starts, f"{name} string, doc_ord long")
    ordinal = F.col("doc_ord") + F.col(place)
    placed = rows.drop("doc_ord").join(F.broadcast(offsets), name).withColumn("doc_ord", ordinal)  # a row a file
    return placed.filter(F.col("doc_ord") < n).drop(name, place)


def read_decisions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Raw decisions from parquet, csv (quoted line breaks allowed) or json, under their canonical names."""
    require(spark, path)
    if kind == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raw = spark.read.format(kind).load(path)
    return map_columns(raw)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = DECISION) -> DataFrame:
    """A CSV table of a stated schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def parse_queries(lines: DataFrame) -> DataFrame:
    """``value`` lines of ``query | keyword, keyword`` -> query, keywords (lower case); blank and # lines are no queries."""
    line = strip(F.col("value"))
    parts = F.split(line, r"\|", 2)
    words = F.transform(F.split(F.coalesce(F.get(parts, 1), F.lit("")), ","), lambda k: F.lower(strip(k)))
    return lines.filter((line != "") & ~F.startswith(line, F.lit("#"))).select(
        *[c for c in lines.columns if c != "value"],
        strip(F.get(parts, 0)).alias("query"),
        F.filter(words, lambda k: k != "").alias("keywords"),
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id (in file order), query, keywords of a query list; the file is read whole, its lines numbered."""
    require(spark, path)
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("query_id", "value"))
    return parse_queries(lines.withColumn("query_id", F.col("query_id").cast("long")))


def read_test_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, query, topic, expected_keywords of a JSON query file."""
    require(spark, path)
    return spark.read.schema(TEST_QUERIES).option("multiLine", True).json(path).select(F.inline("queries"))


def read_patterns(spark: SparkSession, path: str) -> dict:
    """Content of a pattern file; a missing or broken one is empty."""
    if not exists(spark, path):
        return {}
    row = spark.read.schema(PATTERNS).option("multiLine", True).option("mode", "PERMISSIVE").json(path).first()
    return {k: v or [] for k, v in row.asDict(recursive=True).items()} if row else {}


def write_json(df: DataFrame, path: str) -> None:
    """Metadata, reports and patterns: small tables as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_patterns(spark: SparkSession, content: dict, path: str) -> None:
    """A pattern file that ``read_patterns`` takes."""
    row = {k: content.get(k) or [] for k in PATTERNS.fieldNames()}
    write_json(spark.createDataFrame([row], PATTERNS), path)


#: File of a stage output that says what it was made of; Spark's readers pass it over.
MANIFEST = "_manifest.json"


def fingerprint(spark: SparkSession, settings: Mapping, inputs: Iterable[str] = ()) -> str:
    """Digest of settings and of the inputs' paths, sizes and times."""
    found = []
    for path in inputs:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        size = store.getContentSummary(hadoop)
        found.append([path, size.getFileCount(), size.getLength(), store.getFileStatus(hadoop).getModificationTime()])
    return sha256(json.dumps([dict(settings), found], sort_keys=True, default=str).encode()).hexdigest()


def read_manifest(spark: SparkSession, path: str) -> dict:
    """What a stage output was made of; empty if there is none, or it was not written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return {}
    file = store.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    except json.JSONDecodeError:
        return {}
    finally:
        file.close()


def write_manifest(spark: SparkSession, path: str, content: Mapping) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    file = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        file.write(bytearray(json.dumps(dict(content), sort_keys=True).encode()))
    finally:
        file.close()


def materialise(
    spark: SparkSession, path: str, make: Callable[[], DataFrame], settings: Mapping | None = None, inputs: Iterable[str] = ()
) -> DataFrame:
    """The table at ``path``; it is made and written only where it is not there whole, of these settings and inputs.

    The manifest is written after the table, and goes with it when the table is
    written again. So a folder that a failed write has left, one made under other
    settings, or one whose inputs have changed since, is made again.
    """
    made_of = fingerprint(spark, settings or {}, inputs)
    if read_manifest(spark, path).get("made_of") != made_of:
        make().write.mode("overwrite").parquet(path)
        write_manifest(spark, path, {"made_of": made_of})
    return spark.read.parquet(path)


def join_vectors(chunks: DataFrame, vectors: DataFrame, strict: bool = True) -> DataFrame:
    """Chunks with their ``embedding`` by chunk_id; keys without partner raise, or are left out if not ``strict``."""
    if strict:
        left = chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti").limit(1).count()
        right = vectors.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti").limit(1).count()
        if left or right:
            raise RowMismatch("chunks and vectors do not hold the same chunk ids")
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id")


def dataset_metrics(docs: DataFrame, text_col: str = "text", seconds: float | None = None) -> DataFrame:
    """One row: rows, UTF-8 bytes and megabytes of the texts, and rows a second if it is told how long they took."""
    size = F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).cast("long")
    row = docs.agg(F.count(F.lit(1)).alias("n_rows"), size.alias("n_bytes"))
    rate = F.round(F.col("n_rows") / F.lit(seconds), 3) if seconds else F.lit(None).cast("double")
    return row.select("*", F.round(F.col("n_bytes") / 1e6, 3).alias("megabytes"), rate.alias("rows_per_second"))


def metadata(vectors: DataFrame, model: str, normalized: bool, date: str) -> DataFrame:
    """One row: total_chunks, dimension, model, normalized, date."""
    return vectors.agg(F.count(F.lit(1)).alias("total_chunks"), F.max(F.size("embedding")).alias("dimension")).select(
        "*", F.lit(model).alias("model"), F.lit(normalized).alias("normalized"), F.lit(date).alias("date")
    )
