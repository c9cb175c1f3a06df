"""NumPy ``.npy`` matrices as a Spark data source: read by row ranges, written in parts.

``register(spark)`` makes the format ``npy`` known. Reading gives ``row`` (long, from
0 over all files) and ``vector``; a file is cut into ranges of rows, each a
partition that seeks to its first byte, so no file is whole in one task. The
path is one file, or a folder: its parts by the manifest, without one its
``.npy`` files by name. Writing takes a frame whose only array column is the
vector and keeps the frame's order: every task writes its rows as parts of
bounded size that NumPy can load one by one, and the manifest, written last,
names the parts that count. What a failed or repeated task has left is not in it.

Files are opened by pyarrow: local and mounted paths, and the schemes it knows
(hdfs, s3, gs, abfs). ``save_vectors`` and ``load_vectors`` keep the ids beside.

Defined results: one-dimensional arrays are vectors of one entry; two-byte
floats widen to four bytes; Fortran order, more dimensions, other kinds of
entries, null vectors or entries, and vectors of different widths raise
``ValueError``; an empty frame is a folder of no parts.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npf
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

from ..functions.lineage import dense_ids
from .io import RowMismatch

MANIFEST = "_parts.json"
#: Bytes of a partition that is read, of a part that is written, of a block in between.
PARTITION_BYTES, PART_BYTES, BLOCK_BYTES = 64 << 20, 256 << 20, 8 << 20
#: Kinds of entries and the Spark types that hold them.
KINDS = {"f2": "float", "f4": "float", "f8": "double", "i4": "int", "i8": "bigint"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part:
    """A file of the matrix."""

    path: str
    rows: int
    width: int
    dtype: str
    #: Bytes before the first row; None until the file is opened.
    start: int | None = None


def header(store: fs.FileSystem, path: str) -> Part:
    """What the header of a file says."""
    with store.open_input_file(path) as file:
        version = npf.read_magic(file)
        read = {(1, 0): npf.read_array_header_1_0, (2, 0): npf.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: version {version} of the format is not read")
        shape, fortran, dtype = read(file)
        start = file.tell()
    if len(shape) not in (1, 2) or dtype.str[1:] not in KINDS or fortran and min(shape) > 1:
        raise ValueError(f"{path}: {dtype} of shape {shape}{' in Fortran order' if fortran else ''} is no table of vectors")
    return Part(path, shape[0], shape[1] if len(shape) == 2 else 1, dtype.str, start)


def manifest_of(store: fs.FileSystem, path: str) -> dict | None:
    at = f"{path}/{MANIFEST}"
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as file:
        return json.loads(file.read())


def parts_of(path: str) -> tuple[list[Part], str]:
    """The files in order, and the kind of their entries."""
    store, at = store_of(path)
    kind = store.get_file_info(at).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == fs.FileType.File:
        parts = [header(store, at)]
    elif (found := manifest_of(store, at)) is not None:
        return [Part(f"{at}/{name}", rows, found["width"], found["dtype"]) for name, rows in found["parts"]], found["dtype"]
    else:
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".npy"))
        if not names:
            raise FileNotFoundError(f"{path} holds no .npy file and no manifest")
        parts = [header(store, name) for name in names]
    if len({(p.width, p.dtype) for p in parts}) > 1:
        raise ValueError(f"{path}: files of different widths or kinds")
    return parts, parts[0].dtype


@dataclass
class Rows(InputPartition):
    """Rows ``low`` to ``high`` of a part, whose first row has the number ``first``."""

    part: Part
    low: int
    high: int
    first: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Rows]:
        found, first = [], 0
        for part in parts_of(self.path)[0]:
            step = max(1, self.size // max(1, part.width * np.dtype(part.dtype).itemsize))
            found += [Rows(part, low, min(low + step, part.rows), first) for low in range(0, part.rows, step)]
            first += part.rows
        return found or [Rows(Part("", 0, 0, "<f4", 0), 0, 0, 0)]

    def read(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        part = rows.part
        if rows.low == rows.high:
            return
        store, _ = store_of(self.path)
        dtype = np.dtype(part.dtype)
        entry = np.float32 if dtype.itemsize == 2 else dtype.newbyteorder("=")
        wide = part.width * dtype.itemsize
        start = header(store, part.path).start if part.start is None else part.start
        step = max(1, BLOCK_BYTES // max(1, wide))
        with store.open_input_file(part.path) as file:
            file.seek(start + rows.low * wide)
            for low in range(rows.low, rows.high, step):
                n = min(step, rows.high - low)
                block = file.read(n * wide)
                if len(block) < n * wide:
                    raise ValueError(f"{part.path} ends before row {low + n}")
                flat = pa.array(np.frombuffer(block, dtype).astype(entry, copy=False))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), flat)
                numbers = pa.array(np.arange(rows.first + low, rows.first + low + n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([numbers, vectors], names=["row", "vector"])


@dataclass
class Written(WriterCommitMessage):
    task: int
    #: Name and rows of each part.
    parts: list[tuple[str, int]]
    width: int | None


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        arrays = [(i, f.dataType) for i, f in enumerate(schema) if isinstance(f.dataType, ArrayType)]
        kinds = {name: f"<{kind}" for kind, name in KINDS.items()}
        if len(arrays) != 1 or arrays[0][1].elementType.simpleString() not in kinds:
            raise ValueError(f"one array column of {sorted(kinds)} is written, not {schema.simpleString()}")
        self.path, self.column, self.overwrite = path, arrays[0][0], overwrite
        self.dtype = "<f4" if arrays[0][1].elementType.simpleString() == "float" else kinds[arrays[0][1].elementType.simpleString()]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        done = Written(task, [], None)
        held: list[np.ndarray] = []

        def flush() -> None:
            rows = sum(map(len, held))
            if rows:
                name = f"part-{task:06d}-{len(done.parts):05d}-{attempt}.npy"
                top = io.BytesIO()
                npf.write_array_header_1_0(top, {"descr": self.dtype, "fortran_order": False, "shape": (rows, done.width)})
                with store.open_output_stream(f"{at}/{name}") as file:
                    file.write(top.getvalue())
                    for block in held:
                        file.write(block.tobytes())
                done.parts.append((name, rows))
                held.clear()

        for batch in iterator:
            vectors = batch.column(self.column)
            flat = vectors.flatten()
            sizes = set(vectors.value_lengths().to_pylist())
            if vectors.null_count or flat.null_count:
                raise ValueError("a vector or an entry is null")
            if len(sizes | ({done.width} - {None})) > 1:
                raise ValueError("vectors of different widths")
            for done.width in sizes:
                step = max(1, PART_BYTES // max(1, done.width * np.dtype(self.dtype).itemsize))
                block = flat.to_numpy(zero_copy_only=False).astype(self.dtype, copy=False).reshape(len(vectors), done.width)
                while len(block):
                    room = step - sum(map(len, held))
                    held.append(block[:room])
                    block = block[room:]
                    if room == len(held[-1]):
                        flush()
        flush()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        old = manifest_of(store, at)
        found = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        parts = [list(p) for m in found for p in m.parts]
        widths = {m.width for m in found} - {None}
        if old and not self.overwrite:
            parts = old["parts"] + parts
            widths |= {old["width"]} if old["parts"] else set()
            if old["dtype"] != self.dtype:
                raise ValueError(f"{self.path} holds {old['dtype']}, not {self.dtype}")
        if len(widths) > 1:
            raise ValueError("vectors of different widths")
        with store.open_output_stream(f"{at}/{MANIFEST}") as file:
            file.write(json.dumps({"dtype": self.dtype, "width": max(widths, default=0), "parts": parts}).encode())
        if old and self.overwrite:
            for name, _ in old["parts"]:
                store.delete_file(f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        for name in (name for m in messages if m is not None for name, _ in m.parts):
            store.delete_file(f"{at}/{name}")


class NpySource(DataSource):
    """Format ``npy``. Option ``partitionBytes``: bytes of a partition that is read."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"row long, vector array<{KINDS[parts_of(self.options['path'])[1][1:]]}>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def read_npy(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """row, vector of a matrix."""
    register(spark)
    return spark.read.format("npy").option("partitionBytes", partition_bytes).load(path)


def write_npy(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The array column of ``df`` as a matrix, in the frame's order."""
    register(df.sparkSession)
    df.write.format("npy").mode(mode).save(path)


def save_vectors(vectors: DataFrame, path: str, id_col: str = "chunk_id", column: str = "embedding") -> None:
    """A matrix in the order of the ids, and beside it the table (row, id) that tells which row is whose."""
    picked = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").alias("vector"))
    numbered = dense_ids(picked, ["id"], "line")
    write_npy(numbered.orderBy("line").select("vector"), f"{path}/matrix")
    numbered.select(F.col("line").alias("row"), F.col("id").alias(id_col)).write.mode("overwrite").parquet(f"{path}/ids")


def load_vectors(spark: SparkSession, path: str, id_col: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """row, id and vector of what ``save_vectors`` wrote; a matrix of more or fewer rows than ids raises."""
    ids, matrix = spark.read.parquet(f"{path}/ids"), read_npy(spark, f"{path}/matrix")
    have, named = sum(p.rows for p in parts_of(f"{path}/matrix")[0]), ids.count()
    if have != named:
        raise RowMismatch(f"{have} rows in the matrix, {named} ids")
    return ids.join(matrix, "row").select("row", id_col, F.col("vector").alias(column))
