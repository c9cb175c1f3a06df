"""Embedders: text to unit vectors. The built-in one hashes words; a model plugs in by its ``encode``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.lineage import unused
from ..functions.text import bind, split_words, text_of, with_prefix
from ..functions.vectors import unit


class Embedder(Protocol):
    """Adds a vector column to a table of texts."""

    dimension: int

    def embed(self, df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame: ...


class HashingEmbedder:
    """Feature hashing of lower-cased words with signs, in Column functions only."""

    def __init__(self, dimension: int = 64, normalize: bool = True):
        self.dimension, self.normalize = dimension, normalize

    def vector(self, text: Column) -> Column:
        def place(w: Column) -> Column:
            h = F.xxhash64(w)
            sign = F.when(F.shiftright(h, 40).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
            return F.struct(F.pmod(h, F.lit(self.dimension)).cast("int").alias("slot"), sign.alias("sign"))

        places = F.transform(split_words(F.lower(text)), place)
        add = lambda acc, p: F.transform(acc, lambda x, i: F.when(i == p["slot"], x + p["sign"]).otherwise(x))
        counts = F.aggregate(places, F.array_repeat(F.lit(0.0), self.dimension), add)
        return bind(counts, lambda c: unit(c)) if self.normalize else counts

    def embed(self, df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        return df.withColumn(out, self.vector(F.col(text_col)))


class CharacterEmbedder:
    """Counts of single characters: small, exact, and expressible in any SQL; for tests and diagnostics."""

    def __init__(self, characters: str = "abcdefghijklmnopqrstuvwxyz"):
        self.characters, self.dimension = characters, len(characters)

    def embed(self, df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        def counts(low: Column) -> Column:
            return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in self.characters])

        return df.withColumn(out, bind(F.lower(text_of(F.col(f"`{text_col}`"))), counts))


class ModelEmbedder:
    """Batches through ``load()``'s model, which is loaded once a task; ``encode(list of texts)`` gives a matrix."""

    def __init__(self, load: Callable[[], object], dimension: int, config: EngineConfig, query: bool = False):
        self.load, self.dimension, self.config = load, dimension, config
        self.prefix = config.query_prefix if query else config.passage_prefix

    def embed(self, df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        load, size, normalize, names = self.load, self.config.embedding_batch_size, self.config.normalize_embeddings, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    rows = np.asarray(model.encode(part.column(len(names)).to_pylist()), np.float32)
                    if normalize:
                        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-8)
                    vectors = pa.array(list(rows), pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], vectors], names=[*names, out])

        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<float>"
        prefixed = with_prefix(F.col(f"`{text_col}`"), self.prefix)
        return df.withColumn(unused(df, "text_"), prefixed).mapInArrow(run, schema)
