"""The batch pipeline from raw decisions to a searchable chunk table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.chunking import chunk_table
from ..operators.cleaning import clean_filter_dedup
from ..operators.embedding import Embedder
from ..operators.patterns import select_patterns
from ..operators.search import SearchEngine
from ..operators.validate import check_invariants, general_rate
from ..sources.io import head, join_vectors, materialise, read_decisions, read_patterns


class InvalidChunks(ValueError):
    """The chunk table breaks an invariant, or hardly any section was detected."""


def build(spark: SparkSession, raw: str, out: str, embedder: Embedder, config: EngineConfig, kind: str = "parquet") -> SearchEngine:
    """Ingest, clean, chunk, check, embed. Each stage is written below ``out`` once, and again when its settings or its input change."""
    patterns = select_patterns(read_patterns(spark, f"{out}/patterns.json"), config.apply_mined_patterns)
    settings = asdict(config)

    def stage(name: str, source: str, make: Callable[[], DataFrame], **more: object) -> DataFrame:
        return materialise(spark, f"{out}/{name}", make, settings | more, [source])

    decisions = stage("decisions", raw, lambda: head(read_decisions(spark, raw, kind), config.sample_size), kind=kind)
    clean = stage("clean", f"{out}/decisions", lambda: clean_filter_dedup(decisions, config, patterns, "doc_ord"), patterns=patterns)
    chunks = stage("chunks", f"{out}/clean", lambda: chunk_table(clean, config, "doc_ord"))
    check(chunks, config)
    embed = lambda: embedder.embed(chunks.select("chunk_id", "text")).select("chunk_id", "embedding")
    vectors = stage("vectors", f"{out}/chunks", embed, embedder=type(embedder).__name__, dimension=embedder.dimension)
    return SearchEngine(join_vectors(chunks, vectors), embedder, config)


def check(chunks: DataFrame, config: EngineConfig, most_general: float = 90.0) -> None:
    """Raise if an invariant is broken or more than ``most_general`` percent of decisions have no section."""
    broken = check_invariants(chunks, config).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()
    rate = general_rate(chunks).first().pct
    if broken or rate > most_general:
        raise InvalidChunks(f"{ {r.rule: r.n for r in broken} }, {rate} % without sections")
