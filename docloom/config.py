"""Engine settings: one frozen object, passed in, never global."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

#: Names of the sections of a decision.
FACTS, LAW, RULING, REASONS, GENERAL = "OYAL", "KANUN", "KARAR", "GEREKÇE", "GENEL"
SECTIONS = (FACTS, LAW, RULING, REASONS, GENERAL)
ATOMIC = (LAW, RULING)

#: Vector width by a part of the model's name, tried in this order.
MODEL_WIDTHS = (("e5-large", 1024), ("e5-base", 768), ("e5-small", 384), ("mpnet", 768), ("minilm", 384))
DEFAULT_WIDTH = 384


#: Folders of a project, below its root.
FOLDERS = ("raw", "clean", "chunks", "vectors", "index", "reports")


def read_env(path: str) -> dict[str, str]:
    """``NAME=value`` lines of an env file; quotes around values, ``export``, blank and # lines are dropped."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("\"'")
    return found


def ensure_dirs(spark, root: str, names: tuple[str, ...] = FOLDERS) -> list[str]:
    """Make the folders of a project in the store that Spark writes to; their paths."""
    paths = [f"{root.rstrip('/')}/{name}" for name in names]
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return paths


def model_width(name: str) -> int:
    """Vector width of an embedding model by its name."""
    low = name.lower()
    return next((width for part, width in MODEL_WIDTHS if part in low), DEFAULT_WIDTH)


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds of every stage. The defaults."""

    sample_size: int = 100_000
    chunk_size: int = 1000
    chunk_overlap: int = 100
    min_text_chars: int = 100
    min_chunk_chars: int = 30
    max_atomic_chars: int = 4000
    dedup_chunks: bool = True
    apply_mined_patterns: bool = False
    st_model_name: str = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"
    embedding_batch_size: int = 32
    normalize_embeddings: bool = True
    top_k: int = 5
    search_candidates: int = 30
    use_section_rerank: bool = False
    benchmark_rel_threshold: float = 0.35
    default_section_weight: float = 1.0
    section_weights: Mapping[str, float] = field(
        default_factory=lambda: {RULING: 2.0, LAW: 1.3, REASONS: 1.0, FACTS: 0.8, GENERAL: 1.0}
    )

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, path: str | None = None) -> EngineConfig:
        """Settings from variables named like the fields, in capitals; absent ones keep their default.

        Variables of an env file at ``path`` count where the environment has none.
        """
        env = os.environ if env is None else env
        env = {**(read_env(path) if path else {}), **env}
        kinds = {"int": int, "float": float, "str": str, "bool": lambda v: v == "1"}
        found = {f.name: kinds[f.type](env[f.name.upper()]) for f in fields(cls) if f.type in kinds and f.name.upper() in env}
        return cls(**found)

    @property
    def embedding_dim(self) -> int:
        return model_width(self.st_model_name)

    @property
    def _needs_prefix(self) -> bool:
        return "e5" in self.st_model_name.lower()

    @property
    def query_prefix(self) -> str:
        return "query: " if self._needs_prefix else ""

    @property
    def passage_prefix(self) -> str:
        return "passage: " if self._needs_prefix else ""

    def summary(self) -> str:
        """The settings, a line each."""
        return "\n".join(f"{f.name:<24} {getattr(self, f.name)}" for f in fields(self)) + f"\n{'embedding_dim':<24} {self.embedding_dim}"

    def section_weight(self, section: str) -> float:
        return self.section_weights.get(section, self.default_section_weight)
