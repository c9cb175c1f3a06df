"""Reports as text: what the command line prints, each a function from results to lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig
from .operators import chunking, profile
from .sources import io

WIDTH = 100


def table_lines(rows: DataFrame, title: str, most: int = 20) -> list[str]:
    """A title and the first rows of a small table, a line each."""
    return [title, "-" * len(title), *("  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows.limit(most).collect()), ""]


def profile_report(docs: DataFrame, config: EngineConfig) -> list[str]:
    """Size, lengths, histogram, sources, nulls, repeats and broken characters of a table of documents."""
    metrics = io.dataset_metrics(docs).drop("rows_per_second")
    parts = [
        (metrics, "Dataset"),
        (profile.length_stats(docs), "Lengths"),
        (profile.length_histogram(docs).orderBy("bin"), "Histogram of lengths"),
        (profile.null_counts(docs), "Nulls and blanks"),
        (profile.duplicate_count(docs), "Repeated texts"),
        (profile.encoding_count(docs), "Broken characters"),
    ]
    if "source" in docs.columns:
        parts.insert(3, (profile.value_shares(docs, "source").orderBy(F.desc("n"), "source"), "Sources"))
    return [line for rows, title in parts for line in table_lines(rows, title)]


def chunk_report(chunks: DataFrame, n_docs: int) -> list[str]:
    """Numbers of chunks and the shares of sections."""
    return table_lines(chunking.chunk_stats(chunks, n_docs), "Chunks") + table_lines(
        chunking.share_of(chunks, "section").orderBy(F.desc("n"), "section"), "Sections"
    )


def hit_lines(query: str, hits: Iterable[dict], limit: int = 3) -> list[str]:
    """A query and its first hits: rank, scores, section, and the beginning of the text."""
    out = [f"Query: {query}"]
    for h in list(hits)[:limit]:
        text = " ".join((h["text"] or "").split())
        out.append(f"{h['rank']:>3}. [{h['section']}] similarity {h['similarity_score']:.4f}, score {h['final_score']:.4f}, document {h['original_doc_id']}")
        out.append("     " + (text[: WIDTH - 3] + "..." if len(text) > WIDTH else text))
    return out + ([] if len(out) > 1 else ["     no hits"]) + [""]


def sample_lines(chunks: DataFrame, n: int, seed: int = 42, id_col: str = "chunk_id") -> list[str]:
    """A seeded sample of chunks to read through, numbered."""
    rows = profile.sample(chunks, n, seed, id_col).collect()
    out = []
    for i, r in enumerate(rows, 1):
        out += [f"[{i}/{len(rows)}] chunk {r[id_col]}, {r['section']}, document {r['original_doc_id']}", r["text"], ""]
    return out
