"""Chunks: sentences packed with overlap, atomic sections, and the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ATOMIC, EngineConfig
from ..functions.lineage import cut, dense_ids, first_by
from ..functions.text import bind, fold, sentences, strip, text_of
from .sections import explode_sections, extract_sections


def pack(col: Column, size: int, overlap: int) -> Column:
    """Array of chunks of at most ``size`` characters on sentence borders.

    A full chunk's last ``overlap`` characters begin the next one. A piece longer
    than ``size`` is cut at every ``size - overlap`` characters, in closed form.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("cur"))

    def flush(acc: Column, nxt: Column) -> Column:
        done = F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        cuts = F.greatest(F.lit(0), F.ceil((F.length(nxt) - size) / step)).cast("int")

        def cut(n: Column) -> Column:
            pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(nxt, i * step + 1, F.lit(size)))
            out = F.when(n > 0, F.concat(done, pieces)).otherwise(done)
            return F.struct(out.alias("out"), F.substring(nxt, n * step + 1, F.length(nxt)).alias("cur"))

        return bind(cuts, cut)

    def add(acc: Column, s: Column) -> Column:
        cur = acc["cur"]
        fits = F.length(cur) + F.length(s) + 1 <= size
        tail = F.right(cur, F.lit(overlap)) if overlap else F.lit("")
        joined = F.struct(acc["out"].alias("out"), F.trim(F.concat(cur, F.lit(" "), s)).alias("cur"))
        return F.when(fits, joined).otherwise(bind(F.trim(F.concat(tail, F.lit(" "), s)), lambda nxt: flush(acc, nxt)))

    end = lambda acc: F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    def packed(text: Column) -> Column:
        whole = F.when(text == "", none).when(F.length(text) <= size, F.array(text))
        return whole.otherwise(F.aggregate(sentences(text), start, add, end))

    return bind(strip(text_of(col)), packed)


def chunk_decisions(docs: DataFrame, config: EngineConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, sec_ord, piece_ord, section, text, is_atomic: the chunks of each decision in order.

    Law and ruling are one chunk up to ``max_atomic_chars``; everything else is
    packed, and pieces shorter than ``min_chunk_chars`` are dropped.
    """
    rows = explode_sections(docs, id_col, text_col).withColumn("text", strip(F.col("text"))).filter("text <> ''")
    atomic = F.col("section").isin(*ATOMIC) & (F.length("text") <= config.max_atomic_chars)
    rows = rows.withColumn("is_atomic", atomic).withColumn(
        "pieces", F.when(atomic, F.array("text")).otherwise(pack(F.col("text"), config.chunk_size, config.chunk_overlap))
    )
    each = rows.select("doc", "sec_ord", "section", "is_atomic", F.posexplode_outer("pieces").alias("piece_ord", "piece"))
    each = each.filter("piece IS NOT NULL").withColumn("text", strip(F.col("piece")))
    kept = each.filter(F.col("is_atomic") | (F.length("text") >= config.min_chunk_chars))
    return kept.select("doc", "sec_ord", "piece_ord", "section", "text", "is_atomic")


def with_pieces(docs: DataFrame, config: EngineConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text, pieces: each decision with the texts of its chunks, which ``chunk_decisions`` gives as rows."""
    found = extract_sections(docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")))

    def pieces(section: Column, text: Column) -> Column:
        atomic = section.isin(*ATOMIC) & (F.length(text) <= config.max_atomic_chars)
        each = F.when(atomic, F.array(text)).otherwise(F.transform(pack(text, config.chunk_size, config.chunk_overlap), strip))
        return F.filter(each, lambda p: (p != "") & (atomic | (F.length(p) >= config.min_chunk_chars)))

    every = F.transform("sections", lambda s: bind(strip(s["text"]), lambda t: pieces(s["section"], t)))
    return found.select("doc", "text", F.flatten(every).alias("pieces"))


def chunk_table(docs: DataFrame, config: EngineConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunk table: copies (case folded) reduced to their first, ids dense in order after that."""
    chunks = chunk_decisions(docs, config, id_col, text_col)
    order = ["doc", "sec_ord", "piece_ord"]
    if config.dedup_chunks:
        chunks = first_by(chunks, F.sha2(fold(F.col("text")).cast("binary"), 256), order)
    return dense_ids(chunks, order).select(
        "chunk_id",
        "text",
        "section",
        F.col("doc").cast("string").alias("original_doc_id"),
        F.length("text").alias("length"),
        "is_atomic",
    )


def chunk_stats(chunks: DataFrame, n_docs: int | Column) -> DataFrame:
    """One row: chunks, atomic and split chunks, chunks per document, lengths (sample deviation)."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if("is_atomic").alias("n_atomic"),
        F.count_if(~F.col("is_atomic")).alias("n_split"),
        F.round(F.try_divide(F.count(F.lit(1)), n), 6).alias("per_doc"),
        F.min("length").cast("long").alias("min_len"),
        F.max("length").cast("long").alias("max_len"),
        F.round(F.avg("length"), 6).alias("mean_len"),
        F.round(F.stddev_samp("length"), 6).alias("std_len"),
    )


def share_of(df: DataFrame, col: str) -> DataFrame:
    """value, n, pct: frequency of each value, null as ``<null>``."""
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("<null>")).alias(col)).agg(F.count(F.lit(1)).alias("n"))
    # written once: a row a value, so that the rows themselves are made once
    counts = cut(counts, "counts")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.lit(max(total, 1)), 6))
