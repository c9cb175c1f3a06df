"""Boilerplate mining: templates by the number of distinct documents, and samples to review."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SECTIONS
from ..functions.lineage import cut, discard, small, unused
from ..functions.text import normalize_template, seeded_order, sentences, word_count


#: Patterns that a task counts at once, and candidates that are sent to the tasks of the second pass; more are joined by shuffle.
COUNTERS, BROADCAST_CANDIDATES = 1 << 17, 1_000_000
SUMMARY = "h long, n long"


def patterns_of(text: Column, min_words: int) -> Column:
    """array(struct(pos, sent, pattern)) of the sentences that have enough words, as they stand and normalised."""
    each = F.transform(sentences(text), lambda s, i: F.struct(i.alias("pos"), s.alias("sent")))
    long = F.filter(each, lambda x: word_count(x["sent"]) >= min_words)
    normal = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), x["sent"].alias("sent"), normalize_template(x["sent"]).alias("pattern")))
    return F.filter(normal, lambda x: word_count(x["pattern"]) >= min_words)


def heavy_hitters(rows: DataFrame, hashes: str, counters: int = COUNTERS) -> DataFrame:
    """(h, n) summaries of the values in the arrays of ``hashes``, one a task: values in many rows, and how often they were counted.

    A task keeps ``counters`` counts; when it has more, all are lowered by the
    smallest that still fits, and those at nothing are dropped. Values counted once
    are not given at all. What a value was counted too little is told by the row
    without a value: the task's error. Summaries are merged by adding up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, error = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            seen, times = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            merged, place = np.unique(np.concatenate([values, seen]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times]), len(merged)).astype(np.int64)
            values = merged
            if len(values) > counters:
                least = np.partition(counts, -counters - 1)[-counters - 1]
                error += int(least)
                values, counts = values[counts > least], counts[counts > least] - least
        often = counts > 1
        error += int(not often.all())
        yield pa.RecordBatch.from_arrays([pa.array([*values[often].tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), error], pa.int64())], names=["h", "n"])

    return rows.select(hashes).mapInArrow(run, SUMMARY)


def mine_patterns(
    rows: DataFrame, min_docs: int = 25, top: int = 30, min_words: int = 4, doc_col: str = "doc_id", order_col: str = "doc_id", counters: int = COUNTERS
) -> DataFrame:
    """pattern, example, doc_count, doc_coverage, category: the ``top`` most widespread normalised sentences.

    One pass over the texts normalises the sentences and writes hashes of them, 96
    bits and a place each. Summaries of frequent hashes are gathered from these, so that
    rare sentences are not shuffled, and the documents of those candidates are counted
    exactly. No pattern that is not a candidate can be in more documents than the
    summaries' errors allow; if the last of the ``top`` is not above that, all patterns are
    counted instead. Only the texts of the examples are read again. The example is the
    first sentence in order, ties in count go to the template seen first.
    """
    total = rows.agg(F.count_distinct(doc_col).alias("n")).first().n
    doc, order = F.col(doc_col).alias("doc"), F.col(order_col).alias("ord")
    mark = lambda x: F.struct(F.xxhash64(x["pattern"]).alias("h"), F.hash(x["pattern"]).alias("g"), x["pos"].alias("pos"))
    marks = cut(rows.select(doc, order, F.transform(patterns_of(F.col("text"), min_words), mark).alias("marks")), "marks")
    hashes = marks.select(F.array_distinct(F.transform("marks", lambda x: x["h"])).alias("hashes"))
    merged = cut(heavy_hitters(hashes, "hashes", counters).groupBy("h").agg(F.sum("n").alias("n")), "summary")
    error = merged.filter("h IS NULL").agg(F.sum("n").alias("n")).first().n or 0
    known = merged.filter("h IS NOT NULL")
    highest = [r.n for r in known.orderBy(F.desc("n")).limit(top).select("n").collect()]
    least = max(min_docs, highest[-1] if len(highest) == top else 0) - error
    # documents that any pattern can be in that is no candidate
    beyond = error + (known.filter(F.col("n") < least).agg(F.max("n").alias("n")).first().n or 0)
    candidates = cut(known.filter(F.col("n") >= least).select("h"), "candidates")
    each = marks.select("doc", "ord", F.explode("marks").alias("x")).select("doc", "ord", "x.*")
    kept = cut(_widespread(each.join(small(candidates, BROADCAST_CANDIDATES), "h"), min_docs, top), "patterns")
    last = kept.agg(F.count(F.lit(1)).alias("n"), F.min("doc_count").alias("least")).first()
    if beyond >= min_docs and (last.n < top or last.least <= beyond):
        discard(kept)
        kept = cut(_widespread(each, min_docs, top), "patterns")
    asked = kept.select(*[F.col(c).alias(f"k_{c}") for c in ("h", "g", "ord", "pos")], "doc_count")
    # top rows: only the documents that hold an example meet the sentence split again
    held = rows.select(order, "text").join(F.broadcast(asked.groupBy("k_ord").agg(F.collect_list(F.struct("k_h", "k_g", "k_pos", "doc_count")).alias("asked"))), F.col("ord").eqNullSafe(F.col("k_ord")))
    sents = held.select("ord", "asked", F.explode_outer(patterns_of(F.col("text"), min_words)).alias("x"))
    wanted = lambda k: (k["k_pos"] == F.col("x.pos")) & (k["k_h"] == F.xxhash64("x.pattern")) & (k["k_g"] == F.hash("x.pattern"))
    found = sents.select("ord", "x.pos", "x.pattern", "x.sent", F.get(F.filter("asked", wanted), 0)["doc_count"].alias("doc_count")).filter("doc_count IS NOT NULL")
    found = found.groupBy("doc_count", "ord", "pos", "pattern").agg(F.min("sent").alias("example"))
    return found.orderBy(F.desc("doc_count"), "ord", "pos", "pattern").select(
        "pattern",
        "example",
        "doc_count",
        F.round(F.col("doc_count") / F.lit(max(total, 1)), 4).alias("doc_coverage"),
        F.lit("repetitive").alias("category"),
    )


def _widespread(each: DataFrame, min_docs: int, top: int) -> DataFrame:
    """h, g, doc_count, ord, pos of the patterns in most documents: each (pattern, document) is reduced before these are counted."""
    once = each.groupBy("h", "g", "doc").agg(F.min(F.struct("ord", "pos")).alias("first"))
    counted = once.groupBy("h", "g").agg(F.count(F.lit(1)).alias("doc_count"), F.min("first").alias("first"))
    found = counted.filter(F.col("doc_count") >= min_docs).orderBy(F.desc("doc_count"), "first", "h").limit(top)
    return found.select("h", "g", "doc_count", "first.*")


def stratified_sample(
    rows: DataFrame, n: int, seed: int | None = 42, stratum: str = "section", strata: tuple = SECTIONS, id_col: str = "chunk_id"
) -> DataFrame:
    """About ``n`` rows, as many from each stratum. ``seed`` None takes the smallest ids instead of a random order."""
    key = F.col(id_col) if seed is None else seeded_order(F.col(id_col), seed)
    per, place = max(1, n // len(strata)), unused(rows, "place")
    placed = rows.filter(F.col(stratum).isin(*strata)).withColumn(
        place, F.row_number().over(Window.partitionBy(stratum).orderBy(key, id_col))
    )
    return placed.filter(F.col(place) <= per).orderBy(key, id_col).limit(n).drop(place)


def review_counts(reviewed: DataFrame) -> DataFrame:
    """category, n of the reviewed chunks that were marked as boilerplate."""
    return reviewed.filter("is_boilerplate").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
