"""Operator 3: toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled documents is the example set, and every word of
theirs is a term. Document frequencies are counted over the whole corpus. A
term's weight is (1 + log tf) * idf * rf ** 2, where rf = log2(2 + a / max(1, c))
is the relevance frequency of supervised term weighting over the a toxic and c
other examples that hold the term: without it function words and rare words
outweigh the few telling ones. No term is selected or left out.

The unit vectors of the examples are kept in a block-max inverted index: for
every term its postings (example, weight) in blocks of examples, and the largest
weight of each block. A query sums the block maxima into an upper bound of each
block, scores the blocks of the highest bounds exactly, and then those whose
bound reaches the k-th best similarity so far, so the k nearest are exact.
Similarity-weighted votes, shrunk towards the share of the label and passed
through a logistic curve fitted on leave-one-out votes, give the score; the
nearest examples are its evidence.

A score depends on the text alone: equal texts have equal scores whatever their
ids. A text that is an example itself has itself among its neighbours.

Defined results: words no example holds match nothing and are left out of a
query's norm; null and empty texts, and texts without a known word, have no
neighbours: their score is the toxic share of the examples that have none either.
Ties go to the smaller id. Without any usable label every score is 0. Rows that
repeat an id are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick
from .labelled import MOST_CHARS, held_out, labelled_sample

#: Labelled rows that are learned from at most; their texts are bounded by ``labelled.MOST_CHARS``.
MOST_EXAMPLES = 2000
NEIGHBOURS = 15
#: Examples in a block, and blocks that are scored before the first comparison with the bounds.
BLOCK, FIRST_BLOCKS = 128, 2
#: Weight of the label's share beside the neighbours' similarities.
PRIOR_WEIGHT = 0.5
#: The power of the relevance frequency in a term's weight.
RELEVANCE = 2
FOLDS, HELD = 5, 0
TERM = re.compile(r"[^\W\d_]+")
#: Texts up to so many characters whose results a worker remembers, and how many of them.
MEMO_CHARS, MEMO_ENTRIES = 2000, 4_000


def words_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class BlockMaxIndex:
    """Sparse posting lists of unit vectors by term, with the largest weight of each block of rows.

    ``stored`` is the order in which the rows are dealt into blocks: like beside
    like makes bounds tight. It changes no result.
    """

    def __init__(self, terms: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_terms: int, stored: np.ndarray):
        self.stored, self.place = stored, np.argsort(stored)
        rows = self.place[rows]
        order = np.lexsort((rows, terms))
        terms, self.rows, self.weights = terms[order], rows[order].astype(np.int32), weights[order]
        self.n_blocks = -(-len(stored) // BLOCK)
        block = self.rows // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        # an entry is the part of a term's postings that lies in one block
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(terms)))
        self.blocks = block[self.starts]
        self.tops = np.maximum.reduceat(self.weights, self.starts) if len(terms) else np.zeros(0)
        self.first = np.searchsorted(terms[self.starts], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k rows of highest positive inner product: (similarity, row), ties to the smaller row."""
        starts = self.first[terms]
        counts = self.first[terms + 1] - starts
        entries, of = _ranges(starts, counts), np.repeat(weights, counts)
        blocks = self.blocks[entries]
        bounds = np.bincount(blocks, of * self.tops[entries], self.n_blocks)
        scores = np.zeros(self.n_blocks * BLOCK)

        def score(chosen: np.ndarray) -> np.ndarray:
            """Exact scores of the chosen blocks; those of other blocks stay as they are."""
            at = np.flatnonzero(chosen[blocks])
            sizes = self.sizes[entries[at]]
            places = _ranges(self.starts[entries[at]], sizes)
            found = np.bincount(self.rows[places], np.repeat(of[at], sizes) * self.weights[places], len(scores))
            return scores + np.round(found, 12)

        best = np.zeros(self.n_blocks, bool)
        best[np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]] = True
        scores = score(best & (bounds > 0))
        own = self.place[without] if without >= 0 else len(scores)
        scores[own : own + 1] = 0.0
        kth = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        scores = score(~best & (bounds > 0) & (bounds + 1e-9 >= kth))
        scores[own : own + 1] = 0.0
        hits = np.flatnonzero(scores >= max(kth, 1e-12))
        rows = self.stored[hits]
        order = np.lexsort((rows, -scores[hits]))[:k]
        return list(zip(scores[hits][order].tolist(), rows[order].tolist(), strict=True))


class ToxicityModel:
    """What scoring needs: terms with their weights, indexed examples and calibration. Its size is bounded by the sample."""

    def __init__(
        self, ids: list, labels: np.ndarray, terms: list[str], rows: np.ndarray, codes: np.ndarray, counts: np.ndarray,
        df: np.ndarray, n_docs: int,
    ):
        """Examples in order of their ids; (rows, codes, counts) tells how often an example holds a term."""
        self.ids, self.labels = ids, labels.astype(np.float64)
        self.terms = {t: i for i, t in enumerate(terms)}
        toxic = np.bincount(codes, self.labels[rows], len(terms)) if len(rows) else np.zeros(len(terms))
        other = np.bincount(codes, minlength=len(terms)) - toxic
        self.weights = (np.log((1 + n_docs) / (1 + df)) + 1.0) * np.log2(2 + toxic / np.maximum(1, other)) ** RELEVANCE
        raw = (1 + np.log(counts)) * self.weights[codes]
        norms = np.sqrt(np.bincount(rows, raw * raw, len(ids)))
        main = np.zeros(len(ids), np.int64)  # an example's most frequent word tells its language
        order = np.argsort(counts, kind="stable")
        main[rows[order]] = codes[order]
        self.index = BlockMaxIndex(codes, rows, raw / norms[rows], len(terms), np.lexsort((main, self.labels)))
        bare = norms == 0
        self.share = float(self.labels.mean()) if len(ids) else 0.0
        self.bare_share = float((self.labels[bare].sum() + self.share) / (bare.sum() + 1))
        self.memo: dict[tuple, tuple] = {}
        of_row = np.split(np.arange(len(rows)), np.searchsorted(rows, np.arange(1, len(ids)))) if len(ids) else []
        seen = [row for row in range(len(ids)) if not bare[row]]
        votes = [self.vote(self.index.nearest(codes[at], raw[at] / norms[row], NEIGHBOURS, row)) for row, at in ((r, of_row[r]) for r in seen)]
        self.curve = self._calibrate(np.array(votes), self.labels[seen])

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text in order, and their weights; a unit vector."""
        counts = Counter(words_of(text))
        codes = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        order = np.argsort(codes)[np.count_nonzero(codes < 0) :]
        terms = codes[order]
        raw = (1 + np.log(times[order])) * self.weights[terms]
        return terms, raw / math.sqrt(raw @ raw) if len(raw) else raw

    def vote(self, nearest: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in nearest)
        toxic = sum(s * self.labels[row] for s, row in nearest)
        return float((toxic + PRIOR_WEIGHT * self.share) / (total + PRIOR_WEIGHT))

    @staticmethod
    def _logit(p: np.ndarray | float) -> np.ndarray:
        p = np.clip(p, 0.01, 0.99)
        return np.log(p / (1 - p))

    def _calibrate(self, votes: np.ndarray, seen: np.ndarray) -> tuple[float, float]:
        """Slope and offset of a logistic curve over the votes' logits, by damped Newton steps."""
        if len(votes) < 20 or seen.min() == seen.max():
            return 1.0, 0.0
        x = np.stack([self._logit(votes), np.ones(len(votes))])
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-(w @ x)))
            gradient = x @ (p - seen) + 0.5 * (w - [1.0, 0.0])
            hessian = (x * (p * (1 - p))) @ x.T + 0.5 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """(score, evidence); evidence: (similarity, example's row)."""
        if not self.ids:
            return 0.0, []
        key = hash(text)
        known = self.memo.get(key)
        if known is not None and known[0] == text:
            return known[1]
        terms, weights = self.vector(text)
        if len(terms):
            nearest = self.index.nearest(terms, weights, NEIGHBOURS)
            slope, offset = self.curve
            found = 1 / (1 + math.exp(-(slope * float(self._logit(self.vote(nearest))) + offset))), nearest[:3]
        else:
            found = self.bare_share, []
        if len(text or "") <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[key] = (text, found)
        return found


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    most_examples: int = MOST_EXAMPLES,
    most_chars: int = MOST_CHARS,
) -> ToxicityModel:
    """Learn from at most ``most_examples`` labelled rows outside the held-out fold.

    Document frequencies of the examples' words are counted over all documents;
    a task sends one count a word on at most.
    """
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, most_examples, id_col, text_col, most_chars)
    kind = dict(sample.dtypes)["id"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [Counter(words_of(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([list(c) for c in each], pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in each], pa.list_(pa.int64())),
                ],
                names=["id", "label", "terms", "counts"],
            )

    # bounded by the sample's characters
    read = sample.mapInArrow(counts, f"id {kind}, label int, terms array<string>, counts array<long>").toArrow().sort_by("id").combine_chunks()
    discard(sample)
    sizes = pc.list_value_length(read["terms"]).to_numpy().astype(np.int64)
    flat = pa.chunked_array([c.flatten() for c in read["terms"].chunks], pa.string()).combine_chunks()
    times = pa.chunked_array([c.flatten() for c in read["counts"].chunks], pa.int64()).to_numpy()
    coded = flat.dictionary_encode()
    sorting = pc.sort_indices(coded.dictionary)
    found = coded.dictionary.take(sorting).to_pylist()
    place = {t: i for i, t in enumerate(found)}
    codes = np.argsort(sorting.to_numpy())[coded.indices.to_numpy()]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((codes, rows))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df, n = np.zeros(len(known) + 1, np.int64), 0  # the last place is that of words no example holds
        for batch in batches:
            for t in batch.column(0):
                words = set(words_of(t.as_py()))
                df[np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))] += 1
            n += batch.num_rows
        at = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(n, df[at]))], names=["term", "n"])

    totals = pick(docs, text=text_col).mapInArrow(seen_in, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    which, n = totals["term"].to_numpy(), totals["n"].to_numpy()
    df = np.zeros(len(found), np.int64)
    df[which[which >= 0]] = n[which >= 0]
    shared.unpersist()
    marks = np.array([int(x > 0) for x in read["label"].to_pylist()], np.int64)
    return ToxicityModel(read["id"].to_pylist(), marks, found, rows[order], codes[order], times[order], df, int(n[which < 0].sum()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted, evidence (id, label and similarity of the nearest examples)."""
    rows = pick(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["id"]
    evidence = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(1)]
            scores = np.array([s for s, _ in found], np.float64)
            why = [
                [{"id": model.ids[r], "label": int(model.labels[r]), "similarity": s} for s, r in near] for _, near in found
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(why, evidence)],
                names=[id_col, "score", "predicted", "evidence"],
            )

    return rows.mapInArrow(
        run, f"{id_col} {kind}, score double, predicted int, evidence array<struct<id: long, label: int, similarity: double>>"
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fit and score: id, held_out, score, predicted, evidence."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, id_col), id_col)
    return scored.select(id_col, held_out(F.col(id_col), FOLDS, HELD).alias("held_out"), "score", "predicted", "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, whose prediction is not toxic.

    A row is scored and kept or left out where it is read, so no text is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_col, text_col))
    texts = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py())[0] < 0.5 for t in batch.column(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
