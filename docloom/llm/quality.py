"""Operator 6: document quality by supervised subword embeddings.

A document is the bag of its hashed features: every word, every 3- and
4-character n-gram inside a word and its borders, and every immediate repeat of a
word. Each feature owns a learned vector; a document is the average of its
features' vectors, and a softmax layer turns the average into label
probabilities. Vectors and layer are trained together by stochastic gradient
descent in numpy over a bounded sample of labelled rows.

Both layers being linear in the features, a trained model collapses into one
number a feature bucket, so scoring is hashing and one table look-up a feature,
vectorised over blocks of text. Blocks end at white space, and the last word of a
block is carried to the next, so blocks change no feature; memory does not grow
with the text.

Defined results: null, empty and blank texts have no features and get the
model's bias, the log-odds of the label in the sample; without usable labels
every score is 0.5; rows that repeat an id are scored one by one, and of a labelled
id's different texts the first by code point is learned from; a run of
``BLOCK_CHARS`` characters without white space is cut there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick
from .labelled import held_out, labelled_sample

#: Bounds and settings of what is learned.
MOST_EXAMPLES, MOST_CHARS = 4000, 10_000_000
BUCKET_BITS = 17
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
NGRAMS = (3, 4)
SEED = 7
FOLDS, HELD = 3, 1
#: Characters that are hashed at a time.
BLOCK_CHARS = 1 << 18
#: Odd multipliers of the hashes.
MIX = {3: np.uint32(2654435761), 4: np.uint32(2246822519), 0: np.uint32(3266489917)}
STEP = 1_000_003
#: The bucket of the word pair "the same word twice", whichever word it is.
REPEATED = np.uint32(0)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    if n > 1:
        out[1:] = np.uint32(STEP)
        np.multiply.accumulate(out, out=out)
    return out


POWERS = _powers(4096)
#: The characters that separate words.
SPACES = " \t\n\v\f\r"


def feature_buckets(text: str, before: int = -1) -> tuple[np.ndarray, int]:
    """Buckets of all features of a block, in no particular order, and the hash of its last word.

    ``before`` is the hash of the word before the block, if there is one.
    """
    raw = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw = np.where(blank, np.uint32(32), raw)
    shift = np.uint32(32 - BUCKET_BITS)
    found = []
    for n in NGRAMS:
        if len(raw) < n:
            continue
        size = len(raw) - n + 1
        gram = raw[:size].copy()
        for k in range(1, n):
            gram *= np.uint32(STEP)
            gram += raw[k : k + size]
        inside = np.zeros(size, bool)
        for k in range(1, n - 1):
            inside |= blank[k : k + size]
        # of the borders one may be blank: it marks the beginning or end of a word
        keep = ~(inside | (blank[:size] & blank[n - 1 :]))
        gram = gram[keep] * MIX[n]
        found.append((gram ^ (gram >> np.uint32(15))) * np.uint32(STEP) >> shift)
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if len(starts):
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(raw)]])))
        part = np.where(blank, np.uint32(0), raw) * POWERS[place % len(POWERS)]
        word = np.add.reduceat(part, starts, dtype=np.uint32) * MIX[0] + (ends - starts).astype(np.uint32)
        found.append((word ^ (word >> np.uint32(16))) * MIX[0] >> shift)
        # a word that repeats the one before it: one feature for all words
        repeats = np.count_nonzero(word[1:] == word[:-1]) + (int(word[0]) == before)
        found.append(np.full(repeats, REPEATED, np.uint32))
        before = int(word[-1])
    return np.concatenate(found) if found else np.zeros(0, np.uint32), before


def blocks_of(text: str | None, most: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in blocks of ``most`` characters at most, cut at white space where there is any."""
    text, at = text or "", 0
    while len(text) - at > most:
        end = max(text.rfind(s, at + 1, at + most) for s in SPACES)
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all features of a whole text, block by block."""
    before = -1
    for block in blocks_of(text):
        found, before = feature_buckets(block, before)
        yield found


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, occurrences) of a whole text."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for found in features(text):
        total += np.bincount(found, minlength=len(total))
    rows = np.flatnonzero(total)
    return rows.astype(np.int32), total[rows].astype(np.int32)


class QualityModel:
    """One weight a bucket and a bias: the difference of the two labels' logits."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    @classmethod
    def train(cls, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> QualityModel:
        """Stochastic gradient descent over single documents with a linearly falling rate."""
        n = len(labels)
        if n == 0:
            return cls(np.zeros(1 << BUCKET_BITS), 0.0)
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        layer = np.zeros((2, DIMENSIONS), np.float32)
        share = (labels.sum() + 0.5) / (n + 1)
        bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
        shares = [(c / c.sum()).astype(np.float32) if len(c) else c.astype(np.float32) for _, c in bags]
        lengths = [float(np.sqrt((s**2).sum())) or 1.0 for s in shares]
        steps, done = EPOCHS * n, 0
        for _ in range(EPOCHS):
            for i in rng.permutation(n):
                rate = RATE * (1 - done / steps)
                done += 1
                rows, share_of = bags[i][0], shares[i]
                if not len(rows):
                    continue
                hidden = share_of @ vectors[rows]
                logits = layer @ hidden + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[labels[i]] -= 1.0
                back = layer.T @ p
                layer -= rate * np.outer(p, hidden)
                # a document's features share one step: scaled by the norm of their shares, long texts learn like short ones
                vectors[rows] -= (rate / lengths[i]) * np.outer(share_of, back)
        return cls(vectors @ (layer[1] - layer[0]), bias[1] - bias[0])

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for found in features(text):
            total += float(self.weights[found].sum(dtype=np.float64))
            n += len(found)
        return float(1 / (1 + np.exp(-np.clip(self.bias + (total / n if n else 0.0), -60, 60))))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> QualityModel:
    """Train on at most ``MOST_EXAMPLES`` labelled rows, of ``MOST_CHARS`` characters, outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, MOST_EXAMPLES, id_col, most_chars=MOST_CHARS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([b for b, _ in bags], pa.list_(pa.int32())),
                    pa.array([c for _, c in bags], pa.list_(pa.int32())),
                ],
                names=["id", "label", "buckets", "counts"],
            )

    kind = dict(sample.dtypes)["id"]
    read_in = sample.mapInArrow(read, f"id {kind}, label int, buckets array<int>, counts array<int>").toArrow().sort_by("id")
    discard(sample)
    bags = [
        tuple(read_in[part][row].values.to_numpy(zero_copy_only=False) for part in ("buckets", "counts")) for row in range(read_in.num_rows)
    ]
    return QualityModel.train(bags, np.array([int(x > 0) for x in read_in["label"].to_pylist()], np.int64))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted."""
    rows = pick(docs, id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[id_col, "score", "predicted"],
            )

    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)['id']}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fit and score: id, held_out, score, predicted."""
    scored = score_quality(docs, fit_quality(docs, labels, id_col), id_col)
    return scored.select(id_col, held_out(F.col(id_col), FOLDS, HELD).alias("held_out"), "score", "predicted")
