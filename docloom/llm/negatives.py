"""Operator 11: hard-negative mining by distributed radix selection.

For each anchor, its positives are the rows of its own label with the highest
scores; for each positive, its negatives are the highest rows of other labels
whose scores lie in the positive's window, so that they are hard but hardly
mislabelled. Both are one selection: the k highest rows of a window of scores.

1. Histograms. Rows are dealt into shards; every anchor meets every shard and
   scores it by one matrix product. For each of the anchor's windows, the scores
   within it are counted by their highest digit (``DIGIT_BITS`` bits). Only
   counts are shuffled: a row for each digit that occurs, from the highest one
   down to that with which the shard alone has k rows, so k at most.
2. Refinement. The counts of all shards are added up, and the digit that holds
   the k-th highest score becomes the window's new range; the rows above it are
   fewer than k. The next digit is counted in this range only, until the range is
   one score or all of its rows are wanted. A window whose range is final is sent
   no more.
3. Gathering. At last each shard gives the rows above the final range, fewer than
   k over all shards, and of those at it as many as are still wanted, the smallest
   ids first: so a score that a third of all rows share brings k rows a shard.

Windows of one anchor and one positive score are one window. No score is stored,
and no pair but those gathered leaves a task.

Scores are integers: vectors are quantised to floor(256 * x), and windows are
compared as whole numbers.

Defined results: rows whose id, label or vector is null, or whose vector holds a
null or a non-finite component, take no part. Shorter vectors count as padded with
zeros. Rows that repeat an id are rows by themselves: each is an anchor, a positive
or a negative of its own, and only an anchor's own row is not its positive. Ties
beyond the id are between rows that read alike. Anchors without positives and
positives without negatives give no rows. Scores beyond ``MOST_SCORE`` = 2 ** 62 - 1,
of either sign, are clipped to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shards import POINT_ROWS, every_shard, meet, shard_count, shard_of
from .common import cut, discard
from .topk import SCALE, matrix_of, products, quantise, widen

#: Bits of a score that one pass counts.
DIGIT_BITS = 10
#: A negative scores from so many to so many hundredths of its positive.
LOWEST, HIGHEST = 30, 90
MOST_SCORE = 2**62 - 1
#: A row of an anchor's windows: its number, range of scores, and how many rows of the range's highest are wanted.
WINDOW = "win long, low long, high long, need long"


def clean_rows(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """row, id, label, v of the rows that take part; row is a key of each."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    whole = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & whole).withColumn("row", F.monotonically_increasing_id())


class Shard:
    """The rows of a shard: keys, ids, labels, quantised vectors."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.rows, self.ids, self.labels = (np.concatenate([p.column(n).to_numpy(zero_copy_only=False) for p in parts]) for n in ("row", "id", "label"))
        each = [quantise(matrix_of(p.column("v"))) for p in parts]
        width = max(m.shape[1] for m in each)
        self.vectors = np.concatenate([widen(m, width) for m in each])

    def scored(self, batch: pa.RecordBatch, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor's place, places of the shard's rows that can be its partners, their scores), a block of rows at a time."""
        width = self.vectors.shape[1]
        queries = widen(quantise(matrix_of(batch.column("v"))), width)[:, :width]  # beyond the shard's width every product is zero
        rows, labels = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "label"))
        for at in range(0, len(self.rows), POINT_ROWS):
            part = slice(at, at + POINT_ROWS)
            scores = np.clip(products(self.vectors[part], queries), -MOST_SCORE, MOST_SCORE)
            for i in range(len(rows)):
                alike = self.labels[part] == labels[i]
                fit = np.flatnonzero(alike & (self.rows[part] != rows[i]) if same else ~alike)
                yield i, at + fit, scores[i, fit]


def _windows(batch: pa.RecordBatch) -> list[list[tuple[int, ...]]]:
    return [[(w["win"], w["low"], w["high"], w["need"], w["top"]) for w in each] for each in batch.column("windows").to_pylist()]


def _shift(low: int, high: int, digit_bits: int) -> int:
    """Bits below the digit that a pass counts in a range."""
    return max(0, (high - low).bit_length() - digit_bits)


def _count(same: bool, digit_bits: int):
    """Rows (win, digit, n): how many scores of each window have each highest digit."""

    def answer(held: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        windows = _windows(batch)
        found: dict[int, np.ndarray] = {}
        for i, _, scores in held.scored(batch, same):
            for win, low, high, _, _ in windows[i]:
                inside = scores[(scores >= low) & (scores <= high)]
                if len(inside):
                    counts = np.bincount((inside - low) >> _shift(low, high, digit_bits), minlength=1 << digit_bits)
                    found[win] = found[win] + counts if win in found else counts
        wanted = {win: need for each in windows for win, _, _, need, _ in each}
        wins, digits, counts = [], [], []
        for win, of in found.items():
            digit = np.flatnonzero(of)[::-1]
            # below a digit with which this shard alone has enough, the one that is looked for cannot lie
            digit = digit[np.cumsum(of[digit]) - of[digit] < wanted[win]]
            wins.append(np.full(len(digit), win))
            digits.append(digit)
            counts.append(of[digit])
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none).astype(np.int64)) for x in (wins, digits, counts)], names=["win", "digit", "n"])

    return answer


def _gather(same: bool):
    """Rows (win, row, id, score): the rows above each window's range, and of those in it as many as are wanted.

    ``high`` ends the range; what lies above it up to ``top`` was in the window and is wanted too.
    """

    def answer(held: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        windows = _windows(batch)
        out: list[tuple[np.ndarray, ...]] = []
        for i, places, scores in held.scored(batch, same):
            ids = held.ids[places]
            for win, low, high, need, top in windows[i]:
                last = np.flatnonzero((scores >= low) & (scores <= high))
                first = last[np.lexsort((ids[last], -scores[last]))[:need]]
                take = np.concatenate([np.flatnonzero((scores > high) & (scores <= top)), first])
                out.append((np.full(len(take), win), held.rows[places[take]], ids[take], scores[take]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["win", "row", "id", "score"])

    return answer


def select_highest(pool: DataFrame, windows: DataFrame, anchors: DataFrame, shards: int, same: bool, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """win, row, id, score: of each window (``WINDOW``, anchor) the rows that can be among its ``need`` highest.

    At most ``need`` rows of a window have a higher score or an equal one and a
    smaller id than any row left out; ties at the last score can bring a few more a
    shard, which the caller ranks. ``anchors`` has row, label and v.
    """
    state = cut(windows.select("anchor", *[c.split()[0] for c in WINDOW.split(", ")], F.col("high").alias("top"), F.lit(False).alias("done")), "windows")
    each = F.struct("win", "low", "high", "need", "top")

    def sent(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("anchor").agg(F.collect_list(each).alias("windows"))
        return every_shard(asked.join(anchors, asked["anchor"] == anchors["row"]).select("row", "label", "v", "windows"), shards)

    while not state.filter("NOT done").isEmpty():
        counts = meet(pool, sent(state.filter("NOT done")), shards, Shard, _count(same, digit_bits), "win long, digit long, n long")
        counts = counts.groupBy("win", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("win").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, 0))
        all_of = F.sum("n").over(Window.partitionBy("win"))
        known = counts.withColumn("upto", upto).withColumn("all", all_of).join(state.filter("NOT done"), "win", "right")
        # the digit that holds the need-th highest row; if there are not so many rows the range stays, and all of it is wanted
        few = F.coalesce(F.col("all"), F.lit(0)) < F.col("need")
        above = F.col("upto") - F.col("n")
        reached = F.when(few, F.coalesce(F.col("upto") == F.col("all"), F.lit(True))).otherwise((F.col("upto") >= F.col("need")) & (above < F.col("need")))
        bits = F.length(F.regexp_replace(F.bin(F.col("high") - F.col("low")), "^0+", ""))
        known = known.filter(reached).withColumn("shift", F.greatest(bits - digit_bits, F.lit(0))).withColumn("step", F.expr("shiftleft(1L, shift)"))
        low = F.col("low") + F.col("digit") * F.col("step")
        moved = known.select(
            "anchor",
            "win",
            F.when(few, F.col("low")).otherwise(low).alias("low"),
            F.when(few, F.col("high")).otherwise(F.least("high", low + F.col("step") - 1)).alias("high"),
            F.when(few, F.col("need")).otherwise(F.col("need") - above).alias("need"),
            "top",
            (few | (F.col("shift") == 0) | (F.col("upto") == F.col("need"))).alias("done"),
        )
        state, before = cut(state.filter("done").unionByName(moved), "windows"), state
        discard(before)
    return meet(pool, sent(state), shards, Shard, _gather(same), "win long, row long, id long, score long")


def hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. Each has up to ``positives``
    positives, the highest other rows of its label, and each of these up to
    ``negatives`` negatives, the highest rows of other labels whose score is at
    least ``LOWEST`` and at most ``HIGHEST`` hundredths of the positive's.
    """
    rows = cut(clean_rows(vectors, id_col, label_col, vector_col), "rows")
    shards = shard_count(rows)
    pool = rows.withColumn("shard", shard_of(F.col("row"), shards))
    anchors = cut(rows.filter(F.pmod("id", F.lit(every)) == 0), "anchors")
    # no score is larger than the largest squared length
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * SCALE), F.lit(2.0)))
    largest = rows.agg(F.max(square).alias("most")).first().most or 0.0
    most = F.lit(min(MOST_SCORE, int(min(2.0**62, largest * (1 + 1e-9) + 1)))).cast("long")
    whole = anchors.select(F.col("row").alias("anchor"), F.col("row").alias("win"), (-most).alias("low"), most.alias("high"), F.lit(positives).cast("long").alias("need"))
    near = select_highest(pool, whole, anchors, shards, True, digit_bits)
    place = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "row")
    near = near.select(F.col("win").alias("anchor"), F.col("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = cut(near.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= positives), "positives")

    # one window for each anchor and score; bounds as decimals, as 90 times a long can be beyond a long
    score = F.col("positive_score").cast("decimal(20,0)")
    bounds = near.select("anchor", "positive_score").distinct().select(
        "anchor",
        "positive_score",
        F.monotonically_increasing_id().alias("win"),
        F.ceil(score * LOWEST / 100).cast("long").alias("low"),
        F.floor(score * HIGHEST / 100).cast("long").alias("high"),
        F.lit(negatives).cast("long").alias("need"),
    )
    bounds = cut(bounds.filter("low <= high"), "bounds")
    far = select_highest(pool, bounds, anchors, shards, False, digit_bits)
    rank = Window.partitionBy("win").orderBy(F.desc("negative_score"), "negative_id", "row")
    far = far.select("win", "row", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    far = far.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= negatives)
    found = near.join(bounds.select("anchor", "positive_score", "win"), ["anchor", "positive_score"]).join(far.drop("row"), "win")
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
