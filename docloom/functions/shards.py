"""Tables of rows met by tables of queries, shard by shard; neither goes through the driver.

A task takes the rows of one shard, then the queries sent to it as a stream of
Arrow batches: it holds one shard and one block of queries, however many queries
there are, and a lost task is run again from its two shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard on average at most; with 64 components they take 50 MB as doubles.
SHARD_ROWS = 100_000
#: Queries that a task answers at once, and rows of its shard that it compares them with at once.
QUERY_ROWS, POINT_ROWS = 256, 8192

Batches = Iterator[pa.RecordBatch]


def shard_count(rows: DataFrame, least: int | None = None, each: int = SHARD_ROWS) -> int:
    """How many shards the rows take; ``least``, or as many as a shuffle has partitions, so that small tables use several tasks."""
    if least is None:
        least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // each))


def grid(rows: int, tasks: int, each: int = SHARD_ROWS) -> tuple[int, int]:
    """Shards of the rows and blocks of the queries that together give ``tasks`` tasks or a few more.

    A row goes to each block and a query to each shard, so about the root of the tasks
    is sent of either; there are more shards only where the rows would not fit.
    """
    shards = max(1, math.isqrt(max(0, tasks - 1)) + 1, -(-rows // each))
    return shards, max(1, -(-tasks // shards))


def in_grid(pool: DataFrame, asked: DataFrame, block: Column, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with the shard's number made that of a shard and a block: the rows in every block, a query in its own."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = pool.withColumn("block_", every).withColumn("shard", F.col("shard") * blocks + F.col("block_")).drop("block_")
    return rows, asked.withColumn("shard", F.col("shard") * blocks + F.pmod(F.xxhash64(block, F.lit(13)), F.lit(blocks)).cast("int"))


def shard_of(key: Column, shards: int) -> Column:
    """A shard by a hash of the key, which copies of one row do not share if their keys differ."""
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(shards)).cast("int")


def every_shard(queries: DataFrame, shards: int) -> DataFrame:
    """The queries once for each shard."""
    return queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def meet(
    pool: DataFrame,
    asked: DataFrame,
    tasks: int,
    load: Callable[[list[pa.RecordBatch]], object],
    answer: Callable[[object, pa.RecordBatch], Batches],
    schema: str,
) -> DataFrame:
    """``answer`` for every block of ``asked`` and what ``load`` makes of its shard's rows of ``pool``.

    Both tables have an int column ``shard``, which goes to the task of its number
    modulo ``tasks``; a column that only one of them has is null in the other's batches.
    """
    rows = pool.withColumn("is_query", F.lit(False)).unionByName(asked.withColumn("is_query", F.lit(True)), allowMissingColumns=True)
    dealt = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "is_query")

    def run(batches: Batches) -> Batches:
        shard, parts, held = None, [], None
        for batch in batches:
            names = batch.column("shard").to_numpy(zero_copy_only=False)
            kinds = batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(names) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                if names[start] != shard:
                    shard, parts, held = names[start], [], None
                if not kinds[start]:
                    parts.append(batch.slice(start, end - start))
                    continue
                if held is None and parts:
                    held, parts = load(parts), []
                if held is not None:
                    for at in range(start, end, QUERY_ROWS):
                        yield from answer(held, batch.slice(at, min(QUERY_ROWS, end - at)))

    return dealt.mapInArrow(run, schema)


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width of a list column the places of its rows, and these rows as a matrix of doubles; null lists are left out."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, flat.astype(np.float64, copy=False).reshape(len(at), int(width))


class Nearest:
    """The k nearest points of each of a block of queries, gathered from blocks of points in turn; ties go to the smaller id."""

    #: Distances computed with one matrix product may be off by this share of the vectors' squared lengths; within it they are computed anew.
    SLACK = 1e-12
    #: Pairs that are recomputed at once.
    PAIRS = 1 << 16

    def __init__(self, queries: np.ndarray, k: int, reach: np.ndarray | None = None, own: np.ndarray | None = None):
        """``reach``: distances beyond which nothing is wanted; ``own``: ids that are no neighbours."""
        self.queries, self.k, self.own = queries, k, own
        self.reach = np.full(len(queries), np.inf) if reach is None else reach
        self.of = self.ids = np.zeros(0, np.int64)
        self.near = np.zeros(0)
        self.pairs = 0

    def add(self, points: np.ndarray, ids: np.ndarray) -> None:
        lengths, own_lengths = (points**2).sum(axis=1), (self.queries**2).sum(axis=1)
        for at in range(0, len(points), POINT_ROWS):
            block, size = points[at : at + POINT_ROWS], lengths[at : at + POINT_ROWS]
            rough = own_lengths[:, None] + size[None, :] - 2 * self.queries @ block.T
            slack = 1e-9 + self.SLACK * (own_lengths + size.max(initial=0.0)) * max(1, points.shape[1])
            if self.own is not None:
                rough[self.own[:, None] == ids[None, at : at + POINT_ROWS]] = np.inf
            limit = self.reach
            if rough.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack)
            self.pairs += rough.size
            of, place = np.nonzero((rough <= (limit + slack)[:, None]) & np.isfinite(rough))
            for start in range(0, len(of), self.PAIRS):
                q, p = of[start : start + self.PAIRS], place[start : start + self.PAIRS]
                exact = np.round(((block[p] - self.queries[q]) ** 2).sum(axis=1), 12)
                self.keep(q, ids[at + p], exact)

    def keep(self, of: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        """Take what was found for the queries ``of``, and leave only the k best of each."""
        wanted = near <= self.reach[of]
        of, ids, near = (np.concatenate(x) for x in ((self.of, of[wanted]), (self.ids, ids[wanted]), (self.near, near[wanted])))
        order = np.lexsort((ids, near, of))
        of, ids, near = of[order], ids[order], near[order]
        first = np.searchsorted(of, of)
        kept = np.arange(len(of)) - first < self.k
        self.of, self.ids, self.near = of[kept], ids[kept], near[kept]
        last = np.flatnonzero(np.arange(len(of)) - first == self.k - 1)
        self.reach = self.reach.copy()
        self.reach[of[last]] = np.minimum(self.reach[of[last]], near[last])
