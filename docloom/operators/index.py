"""A durable vector index: coarse cells as Parquet partitions, exact search by distance bounds.

Below the index's path:

* ``cells``: cell, centroid; fitted once on a bounded sample and never changed.
* ``vectors/batch=B/cell=C``: chunk_id, embedding, away (distance from the centroid) and the columns that were kept.
* ``gone/batch=B``: chunk_ids that a later batch took back.
* ``balls/batch=B``: cell, n, radius of what the batch added. It is written last: a batch without it does not exist.

A batch is a folder, so one that is written again replaces itself.

A search is exact. Each query first meets the nearest cells that hold k vectors
together; the k-th distance found there is its reach. Then it goes to those other
cells only whose ball lies within that reach: by the triangle inequality no vector
of the rest can be nearer. Cells that no query reaches are never read. Cells are
held together in shards, about as many as the root of the tasks, and a query is sent
to a shard once, with the cells it wants there. A cell of many vectors, as of a vector
that a third of all rows share, is dealt into several shards, so no task holds more
than a shard and a block of queries.

Only the cells (at most ``MOST_CELLS`` centroids) and the sample they are fitted on
pass through the driver. Vectors that are null or hold a null take no part; vectors
of several widths are an error; queries of another width find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, small
from ..functions.shards import QUERY_ROWS, Nearest, by_width, grid, in_grid, meet, shard_of
from ..sources.io import exists
from .search import HITS, held_points, hits_of, vectors_of

#: Cells at most, and vectors that they are fitted on at most.
MOST_CELLS, SAMPLE_ROWS = 4096, 20_000
ROUNDS = 6
#: Ids taken back that are sent to the tasks that read the vectors; more are joined by shuffle.
BROADCAST_GONE = 1_000_000


class UnevenVectors(ValueError):
    """The vectors do not all have one width, or not that of the index."""


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of at most ``cells`` cells: a few rounds of k-means from the first different vectors of the sample."""
    centroids = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])][:cells]
    for _ in range(ROUNDS if len(centroids) else 0):
        of = nearest_cell(sample, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        counts = np.bincount(of, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest_cell(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the row's distance from it."""
    of = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        of[at : at + 4096] = ((centroids**2).sum(axis=1)[None, :] - 2 * part @ centroids.T).argmin(axis=1)
    return of, np.sqrt(((rows - centroids[of]) ** 2).sum(axis=1))


class VectorIndex:
    """An index at a path of the store; opening it reads the cells only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # MOST_CELLS at most
        self.centroids = np.array([r.centroid for r in rows], np.float64).reshape(len(rows), len(rows[0].centroid) if rows else 0)
        #: Cells that the last search read.
        self.cells_read: list[int] = []

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "chunk_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> VectorIndex:
        """An index of all vectors, which are its batch 0."""
        index = cls.fit(vectors, path, cells, id_col, vector)
        index.append(vectors, 0, id_col, vector, keep)
        return index

    @classmethod
    def fit(cls, vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "chunk_id", vector: str = "embedding") -> VectorIndex:
        """An index without vectors, its cells fitted to these (by default about as many as the root of their number)."""
        spark, rows = vectors.sparkSession, vectors_of(vectors, id_col, vector)
        size = F.size("v")
        n, low, high = rows.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
        if low != high:
            raise UnevenVectors(f"vectors of {low} to {high} components")
        chosen = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, n // SAMPLE_ROWS))) == 0
        sample = rows.filter(chosen).select("v").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
        matrix = next((m for _, m in by_width(sample)), np.zeros((0, high or 0)))
        wanted = cells or min(MOST_CELLS, max(1, round(n**0.5)))
        if wanted > MOST_CELLS:
            raise ValueError(f"an index has {MOST_CELLS} cells at most")
        centroids = fit_cells(matrix, wanted)
        table = [(i, c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(table, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    def append(self, vectors: DataFrame, batch: int, id_col: str = "chunk_id", vector: str = "embedding", keep: tuple[str, ...] = (), gone: DataFrame | None = None) -> None:
        """Add vectors as a batch, and take back the chunk_ids of ``gone``; the batch counts once all of it is written."""
        rows = vectors_of(vectors.withColumn("_kept", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep])), id_col, vector, "_kept")
        centroids, kind = self.centroids, dict(rows.dtypes)["_kept"]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for each in batches:
                for at, matrix in by_width(each.column("v")):
                    if matrix.shape[1] != centroids.shape[1] or not len(centroids):
                        raise UnevenVectors(f"vectors of {matrix.shape[1]} components in an index of {centroids.shape[1]}")
                    cell, away = nearest_cell(matrix, centroids)
                    part = each.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *part.columns, pa.array(away)], names=["cell", *part.schema.names, "away"])

        dealt = rows.mapInArrow(deal, f"cell int, id long, v array<double>, _kept {kind}, away double")
        # a cell goes to one task, or to several if it holds much of the batch
        rebalanced = dealt.hint("rebalance", "cell")
        at = f"{self.path}/vectors/batch={batch}"
        columns = [F.col("id").alias("chunk_id"), F.col("v").alias("embedding"), "away", *[F.col(f"_kept.`{c}`").alias(c) for c in keep]]
        rebalanced.select("cell", *columns).write.mode("overwrite").partitionBy("cell").parquet(at)
        if gone is not None:
            gone.select(F.col("chunk_id").cast("long")).write.mode("overwrite").parquet(f"{self.path}/gone/batch={batch}")
        written = self.spark.read.schema("chunk_id long, away double, cell int").parquet(at)
        balls = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        balls.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/balls/batch={batch}")

    def balls(self) -> DataFrame:
        """batch, cell, n, radius of all batches that were written to their end."""
        return self.spark.read.schema("cell int, n long, radius double, batch int").parquet(f"{self.path}/balls")

    def vectors(self, keep: str = "", cells: list[int] | None = None) -> DataFrame:
        """cell, chunk_id, embedding and ``keep`` (columns as DDL) of the live rows, of the named cells only."""
        batches = [r.batch for r in self.balls().select("batch").distinct().collect()]  # one a batch
        schema = "chunk_id long, embedding array<double>, " + (f"{keep}, " if keep else "") + "batch int, cell int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/vectors").filter(F.col("batch").isin(batches))
        if cells is not None:
            rows = rows.filter(F.col("cell").isin(cells))
        if exists(self.spark, f"{self.path}/gone"):
            gone = self.spark.read.schema("chunk_id long, batch int").parquet(f"{self.path}/gone").filter(F.col("batch").isin(batches))
            # an id that was taken back counts again if a later batch brings it again
            last = gone.groupBy("chunk_id").agg(F.max("batch").alias("until"))
            rows = rows.join(small(cut(last, "gone"), BROADCAST_GONE), "chunk_id", "left").filter("until IS NULL OR batch >= until").drop("until")
        return rows.drop("batch")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", others: bool = False) -> DataFrame:
        """query_id, chunk_id, distance, rank: the ``k`` nearest by squared L2 distance, ties to the smaller id.

        With ``others`` a vector of the query's own id is no neighbour. Each row of
        ``queries`` is a query, of a repeated id too: its rows are then answered as one list.
        """
        centroids = self.centroids
        counts, radii = np.zeros(len(centroids), np.int64), np.full(len(centroids), -np.inf)
        for r in self.balls().groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():  # a row a cell
            counts[r.cell], radii[r.cell] = r.n, r.radius
        asked = vectors_of(queries, query_id, vector).withColumn("row", F.monotonically_increasing_id())
        asked = cut(asked.filter(F.size("v") == centroids.shape[1]), "asked")
        # with own ids left out one more vector is needed, and what was taken back is counted still
        gone = self.spark.read.parquet(f"{self.path}/gone").count() if exists(self.spark, f"{self.path}/gone") else 0
        least = k + int(others) + gone

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_ROWS):
                    part = batch.slice(at, QUERY_ROWS)
                    far = _distances(part, centroids)
                    order = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(counts[order], axis=1) - counts[order]
                    yield _sent(part, groups, *_places(order, (before < least) & (counts[order] > 0)))

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_ROWS):
                    part = batch.slice(at, QUERY_ROWS)
                    far = _distances(part, centroids)
                    reach = part.column("reach").fill_null(np.inf).to_numpy(zero_copy_only=False)
                    border = np.maximum(far - radii[None, :], 0.0)
                    hit = (border**2 <= (reach + 1e-9 * (1.0 + reach))[:, None] + 1e-9 * far**2) & (counts > 0)[None, :]
                    for row, seen in enumerate(part.column("seen").to_pylist()):
                        hit[row, seen or []] = False
                    yield _sent(part, groups, *np.nonzero(hit))

        groups, tasks = self._groups(counts)
        schema = "shard int, row long, id long, v array<double>, reach double, cells array<int>"
        first = cut(asked.withColumn("reach", F.lit(None).cast("double")).mapInArrow(homes, schema), "homes")
        near = cut(self._met(first, k, groups, tasks, others), "near")
        reach = near.groupBy("row").agg(F.slice(F.array_sort(F.collect_list("distance")), k, 1).alias("kth")).select("row", F.get("kth", 0).alias("reach"))
        seen = first.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("seen"))
        known = asked.join(seen, "row").join(reach, "row", "left")
        second = cut(known.mapInArrow(reached, schema), "reached")
        hits = near.unionByName(self._met(second, k, groups, tasks, others))
        self.cells_read = sorted({*_cells_of(first), *_cells_of(second)})
        best = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        return hits.drop("row").distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _groups(self, counts: np.ndarray) -> tuple[list[list[int]], int]:
        """For each cell the shards that hold its vectors, and how many tasks there should be.

        A shard is several cells, or a part of a large one: a query is sent to it once,
        with the cells that it wants there, however many these are.
        """
        total, tasks = int(counts.sum()), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        each = max(1, -(-total // grid(total, tasks)[0]))
        places, held, shard = [], 0, 0
        for n in counts.tolist():
            parts = max(1, -(-n // each))
            share, own = -(-n // parts), []
            for _ in range(parts):
                if held and held + share > each:
                    held, shard = 0, shard + 1
                held += share
                own.append(shard)
            places.append(own)
        return places, tasks

    def _met(self, sent: DataFrame, k: int, groups: list[list[int]], tasks: int, others: bool) -> DataFrame:
        """row and ``HITS``: the k best of each query in each shard of the cells it is sent to."""
        cells = _cells_of(sent)
        shards = 1 + max((g for own in groups for g in own), default=0)
        blocks = max(1, -(-tasks // shards))
        place = F.get(F.array(*[F.array(*map(F.lit, own)) for own in groups]), F.col("cell")) if groups else F.array(F.lit(0))
        part = F.pmod(shard_of(F.col("chunk_id"), 1 << 30), F.size("place"))
        pool = self.vectors(cells=cells).withColumn("place", place).select(F.get("place", part).alias("shard"), F.col("chunk_id").alias("id"), F.col("embedding").alias("v"), "cell")

        def answer(held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            reach = batch.column("reach").fill_null(np.inf).to_numpy(zero_copy_only=False)
            wanted = batch.column("cells")
            at = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            want = wanted.flatten().to_numpy(zero_copy_only=False)
            matrix = next(m for _, m in by_width(batch.column("v")))  # all queries have the index's width
            found = Nearest(matrix, k, reach)
            for cell in np.unique(want).tolist():
                if cell in held:
                    of, (names, points) = at[want == cell], held[cell]
                    near = Nearest(matrix[of], k, found.reach[of], ids[of] if others else None)
                    near.add(points, names)
                    found.keep(of[near.of], near.ids, near.near)
            hits = hits_of(found, ids)
            yield pa.RecordBatch.from_arrays([pa.array(rows[found.of]), *hits.columns], names=["row", *hits.schema.names])

        return meet(*in_grid(pool, sent, F.col("row"), blocks), shards * blocks, _held_cells, answer, f"row long, {HITS}")


def _cells_of(sent: DataFrame) -> list[int]:
    return sorted(r.cell for r in sent.select(F.explode("cells").alias("cell")).distinct().collect())  # MOST_CELLS at most


def _held_cells(parts: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A shard's ids and vectors, by cell; all have the index's width."""
    cells = np.concatenate([b.column("cell").to_numpy(zero_copy_only=False) for b in parts])
    ((ids, points),) = held_points(parts).values()
    order = np.argsort(cells, kind="stable")
    edges = np.flatnonzero(np.diff(cells[order])) + 1
    return {int(cells[at[0]]): (ids[at], points[at]) for at in np.split(order, edges)}


def _distances(part: pa.RecordBatch, centroids: np.ndarray) -> np.ndarray:
    """Distances (query, cell), by differences: products would round small ones away."""
    queries = next((m for _, m in by_width(part.column("v"))), np.zeros((0, centroids.shape[1])))
    return np.sqrt(np.stack([((queries - c) ** 2).sum(axis=1) for c in centroids], axis=1)) if len(centroids) else np.zeros((len(queries), 0))


def _places(order: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of, place = np.nonzero(chosen)
    return of, order[of, place]


def _sent(part: pa.RecordBatch, groups: list[list[int]], of: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """Each query once for each shard that holds cells it is sent to, with these cells."""
    many = np.array([len(g) for g in groups], np.int64)
    flat = np.array([g for own in groups for g in own], np.int64)
    starts = np.cumsum(many) - many
    pairs = np.repeat(np.arange(len(of)), many[cell])
    step = np.arange(len(pairs)) - np.repeat(np.cumsum(many[cell]) - many[cell], many[cell])
    row, shard, wanted = of[pairs], flat[starts[cell[pairs]] + step], cell[pairs]
    order = np.lexsort((wanted, shard, row))
    row, shard, wanted = row[order], shard[order], wanted[order]
    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(shard) != 0)][: len(row)])
    lists = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(row)], pa.int32()), pa.array(wanted.astype(np.int32)))
    rows = part.select(["row", "id", "v", "reach"]).take(pa.array(row[first]))
    return pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), *rows.columns, lists], names=["shard", "row", "id", "v", "reach", "cells"])
