"""Operator 7: exact top-k inner-product search by ball trees with branch and bound.

A coarse tree over a bounded sample deals the vectors into shards that lie
together in space, one a partition; every vector is dealt, and those that lie on
a border, as copies of one vector do, by a hash of their id, so that no shard
gathers them. Each shard builds a ball tree. Queries descend it in batches, the
child of the higher bound first, a node's bound being ``q . centre + |q| * radius``;
a query leaves a branch whose bound is below its current k-th score, and leaves
are scored by one matrix product for all queries that reach them.

The k-th score is shared between shards: a first pass searches each query in its
home shard only; the second pass sends it to those shards whose ball reaches the
score found there, and starts from that score.

Queries reach a task as a stream of Arrow batches behind the shard's vectors
(rows sorted by shard, vectors first), so a task holds one shard and one batch
of queries, however many queries there are.

Defined results: vectors that are null, hold a null or a non-finite component,
or have a null id take no part. Shorter vectors count as padded with zeros. A
repeated id is one query (its smallest vector) and each of its rows is a
candidate of every other id. Ties go to the smaller id. Scores beyond a long are
clipped to -2 ** 63 + 2 and 2 ** 63 - 1, and order so. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors in a shard at most, on average; with 64 components they take 100 MB as doubles.
SHARD_ROWS = 200_000
#: Shards at least, so that small tables still use several tasks.
LEAST_SHARDS = 12
#: Vectors that the coarse tree is fitted on, about; twice as many at most.
SAMPLE_ROWS = 20_000
LEAF_ROWS = 128
SCALE = 256.0
#: No score yet, and no id; the limits of a score.
NONE, NO_ID = -(2**63) + 1, 2**63 - 1

OUT = "query_id long, vec_id long, score long"


def quantise(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component, as whole doubles."""
    return np.floor(np.minimum(np.maximum(vectors.astype(np.float64), -1e300), 1e300) * SCALE)


def products(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products (query, point) of whole doubles as longs, clipped to their range."""
    largest = float(np.abs(points).max(initial=0.0)) * float(np.abs(queries).max(initial=0.0)) * max(1, points.shape[1])
    if largest < 2**52:
        return (queries @ points.T).astype(np.int64)
    if largest < 2**62:
        return queries.astype(np.int64) @ points.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(queries) @ whole(points).T, NONE + 1, NO_ID).astype(np.int64)


def bounds_of(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds (query, ball) of the inner product of a query with anything in a ball, a little widened."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = queries @ centres.T + norms[:, None] * radii[None, :]
        return np.maximum(np.nan_to_num(top + 1e-9 * (np.abs(top) + 1.0), nan=np.inf), float(NONE))


def norms_of(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows**2).sum(axis=1))


def _direction(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """From the row farthest from the centre to the row farthest from that one."""
    far = rows[int(norms_of(rows - centre).argmax())]
    return rows[int(norms_of(rows - far).argmax())] - far


class CoarseTree:
    """Splits of space into shards of about equal numbers of the sample's vectors."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.width = sample.shape[1]
        self.splits: list[tuple[int, np.ndarray, float, int]] = []  # (part, direction, border, part beyond it)
        parts = [np.arange(len(sample))]
        heap = [(-len(sample), 0)]
        while len(parts) < shards:
            _, part = heapq.heappop(heap)
            rows = sample[parts[part]]
            if len(rows):
                along = _direction(rows, rows.mean(axis=0))
                reach = rows @ along
                border = float(np.median(reach))
                beyond = reach > border
                beyond[np.flatnonzero(reach == border)[::2]] = True
            else:
                along, border, beyond = np.zeros(self.width), 0.0, np.zeros(0, bool)
            self.splits.append((part, along, border, len(parts)))
            parts.append(parts[part][beyond])
            parts[part] = parts[part][~beyond]
            for p in (part, len(parts) - 1):
                heapq.heappush(heap, (-len(parts[p]), p))
        self.centres = np.array([sample[p].mean(axis=0) if len(p) else np.zeros(self.width) for p in parts])

    def deal(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The shard of each row; those on a border go by a hash of their ids."""
        rows = widen(rows, self.width)[:, : self.width]
        shard = np.zeros(len(rows), np.int64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for k, (part, along, border, other) in enumerate(self.splits):
            here = np.flatnonzero(shard == part)
            reach = rows[here] @ along
            coin = (mixed[here] >> np.uint64(8 + k % 56)) & np.uint64(1)
            shard[here[(reach > border) | ((reach == border) & (coin == 1))]] = other
        return shard

    def away(self, rows: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Distance of each row from its shard's centre."""
        width = max(self.width, rows.shape[1])
        return norms_of(widen(rows, width) - widen(self.centres, width)[shard])


class BallTree:
    """Nodes in arrays; points reordered so that each leaf is a slice."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        spans, kids, centres, radii = [], [], [], []
        stack = [(0, len(points), -1, 0)] if len(points) else []
        while stack:
            start, end, parent, side = stack.pop()
            rows = points[order[start:end]]
            centre = rows.mean(axis=0)
            node = len(spans)
            spans.append((start, end))
            kids.append([-1, -1])
            centres.append(centre)
            radii.append(float(norms_of(rows - centre).max()))
            if parent >= 0:
                kids[parent][side] = node
            if end - start <= LEAF_ROWS or radii[-1] == 0.0:
                continue
            along = rows @ _direction(rows, centre)
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(along, middle)]
            stack += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.spans, self.kids = spans, kids
        self.centres = np.array(centres) if spans else np.zeros((0, points.shape[1]))
        self.radii = np.array(radii)
        self.points, self.ids = points[order], ids[order]
        self.scored = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best scores, and their ids, of each query, from its floor upwards and without its own id."""
        best = np.full((len(queries), k), NONE)
        names = np.full((len(queries), k), NO_ID)
        kth, norms = floors.copy(), norms_of(queries)
        stack = [(0, np.arange(len(queries)), np.full(len(queries), np.inf))] if self.spans else []
        while stack:
            node, asked, bound = stack.pop()
            asked = asked[bound >= kth[asked].astype(np.float64)]
            if not len(asked):
                continue
            kids = self.kids[node]
            if kids[0] >= 0:
                bounds = bounds_of(queries[asked], norms[asked], self.centres[kids], self.radii[kids])
                for side in np.argsort(bounds.sum(axis=0)):  # the child of the higher bounds is on top
                    stack.append((kids[side], asked, bounds[:, side]))
                continue
            start, end = self.spans[node]
            for at in range(start, end, 4096):  # a leaf of copies can be large
                part = slice(at, min(end, at + 4096))
                self.scored += len(asked) * (part.stop - part.start)
                scores = products(self.points[part], queries[asked])
                ids = self.ids[part]
                scores[ids[None, :] == own[asked][:, None]] = NONE
                hit = np.flatnonzero((scores.max(axis=1) >= kth[asked]) & (scores.max(axis=1) > NONE))
                rows = asked[hit]
                every = np.concatenate([best[rows], scores[hit]], axis=1)
                owners = np.concatenate([names[rows], np.where(scores[hit] > NONE, ids[None, :], NO_ID)], axis=1)
                order = np.lexsort((owners, -every), axis=1)[:, :k]
                best[rows], names[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(owners, order, 1)
                kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
        return best, names


def matrix_of(column: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as a matrix, short rows padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    ends = np.cumsum(sizes)
    for i, (size, end) in enumerate(zip(sizes, ends, strict=True)):
        out[i, :size] = flat[end - size : end]
    return out


def widen(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _search_shards(k: int):
    """Arrow task over rows sorted by (shard, is_query): shard, is_query, vec_id, embedding, floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, len(shards)], strict=True):
                if start == end:
                    continue
                piece = batch.slice(start, end - start)
                if shards[start] != shard:
                    shard, parts, tree = shards[start], [], None
                ids = piece.column(2).to_numpy(zero_copy_only=False)
                rows = quantise(matrix_of(piece.column(3)))
                if not kinds[start]:
                    parts.append((ids, rows))
                    continue
                if tree is None:
                    width = max((r.shape[1] for _, r in parts), default=0)
                    tree = BallTree(
                        np.concatenate([widen(r, width) for _, r in parts]) if parts else np.zeros((0, width)),
                        np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64),
                    )
                    parts = []
                width = tree.points.shape[1]
                rows = widen(rows, width)[:, :width]  # beyond the shard's width every product is zero
                floors = piece.column(4).fill_null(NONE).to_numpy(zero_copy_only=False)
                for at in range(0, len(rows), 512):
                    part = slice(at, at + 512)
                    scores, names = tree.search(rows[part], ids[part], k, floors[part])
                    of, place = np.nonzero(names != NO_ID)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part][of]), pa.array(names[of, place]), pa.array(scores[of, place])],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id ``every`` divides."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    )
    clean = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    clean = clean.filter(usable)
    n = clean.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, n // SAMPLE_ROWS))) == 0
    sample = clean.filter(chosen).select("embedding").limit(2 * SAMPLE_ROWS).toArrow()["embedding"]
    sample = pa.concat_arrays(sample.chunks) if sample.num_chunks else pa.array([], sample.type)
    coarse = clean.sparkSession.sparkContext.broadcast(CoarseTree(quantise(matrix_of(sample)), shards))
    kind = dict(clean.dtypes)["embedding"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = quantise(matrix_of(batch.column(1))), batch.column(0).to_numpy(zero_copy_only=False)
            shard = coarse.value.deal(rows, ids)
            away = coarse.value.away(rows, shard)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), batch.column(0), batch.column(1), pa.array(away)],
                names=["shard", "vec_id", "embedding", "away"],
            )

    dealt = cut(clean.mapInArrow(deal, f"shard int, vec_id long, embedding {kind}, away double"), "dealt")
    radii = np.full(shards, -np.inf)
    for r in dealt.groupBy("shard").agg(F.max("away").alias("radius")).collect():  # a row a shard
        radii[r.shard] = r.radius
    pool = dealt.select("shard", F.lit(False).alias("is_query"), "vec_id", "embedding", F.lit(None).cast("long").alias("floor"))
    queries = dealt.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "shard")).alias("first"))
    queries = queries.select("vec_id", "first.embedding", F.col("first.shard").alias("home"))

    def searched(asked: DataFrame) -> DataFrame:
        rows = pool.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "is_query")
        return rows.mapInArrow(_search_shards(k), OUT)

    at_home = queries.select(F.col("home").alias("shard"), F.lit(True).alias("is_query"), "vec_id", "embedding", F.lit(None).cast("long").alias("floor"))
    first = cut(searched(at_home), "topk")
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard, but the home, whose ball reaches the query's floor."""
        tree = coarse.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = quantise(matrix_of(part.column(1)))
                floors = part.column(3).fill_null(NONE).to_numpy(zero_copy_only=False)
                width = max(tree.width, rows.shape[1])
                bounds = bounds_of(widen(rows, width), norms_of(rows), widen(tree.centres, width), np.maximum(radii, 0.0))
                reach = (bounds >= floors[:, None].astype(np.float64)) & np.isfinite(radii)[None, :]
                reach[np.arange(len(rows)), part.column(2).to_numpy(zero_copy_only=False)] = False
                of, shard = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(floors[of])],
                    names=["shard", "vec_id", "embedding", "floor"],
                )

    known = queries.join(floors, "vec_id", "left").select("vec_id", "embedding", "home", "floor")
    others = known.mapInArrow(send, f"shard int, vec_id long, embedding {kind}, floor long")
    others = others.select("shard", F.lit(True).alias("is_query"), "vec_id", "embedding", "floor")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(searched(others))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
