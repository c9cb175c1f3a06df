"""Operator 4 with five-word shingles and a similarity of 0.8: SimHash links, verified and completed.

Two texts are linked when the sets of their word shingles (``SHINGLE_WORDS`` = 5)
have a Jaccard similarity of ``SIMILARITY`` = 4/5 or more; a group is a connected
component of these links. SimHash finds most links at little cost, but it is a
sketch: at similarity 0.8 two fingerprints differ in 10 of 64 bits on average,
beyond what any keys can guarantee. So its links are verified, and what it cannot
see is found by keys that miss nothing.

1. Rows of one shingle set are one node; only nodes are compared.
2. SimHash. Nodes whose fingerprints agree up to 4 bits, found by the Golay keys
   of ``simhash``, are candidates.
3. Prefix keys. Shingles have one global order, those that many texts hold
   last. Of n shingles a partner shares ceil(4n/5) at least, so the first
   n - ceil(4n/5) + 1 of both sets have one in common: no link is missed. The
   sample behind the order only decides which shingles come last.
4. Hubs. Candidates are also every node and, of the hubs of its keys, the one with
   which it shares most; a key's hub is the node with the largest share of shared
   keys, as a text with few changes is near most of its group. All candidates are
   verified by exact similarity, and components are formed: a group of many near
   copies so costs comparisons linear in its rows.
5. Rest. Under keys that still hold several components, pairs across components
   are formed where the key can be the first shingle that both hold: of sets of n
   and m shingles with at least o = ceil(4(n + m)/9) in common, that one has n - o
   and m - o shingles before it at most. Frequent shingles stand last, so few of
   the pairs that share only these are formed. Then the keys they share are
   counted: the set whose prefix ends first, of p shingles, lacks n - o of them in
   the other at most, and what the other holds of them stands in its prefix too; so
   a link shares p - (n - o) keys or more, n and p being those of one set or the
   other. Pairs that share enough are verified, the likeliest of each node first;
   pairs that fall into one component meanwhile need not be, and at last every pair
   that is left is.

Defined results: words are those of ``simhash``; a text of fewer words than a
shingle is one shingle; null, empty and blank texts are one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_rows, cut, discard, pick, release, small
from .components import components
from .simhash import SEED, bits_of, links

SHINGLE_WORDS = 5
#: A pair is linked from this similarity, as a fraction.
SIMILARITY = (4, 5)
#: One row in so many tells which shingles are frequent, and the least count of those among them.
SAMPLE, LEAST_COUNT, LEAST_SHARE = 16, 4, 4000
#: Tables of keys and nodes are broadcast up to this many rows, some 10 MB in the driver; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Times that only the likeliest pair of each node is verified, before all that are left.
BEST_ROUNDS = 1


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles, as signed longs."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the global order: as many as a partner cannot lack altogether."""
    n = len(shingles)
    keep = n + (-SIMILARITY[0] * n // SIMILARITY[1]) + 1 if n else 0
    if not len(frequent):
        return shingles[:keep]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    rank = np.where(frequent[at] == shingles, ranks[at], 0)
    return shingles[np.lexsort((shingles, rank))[:keep]]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(row, text) -> row, node, shingles: whole sets; a node is the hash of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(v.as_py()) for v in part.column(1)]
                nodes = np.array([node_of(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes), _lists(sets)], names=["row", "node", "shingles"])

    return rows.mapInArrow(run, "row long, node long, shingles array<long>")


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def prefix_sets(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, text) -> row, node, n, fp, prefix: size, SimHash and first shingles of the set.

    Only the first row of a node in a task carries the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes, sizes, prints, prefixes = [], [], [], []
                for v in part.column(1):
                    s = shingle_set(v.as_py())
                    node = node_of(s)
                    nodes.append(node)
                    sizes.append(len(s))
                    prints.append(bits_of(s.view(np.uint64)))
                    prefixes.append(s[:0] if node in seen else prefix_of(s, *frequent))
                    seen.add(node)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(nodes, pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array(np.array(prints, np.uint64).view(np.int64)),
                        _lists(prefixes),
                    ],
                    names=["row", "node", "n", "fp", "prefix"],
                )

    return rows.mapInArrow(run, "row long, node long, n int, fp long, prefix array<long>")


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many sampled rows hold, and their counts."""
    sampled = rows.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    least = max(LEAST_COUNT, -(-sampled.count() // LEAST_SHARE))
    counts = shingle_sets(sampled).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    found = counts.filter(F.col("c") >= least).toArrow()
    hashes, ranks = (found.column(k).to_numpy() for k in ("h", "c"))
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _sizes_fit(n, m):
    return (SIMILARITY[1] * F.least(n, m) >= SIMILARITY[0] * F.greatest(n, m))


def _shared_at_least(n, m):
    """Keys that sets of n and m shingles share if they are similar enough."""
    up, down = SIMILARITY
    both = F.ceil(up * (n + m) / (up + down))
    prefix = lambda k: k - F.ceil(k * up / down) + 1
    return F.least(prefix(n) - n + both, prefix(m) - m + both)


def _kept(found: DataFrame, *used: DataFrame) -> DataFrame:
    """``found`` as a table, and the tables it was made of deleted."""
    table = cut(found, "found")
    for done in used:
        discard(done)
    return table


def _counted(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b, met): the pairs whose sizes, and the number of keys they share, allow the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    lists = shared.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.collect_list("h").alias("keys"))
    lists = cut(lists, "lists")
    one, two = (lists.select(*[F.col(c).alias(f"{c}_{k}" if c != "node" else k) for c in ("node", "n", "keys")]) for k in "ab")
    met = pairs.join(one, "a").join(two, "b").withColumn("met", F.size(F.array_intersect("keys_a", "keys_b")))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    found = met.filter(_sizes_fit(n_a, n_b) & (F.col("met") >= _shared_at_least(n_a, n_b))).select("a", "b", "met")
    return _kept(found, lists)


def verified(pairs: DataFrame, rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is large enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = cut(heads.join(nodes, "node", "left_semi").select("row"), "asked")
    bodies = cut(shingle_sets(by_rows(rows, asked, "left_semi", BROADCAST_ROWS)).select("node", "shingles"), "bodies")
    one = bodies.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = bodies.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    up, down = SIMILARITY
    enough = (up + down) * both >= up * (F.size("x") + F.size("y"))
    return _kept(pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b"), bodies, asked)


def sketched(heads: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes whose fingerprints are alike: each with the smallest of its fingerprint, and of the smallest one near it."""
    classes = cut(heads.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    ends = cut(links(classes).groupBy("b").agg(F.min("a").alias("a")), "sketched")
    one, two = (classes.select(F.col("fp").alias(f), F.col("least").alias(k)) for f, k in (("x", "a"), ("y", "b")))
    across = ends.select(F.col("a").alias("x"), F.col("b").alias("y")).join(one, "x").join(two, "y").select("a", "b")
    within = heads.join(classes, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return _kept(across.unionByName(within), classes, ends)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hubs(shared: DataFrame) -> DataFrame:
    """(a, b): each node and, of the hubs of its keys, the one with which it shares most keys.

    A key's hub is its node with the largest share of shared keys.
    """
    popular = shared.groupBy("node").agg((F.count(F.lit(1)) / F.first("n")).alias("popular"))
    popular = cut(popular, "popular")
    ranked = cut(shared.join(popular, "node").select("h", "node", "n", "popular"), "ranked")
    hubs = cut(ranked.groupBy("h").agg(F.max(F.struct("popular", "node", "n")).alias("hub")), "hub")
    met = ranked.join(hubs, "h").filter((F.col("node") != F.col("hub.node")) & _sizes_fit(F.col("n"), F.col("hub.n")))
    met = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("met"))
    best = met.groupBy("node").agg(F.max_by("hub", F.struct("met", "hub")).alias("hub"))
    return _kept(best.select(F.col("node").alias("a"), F.col("hub").alias("b")), popular, ranked, hubs)


def _unlike_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, met): pairs of nodes of different components that share as many keys as their similarity takes."""
    placed = cut(shared.join(roots, "node", "left").select("h", "node", "n", "pos", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    mixed = cut(mixed, "mixed")
    open_keys = cut(placed.join(small(mixed, BROADCAST_ROWS), "h", "left_semi"), "open")
    left = open_keys.select("h", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "root")])
    right = open_keys.select(F.col("h").alias("k"), *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "root")])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    both = F.ceil(SIMILARITY[0] * (n_a + n_b) / sum(SIMILARITY))
    across = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_fit(n_a, n_b)
    # the first shingle of the order that both hold stands so early in either set
    early = (F.col("pos_a") <= n_a - both) & (F.col("pos_b") <= n_b - both)
    pairs = left.join(right, (F.col("h") == F.col("k")) & across & early).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    pairs = cut(pairs.distinct(), "pairs")
    found = _counted(pairs, placed)
    for done in (placed, mixed, open_keys, pairs):
        discard(done)
    return found


def _best(pairs: DataFrame) -> DataFrame:
    """Of each node the pair with most shared keys."""
    of_a = pairs.groupBy("a").agg(F.max_by("b", F.struct("met", "b")).alias("b")).select("a", "b")
    of_b = pairs.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a")).select("a", "b")
    return of_a.unionByName(of_b).distinct()


def _still_across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    one, two = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "met")


def similar_groups(docs: DataFrame, row_col: str, text_col: str = "text") -> DataFrame:
    """(row, group): rows of one group are linked, directly or through others.

    ``row_col`` is a key of each row, best the increasing id under which the table was written (``common.by_rows``).
    """
    spark, rows = docs.sparkSession, pick(docs, row=row_col, text=text_col)
    sets = cut(prefix_sets(rows, frequent_shingles(rows)), "sets")
    heads = cut(sets.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp")), "heads")
    # one shuffle by key tells which keys several nodes hold; nothing of it passes through the driver, whatever its size
    entries = sets.select(F.posexplode("prefix").alias("pos", "h"), "node", "n")
    same = Window.partitionBy("h")
    entries = entries.withColumn("first", F.min("node").over(same)).withColumn("last", F.max("node").over(same))
    shared = entries.filter(F.col("first") != F.col("last")).groupBy("h", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    shared = cut(shared, "shared")
    release(spark)
    nodes = cut(sets.select("row", "node"), "nodes")
    discard(sets)
    alike, hubs = sketched(heads), _hubs(shared)
    candidates = _kept(_ordered(alike.unionByName(hubs)), alike, hubs)
    counted = _counted(candidates, shared)
    tested = _kept(counted.select("a", "b"), counted, candidates)
    near = verified(tested, rows, heads)
    roots = cut(components(near), "roots")
    release(spark)

    unlike = _unlike_roots(shared, roots)
    rest = _kept(unlike.join(tested, ["a", "b"], "left_anti"), unlike, shared, roots)
    release(spark)
    for turn in range(BEST_ROUNDS + 1):
        # first the pair with most shared keys of each node, at last every pair that is still across components
        asked = rest if turn == BEST_ROUNDS else cut(_best(rest), "best")
        more = verified(asked.select("a", "b"), rows, heads)
        near = _kept(near.unionByName(more), near, more)
        roots = cut(components(near), "roots")
        rest = _kept(_still_across(rest.join(asked, ["a", "b"], "left_anti"), roots), rest, asked)
        release(spark)
        if turn == BEST_ROUNDS or rest.limit(1).count() == 0:
            break
        discard(roots)
    groups = cut(nodes.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("group")), "groups")
    for done in (nodes, heads, tested, near, rest, roots):
        discard(done)
    return groups
