"""Operator 10: benchmark decontamination by SimHash of item-sized windows.

DataFrame functions only. Texts and items become lower-case words of letters and
digits and shingles of ``SHINGLE_WORDS`` words; a window of an item's number of
shingles slides over each text.

1. Anchors. A window and an item of m shingles whose weighted similarity is 0.8
   or more lack at most m/5 of the item's shingles, so floor(m/5) + 1 distinct
   shingles of the item are enough for every such window to hold one of them.
   Windows without an anchor are left out; nothing within the similarity is lost.
2. SimHash. Every window around an anchor gets a 64-bit fingerprint. The shingles
   that windows are made of are gathered in stretches as long as two of the longest
   item, so that a window reads one stretch and no text, however many passages it
   holds, is gathered whole.
3. Multi-index Hamming blocks. Fingerprints are cut into 8 bytes. Two within
   ``RADIUS`` = 23 bits agree in some byte up to 2 bits, so items are stored
   under the 37 values around each byte and windows are looked up by their 8
   bytes and the window size: no pair within the radius is missed. At similarity
   0.8 the expected distance is 10 bits with a deviation of 3.
4. Verification. Candidates are compared by exact weighted Jaccard similarity,
   the weight of a shingle being its number of occurrences.

Defined results: null and empty texts and items match nothing; a text or item of
fewer words than a shingle counts as one shingle, its whole sequence; a text
shorter than an item is one window; rows that repeat an id are reported once for
each item, with their best window; null ids of documents and items are reported
as null; items that repeat an id are each compared by themselves.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, small

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Tables made of the benchmark are broadcast up to this many rows; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles of the items that are broadcast with them at most.
BROADCAST_SHINGLES = 4_000_000
#: Shingles of a stretch at least.
LEAST_STRETCH = 256
NOT_WORD = r"[^\p{L}\p{N}]+"
LANES = 32
LANE_MASK = (1 << 32) | 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def shingle_at(words: Column, place: Column) -> Column:
    """Hash of the shingle that starts at a place (from 0); places beyond the end are skipped."""
    return F.xxhash64(*[F.get(words, place + i) for i in range(SHINGLE_WORDS)])


def shingle_count(words: Column) -> Column:
    n = F.size(words)
    return F.when(n == 0, 0).otherwise(F.greatest(n - (SHINGLE_WORDS - 1), F.lit(1)))


def _shingles(words: Column, first: Column, last: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda i: shingle_at(words, i))


def print_of(hashes: Column) -> Column:
    """SimHash of an array of shingle hashes: the bits set in more than half of them.

    Two 32-bit counters share a long, so 32 folds count all 64 bits.
    """
    out = F.lit(0).cast("long")
    size = F.size(hashes)
    for j in range(LANES):
        lane = F.aggregate(
            hashes,
            F.lit(0).cast("long"),
            lambda total, h: total + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANE_MASK)),  # noqa: B023
        )
        for b, count in ((j, lane.bitwiseAND(F.lit((1 << 32) - 1))), (j + LANES, F.shiftrightunsigned(lane, 32))):
            bit = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(2 * count > size, bit).otherwise(F.lit(0).cast("long")))
    return out


def shared_weight(window: Column, item: Column) -> Column:
    """Sum over shingles of the smaller number of occurrences, of two arrays of hashes."""
    once = (F.size(F.array_distinct(window)) == F.size(window)) & (F.size(F.array_distinct(item)) == F.size(item))
    times = lambda hashes, h: F.size(F.filter(hashes, lambda x: x == h))
    counted = F.aggregate(
        F.array_distinct(item), F.lit(0), lambda total, h: total + F.least(times(window, h), times(item, h))
    )
    return F.when(once, F.size(F.array_intersect(window, item))).otherwise(counted)


def item_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """key, item, m, shingles, fp of the benchmark's items that have words; each row has a key of its own."""
    items = pick(benchmark, item=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("key"), "item", words_of(F.col("text")).alias("words")
    )
    items = items.withColumn("m", shingle_count(F.col("words"))).filter("m > 0")
    items = items.select("key", "item", "m", _shingles(F.col("words"), F.lit(0), F.col("m") - 1).alias("shingles"))
    return cut(items.withColumn("fp", print_of(F.col("shingles"))), "items")


def anchors_of(items: DataFrame) -> DataFrame:
    """(h, m): the shingles of each item that a similar window cannot lack altogether."""
    least = F.slice(F.array_sort(F.array_distinct("shingles")), F.lit(1), F.floor(F.col("m") / 5).cast("int") + 1)
    return items.select("m", F.explode(least).alias("h")).distinct()


def _byte(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _near_values(fp: Column) -> Column:
    """(block, value) for every value that a block of a fingerprint within the radius can take."""
    errors = RADIUS // BLOCKS
    masks = [sum(1 << b for b in bits) for n in range(errors + 1) for bits in combinations(range(BLOCK_BITS), n)]

    def around(block: int) -> Column:
        at = lambda mask: F.struct(F.lit(block).alias("block"), _byte(fp, block).bitwiseXOR(mask).alias("value"))
        return F.transform(F.array(*[F.lit(mask).cast("long") for mask in masks]), at)

    return F.flatten(F.array(*[around(block) for block in range(BLOCKS)]))


def candidate_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows (m, fp, ...) and items (key, item, m, shingles, fp) -> one row for each pair within the radius."""
    stored = small(
        items.select("key", "m", F.col("fp").alias("item_fp"), F.explode(_near_values(F.col("fp"))).alias("at")).select(
            "key", "m", "item_fp", "at.block", "at.value"
        ),
        BROADCAST_ROWS,
    )
    asked = windows.select(
        *windows.columns, F.posexplode(F.array(*[_byte(F.col("fp"), k) for k in range(BLOCKS)])).alias("block", "value")
    )
    other = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair can meet in several blocks; it counts in the first of them
    earlier = F.lit(False)
    for k in range(BLOCKS - 1):
        earlier = earlier | ((F.col("block") > k) & (F.bit_count(_byte(other, k)) <= RADIUS // BLOCKS))
    met = asked.join(stored, ["m", "block", "value"]).filter((F.bit_count(other) <= RADIUS) & ~earlier)
    return met.drop("block", "value", "item_fp", "fp").join(
        small(items.select("key", "item", "shingles"), BROADCAST_SHINGLES, F.size("shingles")), "key"
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Contaminated documents: one row per (document id, item): id, item_id, similarity, start, n_shingles.

    ``start`` is the place, in words from 0, of the document's most similar window.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the anchors guarantee similarities from {SIMILARITY}")
    items = item_table(benchmark, item_col, item_text_col)
    anchors = small(cut(anchors_of(items), "anchors"), BROADCAST_ROWS)
    rows = pick(docs, id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "id", words_of(F.col("text")).alias("words")
    )
    rows = rows.withColumn("n", shingle_count(F.col("words"))).filter("n > 0")
    each = rows.select("row", "id", "n", "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    hits = each.withColumn("h", shingle_at(F.col("words"), F.col("place"))).join(anchors, "h")
    first = F.greatest(F.lit(0), F.col("place") - F.col("m") + 1)
    last = F.least(F.col("n") - 1, F.col("place") + F.col("m") - 1)
    hits = cut(
        hits.select("row", "id", "n", "m", "place", first.alias("first"), _shingles(F.col("words"), first, last).alias("around")),
        "hits",
    )
    # the shingles around anchors, once each and in order: a stretch and the one after it are as long as any window needs
    stretch = max(LEAST_STRETCH, items.agg(F.max("m").alias("m")).first().m or 0)
    own = F.floor(F.col("place") / stretch)
    near = (
        hits.select("row", F.posexplode("around").alias("off", "h"), "first")
        .groupBy("row", (F.col("first") + F.col("off")).alias("place"))
        .agg(F.first("h").alias("h"))
        .select("row", F.explode(F.array(own, own - 1)).alias("stretch"), "place", "h")
        .groupBy("row", "stretch")
        .agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("near"))
        .select("row", "stretch", F.col("near.place").alias("places"), F.col("near.h").alias("hashes"))
    )
    size = F.least("m", "n")
    windows = (
        hits.select("row", "id", "m", size.alias("size"), "first", F.least(F.col("place"), F.col("n") - size).alias("most"))
        .select("row", "id", "m", "size", F.explode(F.sequence("first", "most")).alias("start"))
        .distinct()
        .withColumn("stretch", F.floor(F.col("start") / stretch))
        .join(near, ["row", "stretch"])
    )
    windows = windows.select(
        "row", "id", "m", "start", F.slice("hashes", F.array_position("places", F.col("start")).cast("int"), F.col("size")).alias("window")
    )
    windows = windows.withColumn("fp", print_of(F.col("window")))
    both = shared_weight(F.col("window"), F.col("shingles"))
    found = (
        candidate_pairs(windows, items)
        .withColumn("size", F.size("window"))
        .withColumn("both", both)
        .withColumn("similarity", F.col("both") / (F.col("size") + F.col("m") - F.col("both")))
        .filter(F.col("similarity") >= similarity)
    )
    best = F.max_by(F.struct("similarity", "start", "size"), F.struct("similarity", -F.col("start"))).alias("best")
    return found.groupBy("id", "item").agg(best).select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.round("best.similarity", 6).alias("similarity"),
        F.col("best.start").cast("long").alias("start"),
        F.col("best.size").cast("long").alias("n_shingles"),
    )
