"""Operator 5: mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame functions only. Each document gets an exponential key, -ln(u) / w,
where u comes from a hash of its id and w is a quality weight read off its text;
taking keys in ascending order samples without replacement with probability
proportional to w. Within a source, sizes are prefix-summed in key order up to
the source's token budget. A budget above the source's size first takes whole
epochs of the source; only the rest is selected by key.

The prefix sum is distributed: a source's documents are dealt into buckets by
the exact distribution function of its keys (a mixture of exponentials, one for
each weight level, whose shares are counted), so buckets hold about
``BUCKET_ROWS`` documents whatever the size of the source, and only the buckets'
totals are summed across a source. Rows that share key, source and size stand side
by side in the order and are one row with a count until the end, so a repeated id,
however often it occurs, gives a bucket no more rows than it has different sizes.
The table of sources, a row each, is ordered in one task.

Defined results: a null or empty text has size 0 and takes 0; a null source is a
source of its own, the last in order; rows that repeat an id share a key and are
ordered by size, and of equal rows as many as the budget holds are taken; a null id
counts as its text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, words_count

#: Weights of the sources in their order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
MOST_EPOCHS = 3
#: Levels of the quality weight, from the share of characters that are neither letters nor spaces.
WEIGHT_LEVELS = ((0.05, 1.0), (0.15, 0.75), (0.30, 0.5))
LEAST_WEIGHT = 0.25
LEVELS = (*(w for _, w in WEIGHT_LEVELS), LEAST_WEIGHT)
LEVEL_COUNTS = [f"n_level{i}" for i in range(len(LEVELS))]
BUCKET_ROWS = 2048
#: Copies of a row that are written out at a time.
COPY_BLOCK = 10_000
NOT_PROSE = r"[\p{L} ]+"


def quality_weight(text: Column) -> Column:
    """1.0, 0.75, 0.5 or 0.25, the less of the text is letters and spaces; empty or null: 1.0."""
    share = F.length(F.regexp_replace(text, NOT_PROSE, "")) / F.length(text)
    level = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 1.0)
    for most, weight in WEIGHT_LEVELS:
        level = level.when(share <= most, weight)
    return level.otherwise(LEAST_WEIGHT)


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of the seed and the id; without an id, of the seed and the text."""
    null = F.concat(F.lit("null:"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), null))
    whole = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (whole + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size, level counts -> the same with place, weight and target.

    Weights repeat over the sources by code point, null last. The share of a
    source stops at ``MOST_EPOCHS`` times its size and the excess goes to the
    others by weight. In order of cap per weight, a source is capped exactly if
    the caps and shares at its own level stay below the whole, so the fixed point
    needs two sorts of the table of sources and no iteration.
    """
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(
        F.array(*map(F.lit, map(float, SOURCE_WEIGHTS))), (F.col("place") % len(SOURCE_WEIGHTS) + 1).cast("int")
    )
    caps = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(MOST_EPOCHS)))
    caps = caps.withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    filled = (
        caps.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("caps_to", F.sum("cap").over(by_level))
        .withColumn("weights_after", F.sum("weight").over(whole) - F.sum("weight").over(by_level))
        .withColumn("capped", F.col("caps_to") + F.col("level") * F.col("weights_after") < F.col("total"))
    )
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * (rest / open_weight))
    )
    return filled.select(
        "source", "place", "n_docs", "source_size", "weight", target.alias("target"), *LEVEL_COUNTS
    )


def mix_sources(
    docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, quality, epochs, taken.

    ``taken`` is the number of words the mix takes from the document, repeats
    counted: its size times the whole epochs of its source, once more if its key
    falls within the rest of the budget. The last document selected is the one
    whose middle still lies within the budget, so a source is off its target by
    half a document at most.
    """
    rows = pick(docs, id=id_col, text=text_col, source=source_col).select(
        "id",
        "source",
        words_count(F.col("text")).alias("size"),
        quality_weight(F.col("text")).alias("quality"),
        uniform(F.col("id"), F.col("text"), seed).alias("u"),
    )
    rows = cut(rows.withColumn("key", -F.log("u") / F.col("quality")).drop("u"), "mix")
    sizes = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("size").alias("source_size"),
        *[F.count(F.when(F.col("quality") == w, 1)).alias(n) for w, n in zip(LEVELS, LEVEL_COUNTS, strict=True)],
    )
    targets = source_targets(sizes).withColumnRenamed("source", "of")
    groups = rows.groupBy("id", "source", "size", "quality", "key").agg(F.count(F.lit(1)).alias("copies"))
    dealt = groups.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    below = sum(
        (F.col(n) * (1.0 - F.exp(-F.col("key") * w)) for w, n in zip(LEVELS, LEVEL_COUNTS, strict=True)), F.lit(0.0)
    )
    bucket = F.floor(below / BUCKET_ROWS).cast("long")
    dealt = dealt.select(
        "id", "source", "place", "size", "copies", "source_size", "target", "quality", "key", bucket.alias("bucket")
    )
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("place", "bucket")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
        .select("place", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("place", "bucket").orderBy("key", "id", "size")
    summed = dealt.withColumn(
        "upto", F.sum(F.col("size") * F.col("copies")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    ).join(before, ["place", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    end = F.col("before") + F.col("upto")
    one = F.when(2.0 * end - F.col("size") <= 2.0 * budget, 1).otherwise(0)
    # of several copies in a row those whose middles lie within the budget
    start = end - F.col("size") * F.col("copies")
    some = F.greatest(F.lit(0), F.least(F.col("copies"), F.floor((budget - start) / F.greatest(F.col("size"), F.lit(1)) + 0.5)))
    chosen = F.when(F.col("copies") == 1, one).otherwise(some).cast("long")
    counted = summed.withColumn("epochs", epochs.cast("long")).withColumn("chosen", chosen)
    # the copies again, in blocks: no array grows with their number
    each = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPY_BLOCK))))
    last = F.least(F.col("copies"), (F.col("block") + 1) * COPY_BLOCK) - 1
    each = each.withColumn("copy", F.explode(F.sequence(F.col("block") * COPY_BLOCK, last)))
    return each.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        "quality",
        "epochs",
        (F.col("size") * (F.col("epochs") + F.when(F.col("copy") < F.col("chosen"), 1).otherwise(0))).cast("long").alias("taken"),
    )
