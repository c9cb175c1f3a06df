"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import WRITTEN, cut, discard, release, small, sweep

__all__ = ["WRITTEN", "by_rows", "cut", "discard", "fold", "pick", "read_table", "release", "small", "sweep", "words_count"]

#: Bits of ``monotonically_increasing_id`` below the number of the partition.
PARTITION_BITS = 33
#: Characters that separate words in every contract of this subpackage.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_RE = rf"[^{SPACE_CLASS}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path only ever reaches Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, renamed; extra columns cannot clash later.

    A column the input lacks is taken as null.
    """
    have = {c: i for i, c in enumerate(df.columns)}
    kinds = {"id": "long", "text": "string", "source": "string"}
    return df.select(
        *[
            (F.col(f"`{src}`") if src in have else F.lit(None).cast(kinds.get(new, "string"))).alias(new)
            for new, src in columns.items()
        ]
    )


def words_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split between learning and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def by_rows(table: DataFrame, rows: DataFrame, how: str, most: int, weight: Column | None = None) -> DataFrame:
    """``table`` joined with ``rows`` on ``row`` (left_semi, left_anti or left); no row of ``table`` is shuffled.

    Both are tables that ``cut`` returned, ``row`` is the monotonically increasing
    id under which ``table`` was written, and ``rows`` has each at most once. The
    table is read in ranges of whole partitions, whose rows together weigh ``most``
    (each counts as 1, or as ``weight``), and each range meets only its own part of
    ``rows``, by broadcast. What reaches the driver is a sum for each partition. A
    partition that weighs more by itself is joined by shuffle.
    """
    part = F.shiftright("row", PARTITION_BITS).alias("part")
    sums = rows.groupBy(part).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    ranges: list[list[int]] = [[0, 0, 0]]  # first partition, last partition, weight
    for p, n in sorted((r.part, r.n) for r in sums.collect()):
        if ranges[-1][2] + n <= most:
            ranges[-1][1:] = [p, ranges[-1][2] + n]
        else:
            ranges.append([p, p, n])
    found, low = [], None
    for k, (_, last, n) in enumerate(ranges):
        inside = F.lit(True) if low is None else F.col("row") >= low
        low = (last + 1) << PARTITION_BITS
        if k + 1 < len(ranges):
            inside = inside & (F.col("row") < low)
        asked = rows.filter(inside)
        found.append(table.filter(inside).join(F.broadcast(asked) if n <= most else asked, "row", how))
    return reduce(DataFrame.unionByName, found)
