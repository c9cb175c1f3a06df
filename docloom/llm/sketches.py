"""Operator 13: document fingerprints by threshold-scaled sketches.

DataFrame functions only. A text's words, A-Z in lower case, give shingles of
``SHINGLE_WORDS`` words; a sketch keeps the hash of every different shingle that is
below a fixed fraction (1 in ``KEPT_ONE_IN``) of the range of hashes. What a sketch
keeps depends on each shingle alone, not on the text's length, so

* the sketch of two texts together is the union of theirs (``merged``), and
* the share of one text's shingles that another holds is estimated by the share of
  kept hashes, however unequal their lengths are (``containment``).

A text of few shingles would keep none, so a sketch has a limit of its own: the
fraction, or where fewer than ``LEAST_KEPT`` hashes lie below it the hash of that rank,
or the whole range if the text has no more shingles. A sketch is complete below its
limit; two are compared, or merged, below the smaller limit of both.

A fingerprint is the sketch as text: the limit and the kept hashes in order, 16
hexadecimal digits each. Equal texts have equal fingerprints.

``likeness`` of two sketches is the number of hashes both hold, by the number of
the smaller one (containment of the shorter text in the longer): 1 for equal texts
and for two texts without words, 0 where one has words and the other none. With
``LEAST_KEPT`` = 64 hashes its standard deviation is 0.06 at most, and texts of
up to 64 shingles are compared exactly.

Neighbours. The next document in descending order of ids stands in another row
than its own. Documents are cut into ranges of about ``RANGE_ROWS`` at exact borders;
each goes to its range, and the first of each range also, as a guest, to the range
before it (of the first range: to the last). So every document finds the next one in its
own range, and a text is shuffled once.

Defined results: null texts are empty; documents of null ids come after all others,
documents of one id are ordered by a hash of their texts; rows that are equal
follow each other; a single document is its own next. A text of fewer words than a
shingle is one shingle; one without words has an empty sketch. Ids are longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import SPACE_CLASS, pick

SHINGLE_WORDS = 5
KEPT_ONE_IN, LEAST_KEPT = 16, 64
#: Hashes are 63-bit numbers.
WHOLE_RANGE = 2**63 - 1
FRACTION = WHOLE_RANGE // KEPT_ONE_IN
#: Documents of a range on average, unless there are more than ``MOST_RANGES`` of them: borders are a literal.
RANGE_ROWS, MOST_RANGES = 4096, 1 << 16
#: A-Z, which alone are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[{SPACE_CLASS}]+", -1), "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text, in its order, from 0 to 2 ** 63 - 1."""

    def hashes(words: Column) -> Column:
        last = F.greatest(F.size(words) - SHINGLE_WORDS, F.lit(0))
        at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]).bitwiseAND(F.lit(WHOLE_RANGE))
        return F.when(F.size(words) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), last), at))

    return bind(words_of(text), hashes)


def sketch(text: Column) -> Column:
    """struct(limit, kept): the sorted different hashes up to the limit."""

    def scaled(every: Column) -> Column:
        below = F.sort_array(F.array_distinct(F.filter(every, lambda h: h <= F.lit(FRACTION))))
        return bind(below, lambda b: F.when(F.size(b) >= LEAST_KEPT, _limited(F.lit(FRACTION), b)).otherwise(least(every)))

    def least(every: Column) -> Column:
        return bind(
            F.sort_array(F.array_distinct(every)),
            lambda s: F.when(F.size(s) <= LEAST_KEPT, _limited(F.lit(WHOLE_RANGE), s)).otherwise(
                _limited(F.get(s, LEAST_KEPT - 1), F.slice(s, 1, LEAST_KEPT))
            ),
        )

    return bind(shingle_hashes(text), scaled)


def _limited(limit: Column, kept: Column) -> Column:
    return F.struct(limit.cast("long").alias("limit"), kept.alias("kept"))


def _up_to(one: Column, limit: Column) -> Column:
    return F.filter(one["kept"], lambda h: h <= limit)


def merged(one: Column, two: Column) -> Column:
    """The sketch of two texts together, complete up to the smaller limit."""
    return bind(F.least(one["limit"], two["limit"]), lambda t: _limited(t, F.sort_array(F.array_union(_up_to(one, t), _up_to(two, t)))))


def _compared(one: Column, two: Column, share) -> Column:
    """``share`` of the kept hashes of both, below the smaller limit."""
    both = bind(F.least(one["limit"], two["limit"]), lambda t: F.struct(_up_to(one, t).alias("a"), _up_to(two, t).alias("b")))
    return bind(both, lambda x: share(x["a"], x["b"]))


def containment(one: Column, two: Column) -> Column:
    """Share of the first text's shingles that the second one holds; 1 for a text without words."""
    return _compared(one, two, lambda a, b: F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)))


def likeness(one: Column, two: Column) -> Column:
    """Share of the smaller sketch's hashes that both hold."""

    def share(a: Column, b: Column) -> Column:
        fewer = F.least(F.size(a), F.size(b))
        equal = ((F.size(one["kept"]) == 0) & (F.size(two["kept"]) == 0)).cast("double")
        return F.when(fewer == 0, equal).otherwise(F.size(F.array_intersect(a, b)) / fewer)

    return _compared(one, two, share)


def fingerprint(of: Column) -> Column:
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(digits(of["limit"]), F.lit(":"), F.array_join(F.transform(of["kept"], digits), ""))


def _place(doc_id: Column, text: Column) -> Column:
    """A value in ascending order of which documents follow each other: ids fall, and null comes last."""
    return F.struct(doc_id.isNull().alias("none"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("id"), F.xxhash64(text).alias("h"))


def _range_of(place: Column, borders: list) -> Column:
    """The last border at or below a place, found by halves; before the first one, as if it stood there."""
    table = F.array(*[F.struct(F.lit(b.none).alias("none"), F.lit(b.id).cast("long").alias("id"), F.lit(b.h).cast("long").alias("h")) for b in borders])

    def halve(span: Column, _: Column) -> Column:
        return bind(
            F.floor((span["low"] + span["high"] + 1) / 2).cast("int"),
            lambda middle: F.when(F.get(table, middle) <= place, F.struct(middle.alias("low"), span["high"].alias("high"))).otherwise(
                F.struct(span["low"].alias("low"), (middle - 1).alias("high"))
            ),
        )

    span = F.struct(F.lit(0).alias("low"), F.lit(len(borders) - 1).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(max(1, (len(borders) - 1).bit_length())))
    return F.aggregate(steps, span, halve)["low"]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text, next: the next document's text in descending order of ids; after the last, the first's."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", _place(F.col("doc_id"), F.col("text")))
    ranges = min(MOST_RANGES, max(1, -(-docs.count() // RANGE_ROWS)))
    # the first place of each range: exact, as the ranges are made of all places
    dealt = keyed.select("place").repartitionByRange(ranges, "place")
    borders = sorted(r.first for r in dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("place").alias("first")).collect())
    if not borders:
        return docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("").alias("next")).limit(0)
    own = keyed.withColumn("own", _range_of(F.col("place"), borders))
    first = F.array(*[F.struct(F.lit(b.none).alias("none"), F.lit(b.id).cast("long").alias("id"), F.lit(b.h).cast("long").alias("h")) for b in borders])
    here = F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))
    there = F.struct(F.pmod(F.col("own") - 1, F.lit(len(borders))).alias("range"), F.lit(True).alias("guest"))
    to = F.when(F.col("place") == F.get(first, F.col("own")), F.array(here, there)).otherwise(F.array(here))
    sent = own.select("doc_id", "text", "place", F.explode(to).alias("to")).select("doc_id", "text", "place", "to.range", "to.guest")
    order = Window.partitionBy("range").orderBy("guest", "place")
    return sent.withColumn("next", F.lead("text").over(order)).filter("NOT guest").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text's last half, rounded down, is replaced by as much of the next
    document's beginning as there is.
    """
    rows = with_next(pick(docs, doc_id=id_col, text=text_col))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next", half))
    made = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("own"), sketch(F.col("next")).alias("following"))
    made = made.withColumn("other", sketch(F.col("edited")))
    return made.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
