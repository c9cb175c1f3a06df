"""Operator 4: SimHash near-duplicates by Golay-code fuzzy hashing.

A text's 64-bit fingerprint takes the majority of each bit over the XXH64 hashes
of its word shingles. Rows with one fingerprint form a class; only classes are
compared. To find every pair within ``RADIUS`` = 4 bits, a fingerprint is cut
into three segments (22, 21 and 21 bits), each read as a word of the perfect
binary Golay code (23, 12, 7):

* if some segment has no error, the exact segment is a shared key;
* otherwise at least two segments have exactly one error each (4 errors in 3
  segments, each at least 1), and for a pair of segments both words lie within
  one bit of their partners'.

A word's index key is the codeword it decodes to (distance 3 at most). A word
one bit away decodes to a codeword at distance 4 at most, so probing with every
codeword within distance 4 cannot miss: that is the decoded codeword alone when
the word lies within distance 2 of it, and 5 more codewords at distance 3. A pair
key joins two codeword indices (24 bits), so a fingerprint is stored under 6 keys
and probes with about 88. Candidates are verified by their exact distance within
the join itself, and the links go through connected components.

Copies: rows of one fingerprint are merged by a partial aggregate before any key
is made, and get their component back by a join whose sides are both tables.
A bucket of keys holds different fingerprints only; the number of comparisons
grows with the square of their number divided by 2 ** 21.

Defined results: null text counts as empty; a text without words has fingerprint
zero, which links like any other; fewer words than a shingle hash as one
sequence; rows that repeat an id or text share their class; a null id never
names a component, and one of null ids only is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, pick
from .components import components

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Bits of the three segments, and the generator polynomial of the code.
SEGMENTS = (22, 21, 21)
GENERATOR = 0b101011100011
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles; zero without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(parts) - words + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return bits_of(np.array(hashes, np.uint64))


def bits_of(whole: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(whole), BLOCK):
        block = whole[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(whole), bitorder="little").view(np.uint64)[0])


def _syndrome(word: int) -> int:
    """Remainder of a 23-bit word by the generator."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high 11 bits, error patterns by syndrome, their count).

    The first pattern of a syndrome is the one of least weight; the others have weight 4.
    """
    low = np.array([_syndrome(w) for w in range(1 << 12)], np.int64)
    high = np.array([_syndrome(w << 12) for w in range(1 << 11)], np.int64)
    of_bit = [_syndrome(1 << b) for b in range(23)]
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = syndrome = 0
            for b in bits:
                error |= 1 << b
                syndrome ^= of_bit[b]
            patterns[syndrome].append(error)
    table = np.array([p + [0] * (6 - len(p)) for p in patterns], np.int64)
    return low, high, table, np.array([len(p) for p in patterns], np.int64)


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords near each word, nearest first, and which of them count."""
    low, high, table, sizes = code_tables()
    syndromes = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ table[syndromes]) >> 11, np.arange(6)[None, :] < sizes[syndromes][:, None]


def keys_of(prints: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the index and for the probe: (row number, key) pairs of uint64 fingerprints."""
    segments, shift = [], 0
    for bits in SEGMENTS:
        segments.append(((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        shift += bits
    rows = np.arange(len(prints))
    index = [(rows, (np.int64(s) << 32) | seg) for s, seg in enumerate(segments)]
    probe = list(index)
    near = [codeword_indices(seg) for seg in segments]
    for n, (i, j) in enumerate(combinations(range(3), 2), 3):
        (a, a_ok), (b, b_ok) = near[i], near[j]
        both = (np.int64(n) << 32) | (a[:, :, None] << 12) | b[:, None, :]
        counts = a_ok[:, :, None] & b_ok[:, None, :]
        index.append((rows, both[:, 0, 0]))
        at = np.nonzero(counts)
        probe.append((at[0], both[at]))
    return tuple(tuple(np.concatenate(part) for part in zip(*side, strict=True)) for side in (index, probe))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(v.as_py()) for v in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def _keyed(classes: DataFrame, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(signed), 2048):
                part = signed[at : at + 2048]
                rows, keys = keys_of(part.view(np.uint64))[side]
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys)], names=["fp", "k"])

    return classes.select("fp").mapInArrow(run, "fp long, k long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: every pair of different fingerprints within the radius; a pair can occur more than once."""
    if radius > RADIUS:
        raise ValueError(f"the keys guarantee distances up to {RADIUS}")
    index = _keyed(classes, 0).withColumnRenamed("fp", "a")
    probe = _keyed(classes, 1).withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return index.join(probe, (index.k == probe.k) & (F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = cut(fingerprints(docs, id_col, text_col), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = cut(components(links(classes, radius)), "roots")
    placed = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    of_root = cut(placed.groupBy("root").agg(F.min("least").alias("component")), "components")
    # tables on either side: where a text is copied a million times, adaptive execution splits its partition
    of_class = cut(placed.join(of_root, "root").select("fp", "component"), "members")
    for done in (classes, roots, placed, of_root):
        discard(done)
    return prints.join(of_class, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
