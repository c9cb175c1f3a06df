"""Operator 9: token counts by heap-and-linked-list byte-pair merging.

The vocabulary file of a byte-pair model is read once per worker. A text becomes
a doubly linked list of symbols; a heap holds the adjacent pairs that form a
piece; the pair of lowest rank is merged until none is left. Ranks go by the
pieces' scores, best first, not by their places in the file; pairs of one score
are merged from the left.
Every merge removes one symbol, so the count is *initial symbols minus merges*
and no identifier is ever produced. A symbol outside the vocabulary falls back
to its UTF-8 bytes and therefore starts as that many symbols, none of which merge.

The list is run per segment: a cut is allowed only where no piece of the
vocabulary spans the two characters, which is verified when the model is loaded,
so the sum over segments equals the count over the whole text. Segment counts
are memoised in a bounded table.

Defined results: null text counts as empty; an empty text has 0 bytes and 0
tokens; rows are independent, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

SPACE = "▁"
LETTER = r"[^\W\d_]"
#: Entries that a worker's table of segment counts holds before it starts afresh.
MEMO_ENTRIES = 1_500_000
#: Longer segments are counted each time they occur.
MEMO_CHARS = 40


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of each field of one protobuf message."""
    at, end = 0, len(data)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, i
            shift += 7

    while at < end:
        key, at = varint(at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        yield number, wire, value


class PieceCounter:
    """Counts tokens of texts under a byte-pair ``.model`` file with byte fallback."""

    NORMAL, USER, UNUSED = 1, 4, 5

    def __init__(self, model: bytes):
        pieces: list[tuple[str, int, float]] = []
        identity, prefix = True, True
        for number, _, value in _fields(model):
            if number == 1:
                fields = {n: v for n, _, v in _fields(value)}
                score = struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0
                pieces.append((fields[1].decode(), fields.get(3, self.NORMAL), score))
            elif number == 3:
                fields = {n: v for n, _, v in _fields(value)}
                identity = fields.get(1) == b"identity" and not fields.get(4, 1)
                prefix = bool(fields.get(3, 1))
        if not identity or any(kind in (self.USER, self.UNUSED) for _, kind, _ in pieces):
            raise NotImplementedError("only models without normalisation, user-defined or unused pieces are supported")
        normal = {piece: score for piece, kind, score in pieces if kind == self.NORMAL}
        ranks = {score: at for at, score in enumerate(sorted(set(normal.values()), reverse=True))}
        self.rank = {piece: ranks[score] for piece, score in normal.items()}
        self.prefix = SPACE if prefix else ""
        self.segments = self._cuts()
        self.memo: dict[str, int] = {}

    def _cuts(self) -> re.Pattern:
        """The finest of our segment patterns that no piece crosses."""
        letter = re.compile(LETTER)

        def kind(c: str) -> int:
            return 0 if c == SPACE else 1 if letter.match(c) else 2

        seen = {(kind(a), kind(b)) for piece in self.rank for a, b in zip(piece, piece[1:], strict=False)}
        if not seen & {(1, 2), (2, 1), (1, 0), (2, 0)}:
            return re.compile(rf"{SPACE}*{LETTER}+|{SPACE}*(?:(?!{LETTER})[^{SPACE}])+|{SPACE}+")
        if not seen & {(1, 0), (2, 0)}:
            return re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(r"(?s).+")

    def segment(self, text: str) -> int:
        """Tokens of one segment."""
        rank = self.rank
        n = len(text)
        parts: list[str | None] = list(text)
        symbols = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in parts)
        if n == 1:
            return symbols
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(text[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        merges = 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, left, size = pop(heap)
            head = parts[left]
            if head is None:
                continue
            right = after[left]
            if right >= n or len(head) + len(parts[right]) != size:
                continue
            merged = head + parts[right]
            parts[left], parts[right] = merged, None
            merges += 1
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                r = rank.get(merged + parts[nxt])
                if r is not None:
                    push(heap, (r, left, size + len(parts[nxt])))
            prev = before[left]
            if prev >= 0:
                r = rank.get(parts[prev] + merged)
                if r is not None:
                    push(heap, (r, prev, len(parts[prev]) + size))
        return symbols - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        memo, total = self.memo, 0
        for part in self.segments.findall(self.prefix + text.replace(" ", SPACE)):
            got = memo.get(part)
            if got is None:
                got = self.segment(part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[part] = got
            total += got
        return total


_LOADED: dict[str, PieceCounter] = {}


def counter_of(path: str) -> PieceCounter:
    """The worker's counter for a model file, loaded at its first use."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = PieceCounter(f.read())
    return _LOADED[path]


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``model_path`` is a vocabulary file installed on every machine. Nothing is
    shuffled: each row is counted where it is read.
    """
    rows = pick(docs, id=id_col, text=text_col)
    schema = f"{id_col} {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_path)
        for batch in batches:
            texts = batch.column(1)
            sizes, counts = [], []
            for value in texts:
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
