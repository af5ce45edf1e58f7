"""Harmonic packing of token sequences: classes by reciprocal capacity, filled apart by each task."""

from __future__ import annotations

from collections.abc import Iterator
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import slices, text_or_empty
from accesswatch.llm.tokens import Encoder, groups_of

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def cut_lengths(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole capacities, then halves down to ``least``, then the rest."""
    lengths = [capacity] * (n // capacity)
    n, size = n % capacity, capacity // 2
    while size >= least and n:
        if n >= size:
            lengths.append(size)
            n -= size
        size //= 2
    return lengths + [n] * bool(n)


def powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class Packer:
    """Bins of one task. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, capacity: int, least: int, first_sequence: int):
        self.capacity, self.least, self.next = capacity, least, first_sequence
        self.bins: dict[int, list[tuple]] = defaultdict(list)
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        start, total = 0, len(ids) // 4
        for n in cut_lengths(total, self.capacity, self.least):
            k = self.capacity // n
            held = self.bins[k]
            held.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            if len(held) == k:
                self._sequence(held)
                self.bins[k] = []
            start += n

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, self.next, offset))
            offset += n
        self.next += 1

    def close(self) -> None:
        """Unfilled bins, at most one a class, run on into whole sequences and powers of two."""
        left = [p for k in sorted(self.bins) for p in self.bins[k]]
        total = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids, of = left.pop()
                n = min(size, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * n], of))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n :], of))
                size -= n
            self._sequence(pieces)
        self.bins.clear()

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            for i in range(0, len(self.out), 8192):
                columns = zip(*self.out[i : i + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW
                )
            self.out = []


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, least: int = 64, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents placed in sequences of at most ``capacity`` tokens, with their ids.

    ``ids`` are little-endian unsigned 32-bit numbers. Each document's tokens and ``end_id`` are cut into pieces
    of ``capacity``, its halves down to ``least``, and a rest below ``least``; a piece of n tokens is of class
    k = capacity // n, and k pieces of a class fill a sequence. Only sequences of class rests are padded,
    by less than one part in k + 1. Each task fills its own bins and no rows are shuffled; what its open bins hold in the end
    (fewer than k pieces a class) runs on into whole sequences and sequences whose length is a power of
    two, so nothing else is padded. ``capacity`` must be a power of two.

    Null and empty texts are the end id alone. Repeated rows are packed each. A null document id stays null.
    """
    if capacity & (capacity - 1) or least & (least - 1):
        raise ValueError("capacity and least must be powers of two")
    end = end_id.to_bytes(4, "little")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        packer = Packer(capacity, least, TaskContext.get().partitionId() << 32)
        for batch in slices(batches, "text"):
            ids, at = batch["doc_id"].to_pylist(), 0
            for run in groups_of(batch["text"].to_pylist()):
                for tokens in encoder.encode(run):
                    packer.add(ids[at], tokens + end)
                    at += 1
                yield from packer.batches(8192)
        packer.close()
        yield from packer.batches(1)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(fill, PIECES)
