"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import cut, slices, text_digest, text_or_empty

_UPPER = range(0x41, 0x5B)
_APART = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Bytes of words: 0-9, a-z and all beyond ASCII; A-Z become a-z, the rest a space.
_TABLE = bytes(0x20 if b in _APART else b + 32 if b in _UPPER else b for b in range(256))
#: Bytes of benchmark words that a task holds at a time.
MAX_BYTES = 4_000_000
_SPANS = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def stretches(text: str, overlap: int, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words before, words) of parts of a text that share ``overlap`` words with the part before."""
    data = text.encode().translate(_TABLE)
    at, before, tail = 0, 0, []
    while at < len(data) or not at:
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        words = tail + data[at:end].split()
        yield before - len(tail), words
        before += len(words) - len(tail)
        tail = words[-overlap:] if overlap else []
        at = end + 1


class Matcher:
    """Tables for patterns of one length in words, for each length.

    ``shift`` says how far the end of a window may move when the last two words of the window are a given
    block; blocks it does not have let it pass over all but one word. At shift 0 the bucket of the
    block, and in it the list for the window's first two words, have the patterns to compare with.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        patterns: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if words else 0):
                patterns[tuple(words[i : i + m])].add(item)
        self.window = window
        self.tables = []
        for m in sorted({len(p) for p in patterns}):
            b = min(2, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
            for p, of in patterns.items():
                if len(p) == m:
                    for end in range(b, m + 1):
                        block = p[end - b : end]
                        shift[block] = min(shift.get(block, m), m - end)
                    buckets[p[m - b :]][p[:b]].append((list(p), frozenset(of)))
            self.tables.append((m, b, shift, {k: dict(v) for k, v in buckets.items()}))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(first word, word after the last, items) of each occurrence."""
        n = len(words)
        for m, b, shift, buckets in self.tables:
            pass_over, end = m - b + 1, m
            while end <= n:
                block = (words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],)
                step = shift.get(block, pass_over)
                if step:
                    end += step
                    continue
                start = end - m
                for pattern, items in buckets[block].get(tuple(words[start : start + b]), ()):
                    if words[start:end] == pattern:
                        yield start, end, items
                end += 1

    def search(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, joined spans of hit words, items."""
        found, items, n = [], set(), 0
        for before, words in stretches(text, self.window - 1):
            n = before + len(words)
            for start, end, of in self.find(words):
                found.append((before + start, before + end))
                items |= of
        return n, joined(found), items


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_pieces(benchmark: DataFrame, item_id: str, text: str, window: int, most: int = 10_000) -> DataFrame:
    """(item, words) with long items cut into overlapping pieces of at most ``most`` words."""
    step = most - window + 1

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            items, pieces = [], []
            for item, t in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(t)
                for i in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    items.append(item)
                    pieces.append(b" ".join(words[i : i + most]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], ["item", "words"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), text_or_empty(text).alias("text"))
    return rows.where("item IS NOT NULL").mapInArrow(cut_up, "item string, words binary")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = 13, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Per row of ``docs``: columns ``keep``, then n_words, n_hit, item_ids (sorted as strings), spans of hit words, contaminated.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. The windows are all
    ``window`` consecutive words of an item, or the whole item if it has fewer; any occurrence hits its words.
    A document is contaminated if at least a twentieth of its words, and one word, is hit.

    Items of up to ``max_bytes`` of words are one broadcast table, and no rows of documents are shuffled. Larger
    benchmarks are dealt into blocks of about that size (long items in overlapping pieces), the documents are searched
    for each block, and the hits of equal (document, text) are joined. Null texts and items have no words, null item
    ids are ignored, repeated rows are judged alike and each returned.
    """
    spark = docs.sparkSession
    pieces = cut(benchmark_pieces(benchmark, item_id, item_text, window).distinct())
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // max_bytes))
    rows = docs.select(
        F.struct(*keep).alias("row"), F.xxhash64(F.col(doc_id), text_or_empty(text)).alias("part"),
        text_digest(text).alias("digest"), text_or_empty(text).alias("text"),
    )

    def held(i: int):
        own = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i)
        return spark.sparkContext.broadcast([(r.item, bytes(r.words)) for r in own.collect()])

    def block(i: int, names: list[str]) -> DataFrame:
        """Columns ``names`` with what block ``i`` finds; without the row only documents where it finds something."""
        shared = held(i)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(((i, w.split()) for i, w in shared.value), window)
            for batch in slices(batches, "text"):
                found = [matcher.search(t) for t in batch["text"].to_pylist()]
                if "row" not in names:
                    batch = batch.filter(pa.array([bool(spans) for _, spans, _ in found]))
                    found = [x for x in found if x[1]]
                yield _with_spans(batch, names, found)

        own = rows.select(*names, "text")
        return own.mapInArrow(run, _extended(own.select(*names)))

    if blocks == 1:
        return _figures(block(0, ["row"]))
    keys = ["part", "digest"]
    found = block(0, keys)
    for i in range(1, blocks):
        found = cut(found.unionByName(block(i, keys)))
    merged = found.groupBy(*keys).agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [
                (len(words_of(t)), joined((s["start"], s["stop"]) for s in spans or ()), items or ())
                for t, spans, items in zip(*(batch[c].to_pylist() for c in ("text", "spans", "items")))
            ]
            yield _with_spans(batch, ["row"], found)

    every = rows.join(merged, keys, "left").select("row", "text", "spans", "items")
    return _figures(every.mapInArrow(join_up, _extended(every.select("row"))))


def _extended(df: DataFrame) -> str:
    return ", ".join([f"{n} {t}" for n, t in df.dtypes] + [_SPANS])


def _with_spans(batch: pa.RecordBatch, names: list[str], found: list[tuple]) -> pa.RecordBatch:
    spans = pa.array([[{"start": a, "stop": b} for a, b in x[1]] for x in found], _SPAN_LIST)
    return pa.RecordBatch.from_arrays(
        [*(batch[c] for c in names), pa.array([x[0] for x in found], pa.int64()), spans,
         pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))],
        names=[*names, "n_words", "spans", "items"],
    )


_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _figures(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    n_hit = F.col("n_hit")
    return found.select("row", "n_words", hit.alias("n_hit"), F.col("items").alias("item_ids"), "spans").select(
        "row.*", "n_words", "n_hit", "item_ids", "spans", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )
