"""Line deduplication by sorted key ranges: keep bitmaps per document, not texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import cut, slices, text_or_empty

_KEYS = ("k1", "k2", "doc", "part", "pos", "n")
_LINE = "k1 bigint, k2 bigint, doc bigint, part bigint, pos int, n int"
_EDGE = "task int, seg int, k1 bigint, k2 bigint, docs bigint, first bigint, last bigint"


def line_keys(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points: 128-bit hash, document, part, place, lines."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, doc, part, pos, total = [], [], [], [], []
            for d, p, t in zip(batch["doc"].to_pylist(), batch["part"].to_pylist(), batch["text"].to_pylist()):
                lines = t.encode().split(b"\n")
                for i, line in enumerate(lines):
                    # bytes.strip and bytes.lower know ASCII alone, as the key does
                    key = line.strip().lower()
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        doc.append(d)
                        part.append(p)
                        pos.append(i)
                        total.append(len(lines))
            if digests:
                pair = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(doc, pa.int64()), pa.array(part, pa.int64()),
                     pa.array(pos, pa.int32()), pa.array(total, pa.int32())], names=_KEYS
                )

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text_or_empty(text)).alias("part"),
        text_or_empty(text).alias("text"),
    ).where("doc IS NOT NULL")
    return rows.mapInArrow(keys, _LINE)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch[c].to_numpy(zero_copy_only=False) for c in _KEYS]


def _groups(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where keys begin, how many documents each has, and the key's number for each row."""
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    starts = np.flatnonzero(new)
    return starts, np.add.reduceat(other.astype(np.int64), starts), np.cumsum(new) - 1


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a task, as [k1, k2, documents, first document, last document]."""
    first, now = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, doc, *_ = _arrays(batch)
        starts, docs, _ = _groups(k1, k2, doc)
        ends = np.append(starts[1:], len(k1)) - 1
        for g in {0, len(starts) - 1}:
            seg = [int(k1[starts[g]]), int(k2[starts[g]]), int(docs[g]), int(doc[starts[g]]), int(doc[ends[g]])]
            if now is not None and now[:2] == seg[:2]:
                now = [*seg[:2], now[2] + seg[2] - (now[4] == seg[3]), now[3], seg[4]]
            else:
                first, now = first or now, seg
    task, rows = TaskContext.get().partitionId(), [s for s in (first, now) if s]
    for i, s in enumerate(rows):
        yield pa.RecordBatch.from_pandas(
            pd.DataFrame([[task, i, *s]], columns=[c.split()[0] for c in _EDGE.split(", ")]).astype(
                {"task": "int32", "seg": "int32"}
            ), preserve_index=False,
        )


def spanning(edges: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest document of each key that more than one task has."""
    out, now = {}, None
    for _, _, k1, k2, docs, first, last in sorted(map(tuple, edges)):
        if now and now[0] == (k1, k2):
            now = ((k1, k2), now[1] + docs - (now[3] == first), now[2], last)
            out[now[0]] = (now[1], now[2])
        else:
            now = ((k1, k2), docs, first, last)
    return out


def _dropped(spans: dict[tuple[int, int], tuple[int, int]], min_docs: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = dict(spans), None

        def judged(rows: list[np.ndarray], last: bool):
            """Rows to drop, and rows of a last key that cannot be judged yet: those of under ``min_docs`` documents."""
            k1, k2, doc = rows[:3]
            starts, docs, group = _groups(k1, k2, doc)
            most = doc[starts]
            for g in {0, len(starts) - 1}:
                if found := known.get((int(k1[starts[g]]), int(k2[starts[g]]))):
                    docs[g], most[g] = found
            bad = (docs[group] >= min_docs) & (doc != most[group])
            end = starts[-1]
            if not last and docs[-1] < min_docs:
                if (int(k1[end]), int(k2[end])) not in known:
                    return [c[bad] for c in rows], [c[end:] for c in rows]
            elif not last:
                known[int(k1[end]), int(k2[end])] = (int(docs[-1]), int(most[-1]))
            return [c[bad] for c in rows], None

        for batch in batches:
            if batch.num_rows:
                rows = _arrays(batch)
                rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
                bad, held = judged(rows, False)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in bad[2:]], names=_KEYS[2:])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in judged(held, True)[0][2:]], names=_KEYS[2:])

    return drop


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, gone = [], []
        for n, places in zip(batch["n"].to_pylist(), batch["places"].to_pylist()):
            bits = np.ones(n, np.uint8)
            bits[places] = 0
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            gone.append(n - int(bits.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], batch["part"], batch["n"], pa.array(gone, pa.int32()), pa.array(keep, pa.binary())],
            names=["doc", "part", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, part, n_lines, n_dropped, keep) of each document that loses a line.

    ``keep`` is a compressed bitmap of lines, ``part`` a hash of the text it belongs to. A line's key is the line
    without outer blanks, A-Z lower-cased. Keys of ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines except in the largest document that has them.

    Hashes are range-partitioned together with document and place, so that a key with any share of the rows
    spreads over tasks, and sorted by key, largest document first. A task streams its range with a memory of fewer than
    ``min_docs`` documents' lines of one key. A key that crosses tasks is completed from the tasks'
    first and last keys, two rows a task.

    Rows with a null document id neither count nor lose lines. Rows of one document id are one document.
    """
    rows = line_keys(docs, min_chars, doc_id, text)
    order = [F.col("k1"), F.col("k2"), F.col("doc").desc(), F.col("part"), F.col("pos")]
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    spans = spanning(ordered.mapInArrow(_edges, _EDGE).collect())
    dropped = ordered.mapInArrow(_dropped(spans, min_docs), "doc bigint, part bigint, pos int, n int")
    lists = dropped.groupBy("doc", "part", "n").agg(F.collect_set("pos").alias("places"))
    return lists.mapInArrow(_bitmaps, "doc bigint, part bigint, n_lines int, n_dropped int, keep binary")


def _rest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, keeps in parts:
        out = []
        for t, k in zip(texts, keeps):
            if t is None or k is None:
                out.append(None)
                continue
            lines = t.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines))
            out.append("\n".join(line for line, bit in zip(lines, bits) if bit))
        yield pd.Series(out, dtype=object)


def deduplicated(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and a struct ``lines`` of n_lines and n_dropped.

    Documents that lose nothing keep their text untouched (null stays null and counts as one empty line).
    Only texts that lose lines are handed to Python.
    """
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, doc_id, text).select(
        F.col("doc").alias("_doc"), F.col("part").alias("_part"), F.col("n_dropped").alias("_gone"),
        F.col("keep").alias("_keep"),
    )
    rows = docs.withColumn("_key", F.xxhash64(text_or_empty(text)))
    joined = rows.join(
        bitmaps, (F.col(doc_id).cast("long") == F.col("_doc")) & (F.col("_key") == F.col("_part")), "left"
    )
    rest = F.pandas_udf(_rest, "string")(F.when(F.col("_keep").isNotNull(), F.col(text)), F.col("_keep"))
    counts = F.struct(
        F.size(F.split(text_or_empty(text), "\n")).cast("long").alias("n_lines"),
        F.coalesce("_gone", F.lit(0)).cast("long").alias("n_dropped"),
    )
    out = joined.select(
        *[F.col(c) for c in docs.columns if c != text], F.col(text).alias("_old"), counts.alias("lines"), rest.alias("_new")
    )
    kept = F.coalesce("_new", "_old").alias(text)
    return out.select(*[kept if c == text else F.col(c) for c in docs.columns], "lines")
