"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import cut, slices, text_or_empty
from accesswatch.llm.components import components

_U = np.uint64


class Signature:
    """Shape of a signature: ``chunks`` of ``width`` symbols of 8 bits, of which ``errors`` may differ in a chunk.

    If two signatures differ in fewer than ``chunks * (errors + 1)`` symbols, some chunk differs in at most
    ``errors`` of them (pigeonhole). Every choice of ``width - errors`` symbols of a chunk is a key, so the two
    share a key: all pairs under that distance are found. A symbol of two sets of Jaccard similarity s
    differs with a probability of about 1 - s.

    The shape of production (12 chunks of 6, one error) finds all pairs that differ in up to 23 of 72 symbols; at
    s = 0.85 all but 2e-8 of the pairs share a key. Whatever its distance, a pair that shares one is confirmed, unless
    ``too_far`` proves that it is no link.
    """

    def __init__(self, chunks: int = 12, width: int = 6, errors: int = 1):
        self.chunks, self.width, self.errors = chunks, width, errors
        self.size = chunks * width
        self.choices = list(combinations(range(width), width - errors))
        rng = np.random.default_rng(20240101)
        self.xor = rng.integers(0, 2**32, self.size, np.uint32)
        self.odd = rng.integers(0, 2**31, self.size, np.uint32) * np.uint32(2) + np.uint32(1)
        if (width - errors) * 8 + len(self.choices).bit_length() + chunks.bit_length() > 63:
            raise ValueError("keys do not fit into 63 bits")

    def of(self, shingles: np.ndarray) -> bytes:
        """One byte for each symbol: the top bits of the minimum of a permutation of the shingles, mixed."""
        x = (shingles >> _U(32)).astype(np.uint32)
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            part = (x[i : i + 512, None] ^ self.xor) * self.odd
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(low, part.min(axis=0), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, keys) as 63-bit numbers: chunk, choice and the symbols chosen."""
        n = len(signatures)
        symbols = signatures.reshape(n, self.chunks, self.width).astype(np.int64)
        out = np.empty((n, self.chunks, len(self.choices)), np.int64)
        for c, choice in enumerate(self.choices):
            key = np.arange(self.chunks, dtype=np.int64)[None, :] * len(self.choices) + c
            key = np.repeat(key, n, axis=0)
            for j in choice:
                key = (key << 8) | symbols[:, :, j]
            out[:, :, c] = key
        return out.reshape(n, -1)

    def first_shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of signatures: their distance, and the number of the first key they share (or -1)."""
        same = (a == b).reshape(len(a), self.chunks, self.width)
        ok = same.sum(axis=2) >= self.width - self.errors
        chunk = ok.argmax(axis=1)
        part = same[np.arange(len(a)), chunk]
        fits = np.stack([part[:, list(c)].all(axis=1) for c in self.choices], axis=1)
        return self.size - same.sum(axis=(1, 2)), np.where(
            ok.any(axis=1), chunk * len(self.choices) + fits.argmax(axis=1), -1
        )

    def key_number(self, keys: np.ndarray) -> np.ndarray:
        return keys >> (8 * (self.width - self.errors))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE, _ODD = 0x9E3779B97F4A7C15 | 1, 1 << 64
_POWERS = [1]


def shingles(text: str, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of ``width``-word shingles, sorted; fewer words are one shingle, none are none.

    A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums over the whole text.
    """
    data = np.frombuffer(text.encode().lower(), np.uint8)
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    if not len(edge):
        return np.empty(0, np.uint64)
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    words = np.zeros(len(starts), np.uint64)
    order = np.argsort(-lengths, kind="stable")
    begins, left = starts[order], lengths[order]
    # Horner's rule on all words at once; words drop out as they end.
    for i in range(int(left[0])):
        alive = int(np.searchsorted(-left, -i, side="left"))
        if alive < 32:
            for k in range(alive):
                h = int(words[k])
                for byte in data[begins[k] + i : begins[k] + left[k]].tolist():
                    h = ((h + byte + 1) * _BASE) % _ODD
                words[k] = h
            break
        words[:alive] = (words[:alive] + data[begins[:alive] + i] + _U(1)) * _U(_BASE)
    hashed = np.empty(len(words), np.uint64)
    hashed[order] = _mixed(words)
    n = len(hashed)
    w = min(width, n)
    out = np.zeros(n - w + 1, np.uint64)
    for k in range(w):
        out = (out ^ hashed[k : n - w + 1 + k]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return np.unique(_mixed(out + _U(w)))


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


#: Bytes of a parity sketch.
_PARITY = 32


def parity(s: np.ndarray) -> bytes:
    """A bit for each value of a shingle's low bits: whether the set has an odd number of shingles with it."""
    size = 8 * _PARITY
    return np.packbits((np.bincount((s % _U(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def too_far(a: np.ndarray, b: np.ndarray, n: np.ndarray, similar_pct: int) -> np.ndarray:
    """Pairs of sets that can't be linked, by their sketches as 64-bit words and the sum ``n`` of their sizes.

    Shingles of both sets cancel out, so each bit that differs stands for at least one shingle of one set alone. Linked sets
    have at most (100 - pct) * n / (100 + pct) of those: no link is lost.
    """
    alone = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 + similar_pct) * alone > (100 - similar_pct) * n


def _signed(docs: DataFrame, shape: Signature, width: int, doc_id: str, text: str) -> DataFrame:
    """(doc, n_shingles, set_id, signature, parity) of every row; the last three null without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, ids, signatures, odd = [], [], [], []
            for t in batch["text"].to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                ids.append(_set_id(s) if len(s) else None)
                signatures.append(shape.of(s) if len(s) else None)
                odd.append(parity(s) if len(s) else None)
            binary = [pa.array(x, pa.binary()) for x in (ids, signatures, odd)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(n, pa.int64()), *binary], names=["doc", "n_shingles", "set_id", "signature", "parity"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(sign, "doc bigint, n_shingles bigint, set_id binary, signature binary, parity binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _key_rows(shape: Signature):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                found = shape.keys(_matrix(batch["signature"], shape.size))
                doc = np.repeat(batch["doc"].to_numpy(), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(doc)], names=["key", "doc"])

    return keys


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches in which no run of equal values of ``column`` is cut. A run must fit into memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[column].to_numpy(zero_copy_only=False)
        begin = int(np.flatnonzero(values == values[-1])[0])
        if begin == 0 and held and held[-1][column][-1].as_py() == values[0]:
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, begin)], batch.schema).combine_chunks()
        yield from whole.to_batches()
        held = [batch.slice(begin)]
    if held:
        yield from pa.Table.from_batches(held, held[0].schema).combine_chunks().to_batches()


def _buckets(most: int):
    """Rows of keys that several documents have, with a block number: about ``most`` neighbours are a block.

    A task knows its own range of keys only. Its first and last key may go on in the next task, so their rows are always
    kept; documents alone under such a key fall out later.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None
        place, first, last = 0, True, None

        def cut_out(rows: tuple[np.ndarray, np.ndarray], end: bool):
            """All but the last row, whose successor isn't known, unless this is the end."""
            nonlocal place, first, last
            key, doc = rows
            n = len(key) - (not end)
            if n <= 0:
                return None
            before = np.concatenate(([first or key[0] == last], key[1:] == key[:-1]))
            after = np.concatenate((key[1:] == key[:-1], [end]))
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(before, -1, at))
            nth = np.where(start < 0, at + place, at - start)
            keep = (before | after)[:n]
            place, first, last = int(nth[n - 1]) + 1, False, int(key[n - 1])
            block = (task << 32) + nth[:n] // most
            return pa.RecordBatch.from_arrays(
                [pa.array(key[:n][keep]), pa.array(doc[:n][keep]), pa.array(block[keep].astype(np.int64))],
                names=["key", "doc", "block"],
            )

        for batch in batches:
            rows = (batch["key"].to_numpy(), batch["doc"].to_numpy())
            rows = tuple(np.concatenate(x) for x in zip(held, rows)) if held else rows
            if len(rows[0]):
                if out := cut_out(rows, False):
                    yield out
                held = tuple(x[-1:] for x in rows)
        if held:
            if out := cut_out(held, True):
                yield out

    return members


_PAIRS = "group string, doc bigint, partners array<bigint>"


def _candidates(shape: Signature, similar_pct: int, within: bool):
    """For each document of a group, its later partners: pairs whose first shared key is the group's key.

    Rows are sorted by group; ``within`` compares all rows of a group, else only rows of different blocks. Rows of one
    component are not compared, and pairs whose sketches (if given) are ``too_far`` apart are left out.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "group"):
            group = batch["group"].to_numpy(zero_copy_only=False)
            doc, n, number = (batch[c].to_numpy() for c in ("doc", "n_shingles", "number"))
            block, label = batch["block"].to_numpy(), batch["label"].to_numpy()
            signature = _matrix(batch["signature"], shape.size)
            odd = _matrix(batch["parity"], _PARITY).view(_U) if "parity" in batch.schema.names else None
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sizes = np.diff(np.append(starts, len(group)))
            left = np.repeat(starts + sizes, sizes) - np.arange(len(group))
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            for lag in range(1, int(left.max(initial=0))):
                a = np.flatnonzero(left > lag)
                b = a + lag
                ok = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= similar_pct * np.maximum(n[a], n[b]))
                if not within:
                    ok &= block[a] != block[b]
                a, b = a[ok], b[ok]
                for i in range(0, len(a), 20_000):
                    x, y = a[i : i + 20_000], b[i : i + 20_000]
                    if odd is not None:
                        near = ~too_far(odd[x], odd[y], n[x] + n[y], similar_pct)
                        x, y = x[near], y[near]
                    if not len(x):
                        continue
                    _, shared = shape.first_shared(signature[x], signature[y])
                    ok = shared == number[x]
                    if ok.any():
                        pairs.append((x[ok], y[ok]))
            if not pairs:
                continue
            x, y = (np.concatenate(p) for p in zip(*pairs))
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            alone = np.setdiff1d(y, x)
            at, counts = np.unique(x, return_counts=True)
            partners = pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum(counts), np.full(len(alone), len(y)))).astype(np.int32), pa.array(doc[y])
            )
            rows = np.concatenate((at, alone))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[rows], pa.string()), pa.array(doc[rows]), partners], names=["group", "doc", "partners"]
            )

    return compare


def _confirmed(width: int, similar_pct: int) -> Callable:
    """Links between documents of a group, on their sets; within a group only links that join something new."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "group"):
            group, doc = batch["group"].to_pylist(), batch["doc"].to_pylist()
            partners, sets = batch["partners"].to_pylist(), batch["shingles"]
            a, b, start = [], [], 0
            while start < len(group):
                end = start + 1
                while end < len(group) and group[end] == group[start]:
                    end += 1
                place = {doc[i]: i for i in range(start, end)}
                own = {i: np.frombuffer(sets[i].as_py(), np.uint64) for i in range(start, end)}
                root = {i: i for i in own}

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    return i

                for i in range(start, end):
                    for other in partners[i] or ():
                        j = place[other]
                        ri, rj = find(i), find(j)
                        if ri == rj:
                            continue
                        x, y = own[i], own[j]
                        both = _common(x, y)
                        if 100 * both >= similar_pct * (len(x) + len(y) - both):
                            root[ri] = rj
                            a.append(doc[i])
                            b.append(doc[j])
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return confirm


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) where the set of ``text`` is the one that ``set_id`` names."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            found, doc = [], []
            for d, name, t in zip(*(batch[c].to_pylist() for c in ("doc", "set_id", "text"))):
                s = shingles(t, width)
                if _set_id(s) == name:
                    found.append(s.tobytes())
                    doc.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(found, pa.binary())], names=["doc", "shingles"])

    return docs.select("doc", "set_id", "text").mapInArrow(make, "doc bigint, shingles binary").dropDuplicates(["doc"])


def near_duplicates(
    docs: DataFrame, similar_pct: int = 85, width: int = 5, shape: Signature | None = None, most: int = 1024,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of distinct ``width``-word shingles is at least
    ``similar_pct`` %; words are runs without blanks, A-Z lower-cased. ``component_id`` is the smallest document id
    reachable by links, ``kept`` marks the document that has it.

    Rows of one set are a class, represented by its smallest document, and only classes go on. A class has a
    signature (see ``Signature``) and its keys are sorted by ranges of (key, document), so that a key with any share of the rows
    spreads over tasks. Neighbours under a key form blocks of ``most``. First all pairs inside blocks are compared by
    signature, each only under the first key it shares; pairs whose sketches prove them apart (see ``too_far``) go, and
    the pairs left are confirmed on whole sets, which are sent once per document and block; links that join nothing new in their block are not needed. Then keys of more than one
    block are done block against block, only between classes not yet joined. No pairs are shuffled and nothing is capped.

    Without words (null, empty or blank text) a document has an empty set and is linked with nothing. A null document id
    is linked with nothing: its component is null and it is kept. Of a
    document id with several texts the one with the smallest set hash is linked.
    """
    shape = shape or Signature()
    rows = cut(_signed(docs, shape, width, doc_id, text))
    known = cut(
        rows.where("doc IS NOT NULL AND set_id IS NOT NULL").groupBy("doc")
        .agg(F.min(F.struct("set_id", "signature", "n_shingles", "parity")).alias("s")).select("doc", "s.*")
    )
    classes = cut(
        known.groupBy("set_id").agg(
            F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("signature", "n_shingles", "parity")]
        )
    )
    keys = classes.select("doc", "signature").mapInArrow(_key_rows(shape), "key bigint, doc bigint")
    order = [F.col("key"), F.col("doc")]
    members = cut(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_buckets(most), "key bigint, doc bigint, block bigint")
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    signs = classes.select("doc", "signature", "n_shingles", "parity", "set_id")

    def with_signature(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        rows = rows.join(signs.drop("set_id"), "doc")
        if labels is not None:
            rows = rows.join(labels.select("doc", F.col("component").alias("label")), "doc", "left")
        label = F.coalesce("label", "doc") if labels is not None else F.col("doc")
        number = F.shiftright("key", 8 * (shape.width - shape.errors)).alias("number")
        return rows.select("key", "doc", "block", number, label.alias("label"), "signature", "n_shingles", "parity")

    def candidates(grouped: DataFrame, within: bool) -> DataFrame:
        rows = grouped.select("group", "doc", "number", "block", "label", "signature", "n_shingles", "parity")
        compare = _candidates(shape, similar_pct, within)
        return cut(rows.repartition("group").sortWithinPartitions("group", "doc").mapInArrow(compare, _PAIRS))

    def confirmed(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(sets, "doc").repartition("group").sortWithinPartitions("group", "doc")
        confirm = _confirmed(width, similar_pct)
        return cut(rows.select("group", "doc", "partners", "shingles").mapInArrow(confirm, "a bigint, b bigint"))

    inside = candidates(with_signature(members, None).withColumn("group", F.concat_ws("-", "key", "block")), True)
    blocks = members.select("key", "block").distinct()
    large = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    of_large = cut(members.join(large, "key"))
    # The sets of all documents that either step may compare, made once.
    wanted = inside.select("doc").union(of_large.select("doc")).distinct().join(signs.select("doc", "set_id"), "doc")
    sets = cut(_sets(texts.join(wanted, "doc"), width))
    found = confirmed(inside)
    labels = components(found)
    # Keys of several blocks whose documents are not all joined yet: block against block.
    held = cut(with_signature(of_large, labels))
    undecided = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    blocks = cut(held.join(undecided.select("key"), "key").select("key", "block").distinct())
    if not blocks.isEmpty():
        other = blocks.select("key", F.col("block").alias("other"))
        both = blocks.join(other, "key").where("block < other").select(
            "key", F.concat_ws("-", "key", "block", "other").alias("group"), F.array("block", "other").alias("two")
        )
        halves = both.select("key", "group", F.explode("two").alias("block"))
        more = confirmed(candidates(held.join(halves, ["key", "block"]), False))
        labels = components(found.unionByName(more))
    of_doc = (
        known.select("set_id", "doc").join(classes.select("set_id", F.col("doc").alias("first")), "set_id")
        .join(labels.select(F.col("doc").alias("first"), "component"), "first", "left")
        .select("doc", F.coalesce("component", "first").alias("component_id"))
    )
    out = rows.select("doc", "n_shingles").join(of_doc, "doc", "left")
    component = F.coalesce("component_id", "doc")
    return out.select(
        F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"),
    )
