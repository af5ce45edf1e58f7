"""Near-duplicate vectors by product quantisation: inverted lists, codes of residuals, exact cosine of what is left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import cut
from accesswatch.llm.components import components

#: Rounding of single-precision distances between unit vectors stays far below this.
SLACK = 1e-3


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centres, and the nearest."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    return d, d.argmin(1)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([_nearest(x[i : i + 4096], centres)[1] for i in range(0, len(x), 4096)])
        size = np.bincount(at, minlength=len(centres))
        order, starts = at.argsort(kind="stable"), np.cumsum(size) - size
        full = size > 0
        centres[full] = np.add.reduceat(x[order], starts[full], axis=0) / size[full, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres of the inverted lists and, for each subspace, the code words of residuals."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def _parts(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def lists(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector, and which others may hold a vector within ``radius``.

        A vector of another list lies beyond the plane half way between both centres, so a list needs no probe
        if that plane is further than ``radius``. Probes by this rule are enough: they lose no pair.
        """
        d, home = _nearest(x, self.centres)
        near = self.centres[home]
        gap, _ = _nearest(near, self.centres)
        excess = d - d[np.arange(len(x)), home][:, None]
        return home, excess <= 2 * radius * np.sqrt(np.maximum(gap, 0)) + SLACK

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance from each vector to what its codes stand for."""
        r = self._parts(x - self.centres[home])
        codes, lost = np.empty(r.shape[:2], np.uint8), np.zeros(len(x))
        for p in range(r.shape[1]):
            d, codes[:, p] = _nearest(r[:, p], self.books[p])
            lost += np.maximum(d[np.arange(len(x)), codes[:, p]], 0)
        return codes, np.sqrt(lost)

    def distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from vectors to coded ones of a list: a table a vector, looked up by the codes."""
        r, total = self._parts(x - self.centres[home]), np.zeros((len(x), len(codes)), np.float32)
        for p in range(r.shape[1]):
            table = _nearest(r[:, p], self.books[p])[0].astype(np.float32)
            total += table[:, codes[:, p]]
        return total


def fit_quantiser(x: np.ndarray, lists: int, parts: int, codes: int, rounds: int = 8, seed: int = 7) -> Quantiser:
    rng = np.random.default_rng(seed)
    centres = _k_means(x, lists, rounds, rng)
    width = -(-x.shape[1] // parts)
    blank = Quantiser(centres, np.zeros((parts, 1, width)))
    home = np.concatenate([_nearest(x[i : i + 4096], centres)[1] for i in range(0, len(x), 4096)])
    r = blank._parts(x - centres[home])
    return Quantiser(centres, np.stack([_k_means(r[:, p], min(codes, 256), rounds, rng) for p in range(parts)]))


def _unit(raw: list[bytes], kind: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, filled up with zeros to ``dim`` and scaled by their largest component; and unit ones."""
    x = np.zeros((len(raw), dim))
    for i, v in enumerate(raw):
        a = np.frombuffer(v, kind)
        x[i, : len(a)] = a
    x /= np.abs(x).max(1, initial=0, keepdims=True)
    return x, x / np.sqrt((x * x).sum(1, keepdims=True))


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _vectors(rows: DataFrame, kind: str) -> DataFrame:
    """(id, label, key, vec, dim): the vector's bytes and their digest; all null if it can link with nothing."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("key", pa.binary()), ("vec", pa.binary()), ("dim", pa.int32())])

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs, dims = [], [], []
            column = batch["vec"]
            ends, flat = column.offsets.to_numpy(), column.values
            valid = np.asarray(column.is_valid())
            value = flat.to_numpy(zero_copy_only=False).astype(kind)
            fine = np.isfinite(value) & np.asarray(flat.is_valid(), bool)
            for ok, a, b in zip(valid, ends, ends[1:]):
                v = value[a:b]
                ok = ok and b > a and fine[a:b].all() and v.any()
                own = v.tobytes() if ok else None
                keys.append(md5(own).digest() if ok else None)
                vecs.append(own)
                dims.append(b - a if ok else None)
            yield _batch(schema, [batch["id"], batch["label"], keys, vecs, dims])

    return rows.mapInArrow(take, "id long, label string, key binary, vec binary, dim int")


def _placed(classes: DataFrame, index, kind: str, radius: float) -> DataFrame:
    """A row for the home list with codes, and one for each later list to be probed."""
    schema = pa.schema([
        ("label", pa.string()), ("dim", pa.int32()), ("list", pa.int32()), ("home", pa.bool_()), ("key", pa.binary()),
        ("id", pa.int64()), ("copies", pa.int64()), ("vec", pa.binary()), ("code", pa.binary()), ("lost", pa.float64()),
    ])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = index.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                raw = part["vec"].to_pylist()
                _, x = _unit(raw, kind, q.dim)
                home, near = q.lists(x, radius)
                codes, lost = q.encode(x, home)
                near[np.arange(near.shape[1])[None] <= home[:, None]] = False
                at, to = near.nonzero()
                n = len(raw)
                row = np.concatenate([np.arange(n), at])
                take = part.take(pa.array(row))
                yield _batch(schema, [
                    take["label"], take["dim"], np.concatenate([home, to]).astype(np.int32), np.arange(len(row)) < n, take["key"],
                    take["id"], take["copies"], take["vec"], [c.tobytes() for c in codes] + [None] * len(at),
                    np.concatenate([lost, np.zeros(len(at))]),
                ])

    return classes.mapInArrow(
        place, "label string, dim int, list int, home boolean, key binary, id long, copies long, vec binary, code binary, lost double"
    )


class _Block:
    """Coded vectors of one block of a list; counts links, and keeps only links that join what was apart."""

    def __init__(self, label, dim, at: int, q: Quantiser, kind: str, radius: float, least: float):
        self.label, self.dim, self.at, self.q, self.kind, self.radius, self.least = label, dim, at, q, kind, radius, least
        self.keys, self.ids, self.copies, self.raw, self.codes, self.lost = [], [], [], [], [], []

    def close(self) -> list[tuple]:
        """After the last coded vector: the links among them."""
        self.x, self.unit = _unit(self.raw, self.kind, self.q.dim)
        self.raw = None
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.code = np.frombuffer(b"".join(self.codes), np.uint8).reshape(len(self.keys), -1)
        self.reach = ((self.radius + np.array(self.lost) + SLACK) ** 2).astype(np.float32)
        self.ids, self.copies = np.array(self.ids), np.array(self.copies)
        self.links, self.root = np.zeros(len(self.keys), np.int64), np.arange(len(self.keys))
        out = []
        for s in range(0, len(self.keys), 512):
            own = np.arange(s, min(s + 512, len(self.keys)))
            out += self._probe(self.x[own], self.unit[own], self.norm[own], self.ids[own], self.copies[own], [self.keys[i] for i in own], own)
        return out

    def probe(self, raw: list[bytes], ids, copies, keys: list[bytes]) -> list[tuple]:
        x, unit = _unit(raw, self.kind, self.q.dim)
        return self._probe(x, unit, np.sqrt((x * x).sum(1)), np.array(ids), np.array(copies), keys, None)

    def _pairs(self, x, unit, norm, own) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, row of the block) with a cosine of at least ``least``."""
        maybe = self.q.distances(unit, self.at, self.code) <= self.reach[None]
        if own is not None:
            maybe &= np.arange(len(self.keys))[None] > own[:, None]
        a, b = maybe.nonzero()
        keep = np.empty(len(a), bool)
        for s in range(0, len(a), 65536):
            i, j = a[s : s + 65536], b[s : s + 65536]
            keep[s : s + 65536] = np.einsum("ij,ij->i", x[i], self.x[j]) / (norm[i] * self.norm[j]) >= self.least
        return a[keep], b[keep]

    def _probe(self, x, unit, norm, ids, copies, keys, own) -> list[tuple]:
        a, b = self._pairs(x, unit, norm, own)
        mine = np.bincount(a, self.copies[b], len(ids)).astype(np.int64)
        self.links += np.bincount(b, copies[a], len(self.keys)).astype(np.int64)
        out = [(self.label, keys[i], int(mine[i]), None, None) for i in mine.nonzero()[0]]
        root = self.root
        while (root[root] != root).any():
            root = root[root]
        self.root = root
        # One link per vector and set of vectors joined before this batch is enough to join what the links join.
        _, first = np.unique(a * len(root) + root[b], return_index=True)
        last = {}
        for i, j in zip(a[first].tolist(), b[first].tolist()):
            one = self._find(own[i] if own is not None else last.setdefault(i, j))
            other = self._find(j)
            if one != other or (own is None and last[i] == j):
                root[max(one, other)] = min(one, other)
                out.append((None, None, None, int(ids[i]), int(self.ids[j])))
        return out

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            i = self.root[i]
        return int(i)

    def counts(self) -> list[tuple]:
        return [(self.label, self.keys[i], int(self.links[i]), None, None) for i in self.links.nonzero()[0]]


def _matched(rows: DataFrame, index, kind: str, radius: float, least: float) -> DataFrame:
    """(label, key, n) numbers of links, and (a, b) links enough to join all that is linked."""
    schema = pa.schema([("label", pa.string()), ("key", pa.binary()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = index.value
        group, block, out, open_ = None, None, [], False
        waiting: list[tuple] = []

        def flush() -> None:
            if waiting:
                vecs, ids, copies, keys = zip(*waiting)
                out.extend(block.probe(list(vecs), ids, copies, list(keys)))
                waiting.clear()

        def finish() -> None:
            nonlocal open_
            if block is not None:
                if open_:
                    out.extend(block.close())
                    open_ = False
                flush()
                out.extend(block.counts())

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("label", "dim", "list", "block", "home", "key", "id", "copies", "vec", "code", "lost")]
            for label, dim, at, part, home, key, i, copies, vec, code, lost in zip(*columns):
                if (label, dim, at, part) != group:
                    finish()
                    group, block, open_ = (label, dim, at, part), _Block(label, dim, at, q, kind, radius, least), True
                if home:
                    for held, v in zip((block.keys, block.ids, block.copies, block.raw, block.codes, block.lost), (key, i, copies, vec, code, lost)):
                        held.append(v)
                    continue
                if not block.keys:
                    continue
                if open_:
                    out.extend(block.close())
                    open_ = False
                waiting.append((vec, i, copies, key))
                if len(waiting) == 512:
                    flush()
                if len(out) >= 8192:
                    yield _batch(schema, list(zip(*out)))
                    out.clear()
        finish()
        if out:
            yield _batch(schema, list(zip(*out)))

    return rows.mapInArrow(match, "label string, key binary, n long, a long, b long")


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98,
    sample: int = 65_536, most_lists: int = 1024, parts: int = 8, codes: int = 64, block: int = 2048,
) -> DataFrame:
    """One row per vector: number of links, component and whether it is the one of its component that stays.

    Vectors of the same label and length link at a cosine of at least ``least``. Equal vectors are compared once. The index is
    fitted on about ``sample`` distinct vectors, drawn by a hash of their digest; every vector is coded. There is a
    list per ``block`` vectors, at most ``most_lists``; a list of a label beyond ``block`` vectors is matched block by
    block. More lists mean fewer comparisons and more copies of each vector on its way to the lists it probes. A list is probed if it can hold a vector near enough, and a coded vector is compared exactly unless its table
    distance, less what its own code loses, is too great: both are bounds, so no link is lost and the recall is one.
    A task holds one block and 512 probing vectors; of the links in a block it returns counts and a spanning forest.

    Null, empty and zero vectors, those with null or non-finite components, and null labels or ids link with nothing; a
    null id has a null component and stays. Rows that share an id are one place of a component. Repeated rows are
    vectors of their own and link. Further columns are not looked at; an empty table gives none.
    """
    spark, radius = vectors.sparkSession, sqrt(2 - 2 * least)
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("vec"))
    kind = "<f4" if given.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"
    if kind == "<f8":
        given = given.withColumn("vec", F.col("vec").cast("array<double>"))
    rows = _vectors(given, kind)
    linking = rows.where("key IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    classes = cut(linking.groupBy("label", "key", "dim").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.max("vec").alias("vec")))
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    own = rows.select("id", "label", "key")
    if not n:
        return own.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = [r.vec for r in classes.where(F.pmod(F.xxhash64("key"), F.lit(n)) < sample).select("vec").collect()] or [classes.first().vec]
    index = spark.sparkContext.broadcast(
        fit_quantiser(_unit(drawn, kind, dim)[1], min(most_lists, -(-n // block)), min(parts, dim), codes)
    )
    placed = cut(_placed(classes, index, kind, radius))
    at = ["label", "dim", "list"]
    split = placed.where("home").groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # Vectors of a list meet the later blocks of their own list, and all blocks of the lists they probe.
    dealt = placed.join(split, at).withColumn("mine", F.when(F.col("home"), mine).otherwise(-1)).withColumn(
        "block", F.explode(F.sequence(F.greatest("mine", F.lit(0)), F.col("blocks") - 1))
    ).withColumn("home", F.col("home") & (F.col("mine") == F.col("block")))
    dealt = dealt.select(*at, "block", "home", "key", "id", "copies", "vec", "code", "lost").repartition(*at, "block")
    found = cut(_matched(dealt.sortWithinPartitions(*at, "block", F.col("home").desc()), index, kind, radius, least))
    counts = found.where("key IS NOT NULL").groupBy("label", "key").agg(F.sum("n").alias("n"))
    joined = components(found.where("a IS NOT NULL").select("a", "b"))
    known = (
        classes.select("label", "key", "id", "copies").join(counts, ["label", "key"], "left")
        .join(joined, F.col("id") == F.col("doc"), "left")
        .select(
            "label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    # A vector that shares its id with another is where that one is.
    out = own.join(known, ["label", "key"], "left")
    return out.select(
        F.col("id").alias(vec_id), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
