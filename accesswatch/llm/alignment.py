"""Alignment of the tokens of two tokenizers: groups that begin and end together, and links of overlapping tokens."""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import cut, slices
from accesswatch.llm.tokens import _byte_letters
from accesswatch.session import checkpoint_dir

#: Tokens as (id, byte offset of their end).
Tokens = list[tuple[int, int]]


@dataclass
class Fragment:
    """What a stretch of a document says of its alignment, closed under joining.

    Offsets are those of the whole document. ``head`` are the tokens of both sides up to the first end they share, or all if they
    share none; the groups between shared ends are counted and written to ``groups``; ``tail`` is what follows the
    last shared end. A stretch may hold other bytes of one side than of the other: an end that only both neighbours
    together show is found when they join. ``join`` is associative and the empty fragment its unit.
    """

    head: tuple[Tokens, Tokens] = field(default_factory=lambda: ([], []))
    start: int = 0
    shared: bool = False
    end: int = 0
    tail: tuple[Tokens, Tokens] = field(default_factory=lambda: ([], []))
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pairs: Counter = field(default_factory=Counter)
    groups: list[str] = field(default_factory=list)
    sound: bool = True

    @classmethod
    def of(cls, a: Tokens, b: Tokens, sound: bool = True) -> Fragment:
        """The fragment of a stretch's own tokens."""
        out = cls(n_a=len(a), n_b=len(b), sound=sound)
        runs, rest, at = _runs(a, b)
        if runs:
            out.head, out.shared = runs[0][:2], True
            out.end = out.start = runs[0][2]
            for x, y, end in runs[1:]:
                out._close(x, y, out.end)
                out.end = end
            out.tail = rest
        else:
            out.head = rest
        return out

    def _close(self, a: Tokens, b: Tokens, start: int) -> None:
        self.pairs.update(overlaps(a, b, start))
        self.groups.append(f"{','.join(str(i) for i, _ in a)}|{','.join(str(i) for i, _ in b)}")
        self.n_groups += 1

    def join(self, other: Fragment) -> Fragment:
        out = Fragment(
            n_a=self.n_a + other.n_a, n_b=self.n_b + other.n_b, n_groups=self.n_groups + other.n_groups,
            pairs=self.pairs + other.pairs, sound=self.sound and other.sound,
        )
        open_ = self.tail if self.shared else self.head
        runs, rest, _ = _runs(open_[0] + other.head[0], open_[1] + other.head[1])
        out.groups = list(self.groups)
        out.head, out.start, out.end, out.shared = self.head, self.start, self.end, self.shared
        if not self.shared:
            if runs:
                out.head, out.start, out.end, out.shared = runs[0][:2], runs[0][2], runs[0][2], True
                runs = runs[1:]
            else:
                out.head = rest
        for x, y, end in runs:
            out._close(x, y, out.end)
            out.end = end
        if out.shared:
            out.tail = other.tail if other.shared else rest
        out.groups += other.groups
        out.end = other.end if other.shared else out.end
        return out

    def finish(self) -> Fragment:
        """A whole document's: what it begins with is a group too."""
        if self.shared:
            first = Fragment()
            first._close(*self.head, 0)
            self.groups, self.n_groups, self.pairs = first.groups + self.groups, self.n_groups + 1, self.pairs + first.pairs
            self.head = ([], [])
        return self


def _runs(a: Tokens, b: Tokens) -> tuple[list[tuple[Tokens, Tokens, int]], tuple[Tokens, Tokens], int]:
    """Tokens cut after each end that both sides share, and what follows the last."""
    out, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a[i][1] == b[j][1]:
            i, j = i + 1, j + 1
            out.append((a[x:i], b[y:j], a[i - 1][1]))
            x, y = i, j
        elif a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return out, (a[x:], b[y:]), x


def overlaps(a: Tokens, b: Tokens, start: int) -> Iterator[tuple[int, int]]:
    """Pairs of ids of one group, which begins at ``start``, whose bytes overlap."""
    i = j = 0
    from_a = from_b = start
    while i < len(a) and j < len(b):
        (p, end_a), (q, end_b) = a[i], b[j]
        if end_a > from_b and end_b > from_a:
            yield p, q
        if end_a <= end_b:
            i, from_a = i + 1, end_a
        if end_b <= end_a:
            j, from_b = j + 1, end_b


class Aligner:
    """Both tokenizers, and a bounded memory of what stands between two places where both always cut.

    ``vocabulary`` is a byte-level one of tokenizers, ``pieces`` a model of sentencepiece. The first cuts a text by a pattern in which a
    single space between two characters that are not blank begins a piece, and a single line end there is one. The second
    merges across no space after another character and across no line end, if no piece has such; that is looked up.
    """

    _single = re.compile(r"(?<=\S)(?= \S)")
    _after = re.compile(r"(?<=[^ ])(?= )")

    def __init__(self, vocabulary: str, pieces: str, most: int = 96_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(vocabulary), SentencePieceProcessor(model_file=pieces)
        self._a.encode_special_tokens = True
        own = {c: b for b, c in _byte_letters().items()}
        self.bytes_a = [b""] * self._a.get_vocab_size()
        for token, i in self._a.get_vocab().items():
            self.bytes_a[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        self._lossless = self._a.normalizer is None and set(own) <= set(self._a.get_vocab())
        self.bytes_b, self.spaces, self._lines = [], True, True
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            if self._b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[1:-1], 16)]))
                continue
            self.bytes_b.append(piece.replace("▁", " ").encode())
            self.spaces &= "▁" not in piece.lstrip("▁")
            self._lines &= "\n" not in piece
        self.shift = 16 if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else 32
        self.kind = np.dtype("<u4" if self.shift == 16 else "<u8")
        self._code = "I" if self.shift == 16 else "Q"
        self._size_a, self._size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self._known: dict[str, tuple | None] = {}
        self._held, self._most = 0, most

    def units(self, text: str) -> list[str]:
        """The text, which begins with a space, cut where both tokenizers always cut."""
        if not self.spaces:
            return [text]
        blanks = [c for c in set(text) if c.isspace()]
        if not self._lines or any(c + x in text or x + c in text for c in blanks for x in " \n"):
            return self._single.split(text)
        out = []
        for n, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if n:
                out.append("\n")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
        return out

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each text; one that begins with a space is taken as standing after something else."""
        a = [x.ids for x in self._a.encode_batch_fast(texts, add_special_tokens=False)]
        # A space is put before a text by the second itself; before others a line end keeps them apart from it.
        after = [t[:1] == " " and len(t) > 1 for t in texts]
        b = self._b.encode([t[1:] if x else "\n" + t for t, x in zip(texts, after)], num_threads=1)
        return [(x, y if own else y[2:]) for own, x, y in zip(after, a, b)]

    def sound(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both give the text's bytes. The first always does if it has all bytes and changes nothing before."""
        own = text.encode()
        if not self._lossless and b"".join([self.bytes_a[i] for i in a]) != own:
            return False
        return b"".join([self.bytes_b[i] for i in b]) == own

    def ends(self, ids: list[int], table: list[bytes], start: int = 0) -> Tokens:
        out = []
        for i in ids:
            start += len(table[i])
            out.append((i, start))
        return out

    def _unit(self, a: list[int], b: list[int]) -> tuple:
        """Groups as text, numbers of tokens and groups, and links of a unit, which both tokenizers cover: its fragment, in one walk.

        Each step of the walk is at one overlapping pair; where both tokens end together a group ends.
        """
        size_a, size_b, shift = self._size_a, self._size_b, self.shift
        links, groups, i, j, from_i, from_j, last = [], [], 0, 0, 0, 0, len(a) - 1
        p, q = a[0], b[0]
        end_a, end_b = size_a[p], size_b[q]
        while True:
            links.append(p << shift | q)
            if end_a == end_b:
                if i == from_i and j == from_j:
                    groups.append(f"{p}|{q}")
                else:
                    groups.append(f"{','.join(map(str, a[from_i : i + 1]))}|{','.join(map(str, b[from_j : j + 1]))}")
                if i == last:
                    return ";".join(groups), len(a), len(b), len(groups), array(self._code, links).tobytes()
                i, j = i + 1, j + 1
                from_i, from_j, p, q = i, j, a[i], b[j]
                end_a += size_a[p]
                end_b += size_b[q]
            elif end_a < end_b:
                i += 1
                p = a[i]
                end_a += size_a[p]
            else:
                j += 1
                q = b[j]
                end_b += size_b[q]

    def learn(self, wanted: Iterable[str]) -> dict[str, tuple | None]:
        """What each unit holds (see ``_unit``); None if a tokenizer changes its bytes."""
        if self._held > self._most:
            self._known.clear()
            self._held = 0
        known = self._known
        new = [u for u in wanted if u not in known]
        for unit, (a, b) in zip(new, self.tokens(new)):
            known[unit] = found = self._unit(a, b) if self.sound(unit, a, b) else None
            if found:
                self._held += 400 + 2 * len(unit) + len(found[0]) + len(found[4])
        return known

    def document(self, units: list[str], known: dict) -> tuple | None:
        """(tokens of both, groups, digest, distinct links, how often each) of a text from its units."""
        found = [known[u] for u in units]
        if None in found:
            return None
        groups, n_a, n_b, n, links = zip(*found)
        pairs, times = np.unique(np.frombuffer(b"".join(links), self.kind), return_counts=True)
        return sum(n_a), sum(n_b), sum(n), sha256(";".join(groups).encode()).hexdigest(), pairs.tobytes(), _times(times)


def _times(n: np.ndarray) -> bytes:
    return n.astype("<u4").tobytes()


_ALIGNED = pa.schema([
    ("row", pa.int64()), ("doc", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()),
])
ALIGNED = "row bigint, doc bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs binary, times binary"
_NOTHING = (0, 0, 0, "", b"", b"")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _align(docs: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """Texts (row, doc, text) aligned each in the task that reads it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary, pieces)
        for batch in slices(batches, "text", 1_000_000):
            cuts = [aligner.units(" " + t) if t else [] for t in batch["text"].to_pylist()]
            known = aligner.learn({u for units in cuts for u in units})
            rows = [(aligner.document(units, known) if units else None) or _NOTHING for units in cuts]
            yield _batch(_ALIGNED, [(i, d, *r) for i, d, r in zip(batch["row"].to_pylist(), batch["doc"].to_pylist(), rows)])

    return docs.mapInArrow(run, ALIGNED)


def chunks_of(text: str, size: int, aligner: type[Aligner] | Aligner = Aligner) -> Iterator[tuple[int, str, int, str]]:
    """(byte offset, text) for either tokenizer of each byte range of a text that begins with a space.

    Each is cut at the first place after the range where it always cuts by itself; these places differ.
    """

    def places(pattern: re.Pattern) -> Iterator[int]:
        at = 0
        for start in range(size, len(text), size):
            if at is not None and at < start:
                m = pattern.search(text, start)
                at = m.start() if m else None
            yield len(text) if at is None else at
        yield len(text)

    a = b = bytes_a = bytes_b = 0
    for p, q in zip(places(aligner._single), places(aligner._after)):
        yield bytes_a, text[a:p], bytes_b, text[b:q]
        bytes_a, bytes_b = bytes_a + len(text[a:p].encode()), bytes_b + len(text[b:q].encode())
        a, b = p, q


_CHUNK = pa.schema([
    ("row", pa.int64()), ("part", pa.int64()), ("at_a", pa.int64()), ("text_a", pa.string()), ("at_b", pa.int64()), ("text_b", pa.string())
])
_FRAGMENT = pa.schema([
    ("row", pa.int64()), ("part", pa.int64()), ("counts", pa.list_(pa.int64())), ("opens", pa.list_(pa.list_(pa.int64()))),
    ("pairs", pa.binary()), ("times", pa.binary()), ("groups", pa.string()),
])
FRAGMENT = "row bigint, part bigint, counts array<bigint>, opens array<array<bigint>>, pairs binary, times binary, groups string"


def _packed(row: int, part: int, f: Fragment, groups: str | None) -> tuple:
    """A fragment as a row; ``groups`` is left out where only the numbers are joined."""
    keys = np.array([p << 32 | q for p, q in f.pairs], "<u8")
    order = keys.argsort()
    times = np.fromiter(f.pairs.values(), np.int64, len(f.pairs))[order]
    sides = [f.head[0], f.head[1], f.tail[0], f.tail[1]]
    opens = [[x[k] for x in side] for side in sides for k in (0, 1)]
    counts = [f.start, f.end, f.n_a, f.n_b, f.n_groups, int(f.shared), int(f.sound)]
    return row, part, counts, opens, keys[order].tobytes(), _times(times), groups


def _unpacked(counts, opens, pairs: bytes, times: bytes, groups: str | None) -> Fragment:
    start, end, n_a, n_b, n_groups, shared, sound = counts
    a, b, c, d = (list(zip(opens[2 * i], opens[2 * i + 1])) for i in range(4))
    found = Counter()
    for k, n in zip(np.frombuffer(pairs, "<u8").tolist(), np.frombuffer(times, "<u4").tolist()):
        found[k >> 32, k & 0xFFFFFFFF] = n
    return Fragment((a, b), start, bool(shared), end, (c, d), n_a, n_b, n_groups, found, [groups] if groups else [], bool(sound))


def _fragments(chunks: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary, pieces)
        for batch in slices(batches, "text_a", 1_000_000):
            for row, part, at_a, text_a, at_b, text_b in zip(*[batch[c].to_pylist() for c in _CHUNK.names]):
                a = aligner.tokens([text_a])[0][0] if text_a else []
                b = aligner.tokens([text_b])[0][1] if text_b else []
                sound = b"".join([aligner.bytes_a[i] for i in a]) == text_a.encode() and b"".join([aligner.bytes_b[i] for i in b]) == text_b.encode()
                f = Fragment.of(aligner.ends(a, aligner.bytes_a, at_a), aligner.ends(b, aligner.bytes_b, at_b), sound)
                yield _batch(_FRAGMENT, [_packed(row, part, f, ";".join(f.groups))])

    return chunks.mapInArrow(run, FRAGMENT)


def _joined(fragments: DataFrame, arity: int) -> DataFrame:
    """One round of the tree: up to ``arity`` neighbours become one, without the text of their groups."""

    def fold(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group[c].to_pylist() for c in _FRAGMENT.names]), key=lambda r: r[1])
        whole = reduce(Fragment.join, [_unpacked(*r[2:6], None) for r in rows])
        return pa.Table.from_batches([_batch(_FRAGMENT, [_packed(rows[0][0], rows[0][1] // arity, whole, None)])])

    return fragments.groupBy("row", F.floor(F.col("part") / arity).alias("above")).applyInArrow(fold, FRAGMENT)


def _digests(fragments: DataFrame) -> DataFrame:
    """(row, groups_sha256): a document's fragments stream through one task in order, which holds one open group."""
    schema = pa.schema([("row", pa.int64()), ("groups_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest, whole, any_ = None, None, None, False

        def write() -> None:
            nonlocal any_
            for g in whole.groups:
                digest.update((";" + g if any_ else g).encode())
                any_ = True
            whole.groups, whole.pairs = [], Counter()

        for batch in slices(batches, "groups", 4_000_000):
            for r, _, counts, opens, _, _, groups in zip(*[batch[c].to_pylist() for c in _FRAGMENT.names]):
                one = _unpacked(counts, opens, b"", b"", groups)
                if r != row:
                    if row is not None:
                        yield _batch(schema, [(row, digest.hexdigest())])
                    row, digest, any_, whole = r, sha256(), False, Fragment()
                whole = whole.join(one)
                if whole.shared and whole.head[0]:
                    whole.finish()
                write()
        if row is not None:
            yield _batch(schema, [(row, digest.hexdigest())])

    ordered = fragments.repartition("row").sortWithinPartitions("row", "part")
    return ordered.mapInArrow(run, "row bigint, groups_sha256 string")


def _align_long(docs: DataFrame, vocabulary: str, pieces: str, chunk: int, arity: int) -> DataFrame:
    """Texts (row, doc, text) aligned in chunks over all tasks, whose fragments are joined in a tree."""
    own = Aligner(vocabulary, pieces)
    shift, kind = own.shift, own.kind
    chunk = chunk if own.spaces else 1 << 62

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1):
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                for part, (at_a, a, at_b, b) in enumerate(chunks_of(" " + text, chunk)):
                    yield _batch(_CHUNK, [(row, part, at_a, a, at_b, b)])

    docs = cut(docs)
    chunks = docs.mapInArrow(split, "row bigint, part bigint, at_a bigint, text_a string, at_b bigint, text_b string")
    fragments = cut(_fragments(chunks.repartition("row", "part"), vocabulary, pieces))
    digests = _digests(fragments)
    most = fragments.agg(F.max("part")).first()[0] or 0
    tree = fragments
    while True:
        tree = cut(_joined(tree, arity))
        most //= arity
        if most == 0:
            break

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, digest, *packed in zip(*[batch[c].to_pylist() for c in ("row", "doc", "groups_sha256", *_FRAGMENT.names[2:6])]):
                f = _unpacked(*packed, None).finish()
                if not f.sound:
                    yield _batch(_ALIGNED, [(row, doc, *_NOTHING)])
                    continue
                pairs = np.array([p << shift | q for p, q in f.pairs], kind)
                order = pairs.argsort()
                times = np.fromiter(f.pairs.values(), np.int64, len(f.pairs))[order]
                yield _batch(_ALIGNED, [(row, doc, f.n_a, f.n_b, f.n_groups, digest, pairs[order].tobytes(), _times(times))])

    whole = tree.join(digests, "row").join(docs.select("row", "doc"), "row")
    return whole.select("row", "doc", "groups_sha256", *_FRAGMENT.names[2:6]).mapInArrow(close, ALIGNED)


def _counted(aligned: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n) in how many documents each pair of ids is linked; tasks add up before the shuffle."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.frombuffer(b"".join(held), kind), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], schema=schema)

        for batch in batches:
            for p in batch["pairs"].to_pylist():
                held.append(p)
                size += len(p)
                if size > 16_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


_SCORED = pa.schema([
    ("row", pa.int64()), ("doc", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()),
])
SCORED = (
    "row bigint, doc bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)


def _scored(aligned: DataFrame, known, kind: np.dtype) -> DataFrame:
    """Documents with sums over those of their links that are among the known pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            links, good, total = [], [], []
            for own, times in zip(batch["pairs"].to_pylist(), batch["times"].to_pylist()):
                keys, times = np.frombuffer(own, kind), np.frombuffer(times, "<u4").astype(np.int64)
                links.append(int(times.sum()))
                at = np.searchsorted(pairs, keys)
                hit = at < len(pairs)
                hit[hit] = pairs[at[hit]] == keys[hit]
                at, times = at[hit], times[hit]
                good.append(int(times[best[at]].sum()))
                total.append(int((times * n[at]).sum()))
            same = [batch[c] for c in ("row", "doc", "n_a", "n_b", "n_groups")]
            columns = [*same, *(pa.array(c, pa.int64()) for c in (links, good, total)), batch["groups_sha256"]]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCORED)

    return aligned.mapInArrow(run, SCORED)


def align(
    docs: DataFrame, vocabulary: str, pieces: str, doc_id: str = "doc_id", text: str = "text", chunk: int = 65_536,
    long: int = 1_000_000, arity: int = 16, block: int = 2_000_000,
) -> DataFrame:
    """Per document: tokens of both tokenizers, groups that begin and end at shared byte offsets, links of tokens whose
    bytes overlap, how many are among those their first id has in most documents, and the sum of the links' document counts.

    Texts of up to ``long`` characters are aligned where they are read. Longer ones are cut into chunks of about ``chunk`` characters, which
    go to all tasks; the fragments they yield are joined ``arity`` at a time until one a document is left. Links
    are kept as sorted pairs of ids in a table in the checkpoint folder. The counts of all pairs are
    computed by Spark; tasks look them up in blocks of about ``block`` pairs, each broadcast by itself, so that no task
    or driver holds more. All links of an id are in one block.

    ``vocabulary`` and ``pieces`` must be at their paths on every executor. Null and empty texts, and those whose bytes either tokenizer
    changes, have no tokens: zeros and an empty digest. Repeated rows count each, null ids stay null,
    an empty table gives none, further columns are not looked at.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    size = F.coalesce(F.length("text"), F.lit(0))
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    size = F.coalesce(F.length("text"), F.lit(0))
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    _align(given.where(size <= long), vocabulary, pieces).write.option("compression", "zstd").parquet(f"{folder}/short")
    _align_long(given.where(size > long), vocabulary, pieces, chunk, arity).write.option("compression", "zstd").parquet(f"{folder}/long")
    aligned = spark.read.schema(ALIGNED).parquet(f"{folder}/short", f"{folder}/long")
    own = Aligner(vocabulary, pieces)
    counts = cut(_counted(aligned, own.kind).withColumn("first", F.shiftright("pair", own.shift)))
    highest = counts.groupBy("first").agg(F.max("n").alias("most"))
    ranked = counts.join(highest, "first").select("first", "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    blocks, found = max(1, -(-counts.count() // block)), []
    for b in range(blocks):
        part = ranked.where(F.pmod(F.xxhash64("first"), F.lit(blocks)) == b).select("pair", "n", "best").toArrow()
        pair, n, best = (part[c].to_numpy() for c in ("pair", "n", "best"))
        order = pair.argsort()
        known = spark.sparkContext.broadcast((pair[order].astype(own.kind), n[order], best[order].astype(bool)))
        found.append(_scored(aligned, known, own.kind))
    scored = reduce(DataFrame.unionByName, found)
    if blocks > 1:
        sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
        same = [F.first(c).alias(c) for c in ("doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
        scored = scored.groupBy("row").agg(*same, *sums)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return scored.select(F.col("doc").alias(doc_id), *columns)
