"""Language identification: unigram piece models, a text's probability summed over all its segmentations."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import slices, text_or_empty

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SLOTS = 20


class Pieces:
    """A public byte-level vocabulary: its pieces of up to ``longest`` bytes, and every single byte."""

    def __init__(self, path: str, longest: int = 12):
        with open(path, "rb") as lines:
            found = {base64.b64decode(line.split()[0]) for line in lines}
        found = {p for p in found if len(p) <= longest and p == p.lower() and b" " not in p[1:]}
        self.pieces = sorted(found | {bytes([b]) for b in range(256)})
        self.longest = longest
        self.hashes = np.array([_hash(p) for p in self.pieces], np.uint64)
        # Two tables by different bits of the hash: a piece is in the second if its place in the first is taken.
        self.first, self.second = np.full(1 << _SLOTS, -1, np.int32), np.full(1 << _SLOTS, -1, np.int32)
        self.rest: dict[int, int] = {}
        for i, h in enumerate(self.hashes.tolist()):
            a, b = h >> (64 - _SLOTS), (h >> 20) & ((1 << _SLOTS) - 1)
            if self.first[a] < 0:
                self.first[a] = i
            elif self.second[b] < 0:
                self.second[b] = i
            else:
                self.rest[h] = i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        a = self.first[(h >> _U(64 - _SLOTS)).astype(np.int64)]
        b = self.second[((h >> _U(20)) & _U((1 << _SLOTS) - 1)).astype(np.int64)]
        out = np.where((a >= 0) & (self.hashes[a] == h), a, np.where((b >= 0) & (self.hashes[b] == h), b, -1))
        for known, i in self.rest.items():
            out[h == _U(known)] = i
        return out


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = ((h + b + 1) * int(_BASE)) % (1 << 64)
        h ^= h >> 29
    return h


#: Longer words are cut into parts of this many bytes, which pieces do not cross.
PART = 32


def words_of(text: str) -> list[bytes]:
    """Lower-cased words between blanks, each with a space before it, long ones in parts."""
    out = []
    for w in text.lower().encode().split():
        w = b" " + w
        out.extend([w] if len(w) <= PART else [w[i : i + PART] for i in range(0, len(w), PART)])
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes as a matrix) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)


def _steps(pieces: Pieces, letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces) of all pieces in words of one length, by start."""
    n = letters.shape[1]
    for i in range(n):
        h = np.zeros(len(letters), np.uint64)
        for j in range(i, min(n, i + pieces.longest)):
            h = (h + letters[:, j] + _U(1)) * _BASE
            h ^= h >> _U(29)
            found = pieces.find(h)
            rows = np.flatnonzero(found >= 0)
            if len(rows):
                yield i, j + 1, rows, found[rows]


def forward(pieces: Pieces, p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log-probability of each word under each language: the sum over all its segmentations. ``p``: pieces x languages."""
    out = np.empty((len(words), p.shape[1]))
    for at, letters in _by_length(words):
        alpha = np.zeros((letters.shape[1] + 1, len(at), p.shape[1]))
        alpha[0] = 1
        for i, j, rows, found in _steps(pieces, letters):
            alpha[j, rows] += alpha[i, rows] * p[found]
        out[at] = np.log(alpha[-1])
    return out


def expected(pieces: Pieces, p: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language. ``counts``: words x languages."""
    out = np.zeros_like(p)
    for at, letters in _by_length(words):
        n = letters.shape[1]
        steps = list(_steps(pieces, letters))
        alpha, beta = np.zeros((2, n + 1, len(at), p.shape[1]))
        alpha[0], beta[n] = 1, 1
        for i, j, rows, found in steps:
            alpha[j, rows] += alpha[i, rows] * p[found]
        for i, j, rows, found in sorted(steps, key=lambda s: -s[0]):
            beta[i, rows] += beta[j, rows] * p[found]
        share = counts[at] / alpha[n]
        for i, j, rows, found in steps:
            np.add.at(out, found, alpha[i, rows] * p[found] * beta[j, rows] * share[rows])
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    vocabulary: str
    longest: int
    p: np.ndarray
    most: int = 300_000
    _pieces: Pieces | None = None
    _known: dict[bytes, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its probability among the learned ones); ('und', 0) without a letter."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        self._learn(set().union(*words))
        out = []
        for text, own in zip(texts, words):
            if not any(map(str.isalpha, text)):
                out.append(("und", 0.0))
                continue
            total = self._rows[np.fromiter(map(self._known.__getitem__, own), np.int64, len(own))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Scores of words not met yet are added to a memory of bounded size."""
        if self._pieces is None:
            self._pieces = Pieces(self.vocabulary, self.longest)
        if len(self._known) > self.most or self._rows is None:
            self._known, self._rows = {}, np.empty((0, len(self.languages)))
        new = list(words - self._known.keys())
        if new:
            begin = len(self._rows)
            self._rows = np.concatenate((self._rows, forward(self._pieces, self.p, new)))
            self._known.update(zip(new, range(begin, begin + len(new))))

    def __getstate__(self):
        return self.__dict__ | {"_pieces": None, "_known": {}, "_rows": None}


def fit_language(
    documents: DataFrame, vocabulary: str, sample: int = 1500, window: int = 4000, rounds: int = 3, longest: int = 12
) -> LanguageModel:
    """Piece probabilities of each language from ``documents`` (doc_id, text, lang), by expectation and maximisation.

    Of each language about ``sample`` documents are drawn by a hash of their id, and of each a stretch of up to
    ``window`` characters at a hashed place; both bound what reaches the driver. Null languages and ids are left out.
    Each piece has a small share of the probability even where it was not met, so every text has a probability.
    """
    known = documents.select("doc_id", text_or_empty().alias("text"), "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    total = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(total)
    if not languages:
        return LanguageModel([], vocabulary, longest, np.zeros((0, 0)))
    spark = documents.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, sample / n)) for k, n in total.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.col("share") * 1_000_000
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - window + 1))
    rows = (
        known.join(F.broadcast(shares), "lang").where(draw)
        .select("lang", F.col("text").substr((place + 1).cast("int"), F.lit(window)).alias("text")).collect()
    )
    met: dict[str, Counter] = {k: Counter() for k in languages}
    for r in rows:
        met[r.lang].update(words_of(r.text))
    words = sorted(set().union(*met.values()))
    counts = np.array([[met[k][w] for k in languages] for w in words], float).reshape(len(words), len(languages))
    pieces = Pieces(vocabulary, longest)
    p = np.array([[256.0 ** -(len(x) ** 0.5)] * len(languages) for x in pieces.pieces])
    p /= p.sum(axis=0)
    for _ in range(rounds):
        uses = expected(pieces, p, words, counts) if words else np.zeros_like(p)
        p = (uses + 0.1) / (uses + 0.1).sum(axis=0)
    return LanguageModel(languages, vocabulary, longest, p)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``, from the whole text. Null and letterless texts are 'und', 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = docs.select(F.struct(*keep).alias("row"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", 2_000_000):
            found = model.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    schema = row.schema.__class__(row.schema.fields[:1]).add("lang_pred", "string").add("score", "double")
    return row.mapInArrow(run, schema).select("row.*", "lang_pred", "score")
