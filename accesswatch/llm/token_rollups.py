"""Token totals by source, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from accesswatch.llm.common import slices
from accesswatch.llm.tokens import Encoder

KEYS = ["source", "lang", "version"]
TOTALS = "source string, lang string, version string, n_docs bigint, n_tokens bigint, n_chars bigint"


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows that add documents; ``counts`` has source, lang, version, tokens, chars."""
    return counts.select(*KEYS, "tokens", "chars", F.lit(1).alias("sign"))


def deleted(counts: DataFrame) -> DataFrame:
    """Signed rows that take documents out, by the counts they were added with."""
    return counts.select(*KEYS, "tokens", "chars", F.lit(-1).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace counts, and keys too if they differ."""
    return deleted(old).unionByName(inserted(new))


class TokenCounter:
    """Numbers of tokens by several vocabularies, which share one cut of each text (see ``Encoder``).

    A memory holds a number a word and vocabulary, and starts anew beyond ``most`` characters of words.
    """

    def __init__(self, vocabularies: list[str], pattern: str | None = None, most: int = 4_000_000):
        self._encoders = [Encoder(v, pattern) for v in vocabularies]
        self._known: list[dict[str, int]] = [{} for _ in vocabularies]
        self._line_end = [len(e.encode(["\n"])[0]) // 4 for e in self._encoders]
        self._held, self._most = 0, most

    def cut(self, text: str) -> list[list[str]]:
        """Lines of words; a word but the first of a line has its space."""
        e = self._encoders[0]
        lines = [e._cut.split(text)] if e._uneven(text) else [line.split(" ") for line in text.split("\n")]
        return [[line[0], *[" " + w for w in line[1:]]] for line in lines]

    def learn(self, texts: list[list[list[str]]]) -> None:
        if self._held > self._most:
            for known in self._known:
                known.clear()
            self._held = 0
        new = [w for w in {w for lines in texts for line in lines for w in line} if w not in self._known[0]]
        self._held += sum(len(w) + 16 for w in new)
        heads: dict[str, list[str]] = {}
        whole = []
        for w in new:
            # Letters and the marks after them are pieces of their own, so letters are merged once for all marks.
            m = Encoder._tailed.fullmatch(w.removeprefix(" "))
            if m is not None and m[1].isalpha():
                heads.setdefault(w[: len(w) - len(m[2])], []).append(w)
            else:
                whole.append(w)
        for encoder, known in zip(self._encoders, self._known):
            known.update(zip(whole, map(len, encoder._many(whole))))
            tails: dict[str, int] = {}
            for head, words in heads.items():
                n = len(encoder._piece(head))
                for w in words:
                    tail = w[len(head) :]
                    if tail and tail not in tails:
                        tails[tail] = len(encoder._piece(tail))
                    known[w] = n + (tails[tail] if tail else 0)

    def count(self, lines: list[list[str]]) -> list[int]:
        """Tokens of a text that was cut and learnt, a number a vocabulary."""
        return [
            sum([sum(map(known.__getitem__, line)) for line in lines]) + end * (len(lines) - 1)
            for known, end in zip(self._known, self._line_end)
        ]


def counted(docs: DataFrame, vocabularies: list[str], pattern: str | None = None, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and ``tokens``, a number a vocabulary; where a text repeats lines also
    ``new_chars`` and ``new_tokens`` without the repeated lines, else null.

    One worker a task counts both texts by all vocabularies. Null and empty texts have no tokens. Repeated rows
    are counted each; columns of any name pass through.
    """
    carried = [c for c in docs.columns if c != text]
    given = docs.select(F.struct(*carried).alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = T.StructType.fromDDL("tokens array<bigint>, new_chars bigint, new_tokens array<bigint>")
    out = T.StructType([given.schema["_row"], *made.fields])
    arrow = to_arrow_schema(out)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabularies, pattern)
        for batch in slices(batches, "text", 1_000_000):
            texts = batch["text"].to_pylist()
            lines = [t.split("\n") for t in texts]
            once = ["\n".join(kept) if len(kept) < len(own) else None for own in lines for kept in [list(dict.fromkeys(own))]]
            cuts, again = [counter.cut(t) for t in texts], [None if t is None else counter.cut(t) for t in once]
            counter.learn(cuts + [c for c in again if c is not None])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_row"], pa.array(map(counter.count, cuts), arrow.field(1).type),
                    pa.array([None if t is None else len(t) for t in once], pa.int64()),
                    pa.array([None if c is None else counter.count(c) for c in again], arrow.field(3).type),
                ],
                schema=arrow,
            )

    return given.mapInArrow(count, out).select("_row.*", "tokens", "new_chars", "new_tokens")


class Rollup:
    """Totals in a shared folder.

    ``batches/<id>/<attempt>`` holds the summed signed rows of a batch, a row per key and not per document, so a batch costs one
    aggregation with partial sums and a reader adds up few rows. A batch counts once the marker ``commits/<id>`` exists, which
    names the attempt: it is created after the rows and only if there is none, so a batch that is repeated, whole or
    after a failure half way, or sent by two writers at once, counts once and its rows are never written over.
    ``compact`` folds committed batches into a numbered snapshot, of which each number is taken once, and removes their
    markers; a snapshot says which batches it covers, and a marker of a covered batch counts for nothing.

    Null source, language or version are groups of their own. A null count adds nothing, but its document
    counts. Repeated rows count each. Groups whose documents are all gone stay out of the totals.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        folder = self._path(kind)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _mark(self, kind: str, name: str, says: str) -> bool:
        """Create a marker with one line; False if there is one."""
        self._fs.mkdirs(self._path(kind))
        if self._fs.exists(self._path(kind, name)):
            return False
        try:
            out = self._fs.create(self._path(kind, name), False)
        except Exception as error:  # the other writer was first
            if "exist" not in str(error).lower():
                raise
            return False
        out.write(bytearray(says.encode()))
        out.close()
        return True

    def _said(self, kind: str, name: str) -> str | None:
        """A marker's line; None while it is being written."""
        size = self._fs.getFileStatus(self._path(kind, name)).getLen()
        if not size:
            return None
        file = self._fs.open(self._path(kind, name))
        try:
            return bytes(file.readNBytes(size)).decode()
        finally:
            file.close()

    def _snapshot(self) -> tuple[int, str | None]:
        """Number and folder of the last snapshot."""
        for name in reversed(self._names("snapshot_commits")):
            folder = self._said("snapshot_commits", name)
            if folder:
                return int(name), f"{self.root}/snapshots/{folder}"
        return 0, None

    def _covers(self, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{folder}/covers")

    def _fresh(self, folder: str | None) -> dict[str, str]:
        """Attempts of committed batches that a snapshot does not cover."""
        said = [(b, self._said("commits", b)) for b in self._names("commits")]
        marks = self.spark.createDataFrame([x for x in said if x[1]], "batch string, attempt string")
        return dict(map(tuple, marks.join(self._covers(folder), "batch", "left_anti").collect()))

    def has(self, batch: str) -> bool:
        """Whether a batch is committed."""
        return self._fs.exists(self._path("commits", batch)) or not self._covers(self._snapshot()[1]).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False, and no change, if it was committed before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        if self.has(batch):
            return False
        sums = signed.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("n_docs"),
            F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).cast("long").alias("n_tokens"),
            F.coalesce(F.sum(F.col("sign") * F.col("chars")), F.lit(0)).cast("long").alias("n_chars"),
        )
        attempt = uuid.uuid4().hex
        sums.write.parquet(f"{self.root}/batches/{batch}/{attempt}")
        return self._mark("commits", batch, attempt)

    def committed(self) -> list[str]:
        """All committed batches, for a look at them; nothing else here needs the whole list."""
        folder = self._snapshot()[1]
        return sorted([*self._fresh(folder), *(r.batch for r in self._covers(folder).collect())])

    def compact(self, name: str = "snapshot") -> bool:
        """Fold all committed batches into a snapshot; False, and no change, if another compaction was first."""
        number, folder = self._snapshot()
        fresh = self._fresh(folder)
        name = f"{name}-{uuid.uuid4().hex}"
        self._summed(folder, fresh).write.parquet(f"{self.root}/snapshots/{name}/totals")
        new = self.spark.createDataFrame([(b,) for b in fresh], "batch string")
        self._covers(folder).unionByName(new).write.parquet(f"{self.root}/snapshots/{name}/covers")
        if not self._mark("snapshot_commits", f"{number + 1:012d}", name):
            return False
        for b in fresh:
            self._fs.delete(self._path("commits", b), False)
        return True

    def _summed(self, folder: str | None, fresh: dict[str, str]) -> DataFrame:
        paths = [f"{folder}/totals"] * bool(folder) + [f"{self.root}/batches/{b}/{a}" for b, a in fresh.items()]
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*paths)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])

    def totals(self) -> DataFrame:
        folder = self._snapshot()[1]
        return self._summed(folder, self._fresh(folder)).where("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")
