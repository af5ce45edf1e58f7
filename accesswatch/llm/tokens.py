"""Token ids of texts, with a bounded memory of pieces between spaces."""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids by a byte-level vocabulary: ``*.json`` for tokenizers, ``*.tiktoken`` for tiktoken.

    Both cut a text by one pattern before merging. A single space or line end between two characters that are not
    blank always begins or makes a piece of that pattern, so the text may be cut there, and what stands between
    is encoded once and remembered. Letters and the marks after them are pieces of their own too, so of new words only the
    letters are merged. ``tests/llm`` compares with the uncut text.
    """

    _cut = re.compile(r"(?<=\S) (?=\S)")
    _tailed = re.compile(r"([^\W\d_]+)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")

    def __init__(self, vocabulary: str, pattern: str | None = None, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer, letters = Tokenizer.from_file(vocabulary), _byte_letters()
            model = tokenizer.model
            self._many = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._piece = lambda x: [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(letters))]
        else:
            import tiktoken

            with open(vocabulary, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._many = lambda texts: list(map(own.encode_ordinary, texts))
            self._piece = own.encode_ordinary
        self._most = most
        self._known: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}
        self._line_end = _packed(self._piece("\n"))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [
            [self._cut.split(t)] if self._uneven(t) else [line.split(" ") for line in t.split("\n")] for t in texts
        ]
        wanted: set[str] = set()
        for lines in cut:
            for p in lines:
                wanted.update(p)
        self._learn(self._known, wanted, " ")
        self._learn(self._first, {p[0] for lines in cut for p in lines}, "")
        known, first, end = self._known.__getitem__, self._first.__getitem__, self._line_end
        return [end.join([first(p[0]) + b"".join(map(known, p[1:])) for p in lines]) for lines in cut]

    @staticmethod
    def _uneven(text: str) -> bool:
        """Whether a space or line end stands beside a blank."""
        blanks = [c for c in set(text) if c.isspace()]
        return any(c + x in text or x + c in text for c in blanks for x in " \n")

    def _learn(self, memory: dict[str, bytes], wanted: set[str], before: str) -> None:
        """Ids of ``before`` and each wanted piece go into ``memory``."""
        if len(memory) > self._most:
            memory.clear()
        if len(self._tails) > self._most:
            self._tails.clear()
        other = []
        for x in wanted:
            if x not in memory:
                m = self._tailed.fullmatch(x)
                if m is None or not m[1].isalpha():
                    other.append(x)
                    continue
                head, tail = m.groups()
                if head not in memory:
                    memory[head] = _packed(self._piece(before + head))
                if tail:
                    if tail not in self._tails:
                        self._tails[tail] = _packed(self._piece(tail))
                    memory[x] = memory[head] + self._tails[tail]
        memory.update(zip(other, map(_packed, self._many([before + x for x in other]))))


def _packed(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def groups_of(texts: Sequence[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def token_count(text: Column, vocabulary: str, pattern: str | None = None) -> Column:
    """Number of tokens; null for null."""
    made: list[Encoder] = []

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not made:
            made.append(Encoder(vocabulary, pattern))
        for part in parts:
            texts = part.dropna()
            sizes = [len(x) // 4 for run in groups_of(texts.tolist()) for x in made[0].encode(run)]
            yield pd.Series(sizes, index=texts.index, dtype="Int64").reindex(part.index)

    count.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")(text)
