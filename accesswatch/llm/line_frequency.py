"""Quality rules: word and line statistics of a text, and lines that a host repeats across documents.

Everything here is made of DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import cut, text_digest, text_or_empty

_BLANK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(c, _BLANK), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it and wherever filters move it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, of: Callable[[list[Column], Column], Column]) -> Column:
    """An array of ``of(five words, place)`` for each window."""
    last = F.size(words) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of([F.get(words, i + k) for k in range(WINDOW)], i))


def _covered(places: Column) -> Column:
    """Words in windows that begin at these sorted places."""
    steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _repeated(words: Column) -> Column:
    """Words in windows found twice or more. Windows are compared by hash; only where two hashes agree are the
    windows themselves sorted with their places, so the figure is exact and costs n log n for any text."""

    def exact(z: Column) -> Column:
        twice = F.filter(z, lambda x, k: (x["g"] == F.get(z, k - 1)["g"]) | (x["g"] == F.get(z, k + 1)["g"]))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), _covered)

    sorted_windows = F.sort_array(
        _windows(words, lambda five, i: F.struct(F.concat_ws(" ", *five).alias("g"), i.alias("i")))
    )
    differ = _let(_windows(words, lambda five, i: F.xxhash64(*five)), lambda h: F.size(h) == F.size(F.array_distinct(h)))
    return F.when(differ, F.lit(0)).otherwise(_let(sorted_windows, exact))


def text_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``.

    They come out of a generator, below which filters on them are not moved, so each is computed once.
    """
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    both = F.struct(words_of(text).alias("w"), lines.alias("l"))
    figures = _let(
        both,
        lambda b: F.struct(
            F.size(b["w"]).alias("n_words"),
            F.length(F.array_join(b["w"], "")).alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
            (F.size(b["l"]) - F.size(F.array_distinct(b["l"]))).alias("n_dup_lines"),
            _repeated(b["w"]).alias("n_repeat_words"),
        ),
    )
    return docs.select(*keep, F.inline(F.array(figures)))


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """Each distinct (host, text) once: host, digest and its lines with a word as (hash, words, place in the text).

    A line is normalised to its words, so blanks around and between them do not matter.
    """
    text = text_or_empty()
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("text"), i.alias("place")))
    own = F.transform(
        F.filter(placed, lambda x: x["text"].rlike(_WORD)),
        lambda x: F.struct(words_of(x["text"]).alias("w"), x["place"].alias("place")),
    )
    entry = F.transform(
        own, lambda x: F.struct(F.xxhash64(x["w"]).alias("line"), F.size(x["w"]).alias("words"), x["place"].alias("place"))
    )
    return docs.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_digest().alias("digest"),
        entry.alias("lines"),
    ).distinct()


def frequent_lines(texts: DataFrame, min_docs: int, share_pct: int) -> DataFrame:
    """(host, line) of lines found in at least ``min_docs`` texts and in more than ``share_pct`` % of the host's texts."""
    each = texts.select("host", F.explode(F.array_distinct("lines.line")).alias("line"))
    count = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    total = texts.groupBy("host").agg(F.count("*").alias("texts"))
    return count.join(total, "host").where(100 * F.col("n") > share_pct * F.col("texts")).select("host", "line")


def _without(text: Column, places: Column) -> Column:
    """``text`` without its lines at these sorted places; a null array leaves it as it is."""

    def joined(b: Column) -> Column:
        lines, gone = b["lines"], b["gone"]
        ends = F.concat(gone, F.array(F.size(lines)))
        runs = F.transform(
            ends, lambda end, k: _let(F.coalesce(F.get(gone, k - 1) + 1, F.lit(0)), lambda s: F.slice(lines, s + 1, end - s))
        )
        return F.array_join(F.flatten(runs), "\n")

    both = F.struct(F.split(text, "\n").alias("lines"), places.alias("gone"))
    return F.when(places.isNull(), text).otherwise(_let(both, joined))


def judge_documents(
    docs: DataFrame, keep: list[str], host: str = "source", min_docs: int = 5, share_pct: int = 5,
    min_words: int = 10, max_repeat_pct: int = 20, min_left_pct: int = 30,
) -> DataFrame:
    """Columns ``keep`` with the statistics, ``n_left_words``, ``left_text``, ``base_failed`` and ``kept``, one row per row.

    Normalised lines are hashed and counted once per distinct text of a host, so exact copies, which
    deduplication removes, do not make each other's lines frequent. A line in more than ``share_pct`` % of a host's
    texts, and in ``min_docs`` at least, so that no line of a small host counts by itself, is removed from the host's documents: ``left_text`` is the text without such lines, ``n_left_words`` counts its
    words; the statistics and base rules are those of the whole text. A document is rejected if the base rules fail, or if lines were
    removed and fewer than ``min_words`` words or ``min_left_pct`` % of them are left.

    Null and empty texts have no words and fail the base rules. A null host is a host of its own, the
    same as the empty one. Repeated rows are judged alike. Two lines share a 64-bit hash with a
    probability far below any use of the figure.
    """
    texts = cut(host_lines(docs, host))
    removed = (
        texts.select("host", "digest", F.explode("lines").alias("l"))
        .select("host", "digest", "l.*")
        .join(frequent_lines(texts, min_docs, share_pct), ["host", "line"])
        .groupBy("host", "digest").agg(
            F.sum("words").alias("removed"), F.sort_array(F.collect_list("place")).alias("places")
        )
    )
    base = text_statistics(
        docs,
        [F.struct(*keep).alias("row"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
         text_digest().alias("digest"), F.col("text").cast("string").alias("_text")],
    )
    n, left = F.col("n_words"), F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    failed = (n < min_words) | (100 * F.col("n_repeat_words").cast("long") > max_repeat_pct * n.cast("long"))
    depleted = F.col("removed").isNotNull() & ((left < min_words) | (100 * left < min_left_pct * n))
    joined = base.join(removed, ["host", "digest"], "left")
    return joined.withColumn("left_text", _without(F.col("_text"), F.col("places"))).select(
        "row.*",
        *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        left.cast("long").alias("n_left_words"),
        "left_text",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
    )
