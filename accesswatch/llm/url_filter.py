"""URL filter: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import ascii_lower, cut

#: Rules held in one broadcast trie. More rules are matched in blocks of about this size.
MAX_RULES = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_FOUND = "rule string, verdict string, host_chars int, path_chars int"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(u, _URL, 1)), F.regexp_extract(u, _URL, 2)


class Trie:
    """Rules by reversed host label, then by whole path segment.

    A node is ``{"hosts": {label: node}, "path": {"next": {segment: ...}, "ends": {begun segment: rule}}}``;
    ``ends`` holds what a rule's path says after its last slash, mostly nothing.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            node = node.setdefault("path", {})
            *whole, begun = path.split("/")
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if verdict == "block" or begun not in ends:
                ends[begun] = (host + path, verdict, len(host), len(path))

    def find(self, host: str, path: str):
        """The rule with the longest host, then the longest path, or None."""
        best, node = None, self.root
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            best = self._along(node["path"], path) or best if "path" in node else best
            label = next(labels, None)
            node = node.get("hosts", {}).get(label) if label is not None else None
        return best

    @staticmethod
    def _along(node: dict, path: str):
        best, at = None, 0
        while True:
            rest = path[at:]
            fits = [begun for begun in node.get("ends", ()) if rest.startswith(begun)]
            if fits:
                best = node["ends"][max(fits, key=len)]
            slash = path.find("/", at)
            node = node.get("next", {}).get(path[at:slash]) if slash >= 0 else None
            if node is None:
                return best
            at = slash + 1


def _lookup(rules: list[tuple[str, str, str]], spark) -> Column:
    shared = spark.sparkContext.broadcast(rules)
    built: list[Trie] = []

    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if not built:
            built.append(Trie(shared.value))
        for hosts, paths in parts:
            rows = [built[0].find(h, p) or (None, None, None, None) for h, p in zip(hosts, paths)]
            out = pd.DataFrame(rows, columns=["rule", "verdict", "host_chars", "path_chars"], dtype=object)
            yield out.astype({"host_chars": "Int32", "path_chars": "Int32"})

    return F.pandas_udf(found, _FOUND)


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` ('allow' or 'block') in a struct ``judged``.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains where the url's path
    starts with the rule's (its host '' fits every host). The longest host wins, then the longest path; of two equal rules
    the block. Where none fits, ``rule`` is null and ``default`` holds. Null or malformed urls have an
    empty host and path. Rules with a null are ignored; repeated pages are judged one by one.

    Up to ``max_rules`` rules are one broadcast trie. More are dealt by a hash of their host into blocks
    of about that size; the pages pass each block, with a checkpoint between, and the longest match stays.
    """
    spark = pages.sparkSession
    clean = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().distinct()
    n = clean.count()
    blocks = max(1, -(-n // max_rules))
    host, path = host_and_path(url)
    best = None
    out = pages.withColumn("judged", F.struct(host.alias("host"), path.alias("path"), *_none()))
    for block in range(blocks):
        held = clean if blocks == 1 else clean.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == block)
        lookup = _lookup([tuple(r) for r in held.collect()], spark)
        found = lookup(F.col("judged.host"), F.col("judged.path"))
        out = out.withColumn("_found", found)
        old, new = F.col("judged"), F.col("_found")
        longer = new["rule"].isNotNull() & (
            old["rule"].isNull()
            | (F.struct(new["host_chars"], new["path_chars"]) > F.struct(old["host_chars"], old["path_chars"]))
        )
        best = F.struct(
            old["host"].alias("host"), old["path"].alias("path"),
            *[F.when(longer, new[c]).otherwise(old[c]).alias(c) for c in ("rule", "verdict", "host_chars", "path_chars")],
        )
        out = out.withColumn("judged", best).drop("_found")
        if blocks > 1:
            out = cut(out)
    verdict = F.coalesce(F.col("judged.verdict"), F.lit(default))
    return out.withColumn(
        "judged",
        F.struct("judged.host", "judged.path", "judged.rule", verdict.alias("verdict")),
    )


def _none() -> list[Column]:
    return [
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("int").alias("host_chars"), F.lit(None).cast("int").alias("path_chars"),
    ]
