"""Runs in a shared folder, each of which a reader sees wholly or not at all.

``attempt=<number>/log_date=<day>`` holds the rows one attempt wrote, with the run and the number as columns ``run_id`` and
``arrival``. Numbers are taken one by one, so they tell in which order runs arrived, whatever their names. An attempt
counts once ``_commits/<number>`` exists, which names its run and days; of the attempts of a run the last one counts. The
folders of replaced attempts are removed after the commit, and a reader that comes before, or after a crash between the two,
reads the commits and never sees both; only one that has planned and not finished when a folder goes must read again. ``compact`` puts all that counts into one new attempt with a file a day, and its commit
says which attempts it covers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = re.compile(r"[\w.-]+")
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"
ARRIVAL, DAY, RUN = "arrival", "log_date", "run_id"


class RunStore:
    """The runs below ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda *parts: hadoop("/".join((self.path, *parts)))
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        folder = self._at(*parts)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def exists(self) -> bool:
        return self._fs.exists(self._at("_commits"))

    def _next(self) -> int:
        """A number above all others, taken by creating its file."""
        self._fs.mkdirs(self._at("_attempts"))
        while True:
            taken = self._names("_attempts")
            number = int(taken[-1]) + 1 if taken else 1
            # The highest file is never removed, so a number that is the highest once created was never taken before.
            if self._fs.createNewFile(self._at("_attempts", f"{number:012d}")) and self._names("_attempts")[-1] == f"{number:012d}":
                break
        for old in taken:
            self._fs.delete(self._at("_attempts", old), False)
        return number

    def _commit(self, number: int, says: dict) -> None:
        """The commit appears under its name with all it says."""
        self._fs.mkdirs(self._at("_commits"))
        draft = self._at("_drafts", f"{number:012d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(says).encode()))
        out.close()
        if not self._fs.rename(draft, self._at("_commits", f"{number:012d}")):
            raise OSError(f"could not commit attempt {number} of {self.path}")

    def _commits(self) -> dict[int, dict]:
        """What the commits say by number. A compaction may take some away between listing and reading: then anew."""
        for _ in range(5):
            said = {}
            for name in self._names("_commits"):
                at = self._at("_commits", name)
                if not self._fs.exists(at):
                    break
                file = self._fs.open(at)
                said[int(name)] = json.loads(bytes(file.readAllBytes()))
                file.close()
            else:
                return said
        raise OSError(f"the commits of {self.path} change all the time")

    def _state(self) -> tuple[dict[int, list[str]], dict[str, int], list[tuple[int, int]]]:
        """Days of each attempt that is read, the number that counts for each run, and what is not read: (attempt, arrival)."""
        commits = self._commits()
        latest: dict[str, int] = {}
        holder: dict[int, int] = {}
        for n, c in sorted(commits.items()):
            for run, own in c.get("covers", {}).items() if "covers" in c else [(c["run"], n)]:
                latest[run] = max(latest.get(run, 0), own)
                holder[own] = max(holder.get(own, 0), n)
        live = {holder[n] for n in latest.values()}
        # Of what a compaction holds, runs that came again since, and what a later compaction holds too, are left out.
        dead = [
            (n, own) for n in live for run, own in commits[n].get("covers", {}).items()
            if latest[run] != own or holder[own] != n
        ]
        return {n: commits[n]["days"] for n in live}, latest, dead

    def arrivals(self) -> dict[str, int]:
        """The arrival number that counts for each run."""
        return self._state()[1]

    def days(self) -> dict[int, list[str]]:
        """Days of each attempt that is read."""
        return self._state()[0]

    def note(self, text: str | None = None) -> str | None:
        """A note beside the runs; with ``text`` it is replaced."""
        at = self._at("_note")
        if text is not None:
            draft = self._at("_drafts", "note")
            out = self._fs.create(draft, True)
            out.write(bytearray(text.encode()))
            out.close()
            self._fs.delete(at, False)
            self._fs.rename(draft, at)
            return text
        if not self._fs.exists(at):
            return None
        file = self._fs.open(at)
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def write(self, df: DataFrame, run: str) -> int:
        """Store the rows of a run in place of its former ones, and return its arrival number."""
        if not _RUN.fullmatch(run):
            raise ValueError(f"a run id has letters, digits, _, . and -, not {run!r}")
        number = self._next()
        rows = df.withColumns({DAY: F.to_date("Timestamp"), RUN: F.lit(run), ARRIVAL: F.lit(number).cast("bigint")})
        rows.write.partitionBy(DAY).parquet(f"{self.path}/attempt={number}")
        self._commit(number, {"run": run, "days": self._days(number)})
        self._remove_replaced()
        return number

    def _days(self, number: int) -> list[str]:
        return [n.removeprefix(f"{DAY}=") for n in self._names(f"attempt={number}") if n.startswith(f"{DAY}=")]

    def _remove_replaced(self) -> None:
        """Folders and commits that no reader of the present commits needs; attempts not committed yet stay."""
        commits = self._commits()
        live = self._state()[0]
        for n in commits:
            if n not in live:
                self._fs.delete(self._at("_commits", f"{n:012d}"), False)
                self._fs.delete(self._at(f"attempt={n}"), True)

    def read(
        self, schema: T.StructType | None = None, days: Iterable[str] | None = None, first: date | None = None,
        last: date | None = None, arrivals: set[int] | None = None,
    ) -> DataFrame:
        """Rows that count, of all days or of some, of all arrivals or of some; empty if there are none. Only the folders
        of these days, and the attempts that hold these arrivals, are listed."""
        state = self._state()
        if arrivals is None:
            return self._rows(state, schema, days, first, last)
        commits = self._commits()
        holders = {self._holder(n, commits) for n in arrivals}
        state = ({n: d for n, d in state[0].items() if n in holders}, *state[1:])
        return self._rows(state, schema, days, first, last).where(F.col(ARRIVAL).isin(sorted(arrivals)))

    def _holder(self, own: int, commits: dict[int, dict]) -> int:
        """The attempt that holds the rows of an arrival."""
        return max(n for n, c in commits.items() if n == own or own in c.get("covers", {}).values())

    def read_run(self, run: str) -> DataFrame | None:
        """The rows of one run, from the attempt that holds them alone; None if there is no such run."""
        live, latest, _ = self._state()
        if run not in latest:
            return None
        own = latest[run]
        holder = self._holder(own, self._commits())
        return self._rows(({holder: live[holder]}, {}, [])).where(F.col(ARRIVAL) == own)

    def _rows(self, state, schema=None, days=None, first=None, last=None, merge: bool = False) -> DataFrame:
        live, _, dead = state
        chosen, whole = None if days is None else set(days), days is None and first is None and last is None

        def wanted(d: str) -> bool:
            if d == _NO_DAY or whole:
                return whole
            return (chosen is None or d in chosen) and (first is None or d >= str(first)) and (last is None or d <= str(last))

        folders = [(f"{self.path}/attempt={n}/{DAY}={d}", wanted(d)) for n, held in sorted(live.items()) for d in held]
        paths = [f for f, inside in folders if inside]
        reader = self.spark.read.option("basePath", self.path).option("mergeSchema", merge)
        if schema is not None:
            own = [f for f in schema.fields if f.name not in (ARRIVAL, DAY)]
            more = [T.StructField(ARRIVAL, T.LongType()), T.StructField("attempt", T.IntegerType()), T.StructField(DAY, T.DateType())]
            schema = T.StructType([*own, *more])
            reader = reader.schema(schema)
        if paths:
            rows = reader.parquet(*paths)
        elif schema is not None:
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = reader.parquet(folders[0][0] if folders else self.path).where(F.lit(False))
        for n in {n for n, _ in dead} if paths else ():
            rows = rows.where((F.col("attempt") != n) | ~F.col(ARRIVAL).isin([own for m, own in dead if m == n]))
        return rows.drop("attempt")

    def compact(self) -> int:
        """One attempt with all that counts, a file a day unless a day is larger than Spark's advised partition."""
        state = self._state()
        number = self._next()
        rows = self._rows(state, merge=True)
        rows.hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{self.path}/attempt={number}")
        self._commit(number, {"covers": state[1], "days": self._days(number)})
        self._remove_replaced()
        return number
