"""Rows of a run store in a table bucketed by log id, brought up to date by what arrived since."""

from __future__ import annotations

import json
import uuid
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesswatch.sources.store import ARRIVAL, RunStore


class BucketedRows:
    """Bucketed copy of a run store's rows, below ``path``.

    ``refresh`` adds the runs that arrived since the last one, shuffled once into ``buckets`` buckets by ``key``; what
    was there before is neither read nor moved. A folder ``part=<id>`` holds what one refresh added and counts once
    ``_parts/<id>`` exists, which names the arrivals in it. ``rows`` is a scan that Spark knows to be dealt out by ``key``, so
    grouping and joining two such tables of as many buckets by it need no shuffle. Arrivals that were replaced in the store
    are left out. ``fold`` puts all parts into one again, bucket by bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "LogID", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        own = [f for f in schema.fields if f.name not in (ARRIVAL, "part")]
        self.schema = T.StructType([*own, T.StructField(ARRIVAL, T.LongType())])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda *parts: hadoop("/".join((self.path, *parts)))
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> dict[str, dict[str, int]]:
        """Arrivals by run of each part that counts; a fold names the parts it replaces."""
        folder, said = self._at("_parts"), {}
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
            file = self._fs.open(f.getPath())
            said[f.getPath().getName()] = json.loads(bytes(file.readAllBytes()))
            file.close()
        gone = {p for s in said.values() for p in s["replaces"]}
        return {p: s["runs"] for p, s in said.items() if p not in gone}

    def _add(self, rows: DataFrame, runs: dict[str, int], replaces: list[str]) -> None:
        part = uuid.uuid4().hex
        # Rows of a bucket are dealt to one task by the same hash that files are bucketed by, so it writes one file.
        dealt = rows.select(*self.schema.names).repartition(self.buckets, self.key)
        name = self._table(part)
        dealt.write.mode("append").insertInto(name)
        self.spark.sql(f"DROP TABLE {name}")
        draft = self._at("_drafts", part)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"runs": runs, "replaces": replaces}).encode()))
        out.close()
        self._fs.mkdirs(self._at("_parts"))
        if not self._fs.rename(draft, self._at("_parts", part)):
            raise OSError(f"could not commit part {part} of {self.path}")

    def _table(self, parts: str | list[str]) -> str:
        """A name in the session's catalogue for the files of one part, or for some parts as partitions, which says how
        they are bucketed."""
        name = "accesswatch_" + md5(json.dumps([self.path, parts]).encode()).hexdigest()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        bucketed = f"CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION"
        if isinstance(parts, str):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {bucketed} '{self.path}/part={parts}'")
            return name
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, part string) USING parquet PARTITIONED BY (part) {bucketed} '{self.path}'")
        places = " ".join(f"PARTITION (part = '{p}') LOCATION '{self.path}/part={p}'" for p in parts)
        self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {places}")
        return name

    def refresh(self, store: RunStore) -> list[int]:
        """Add the runs of the store that are not here; their arrival numbers."""
        here = {n for runs in self._parts().values() for n in runs.values()}
        latest = store.arrivals()
        new = {run: n for run, n in latest.items() if n not in here}
        if new:
            rows = store.read(T.StructType([f for f in self.schema.fields if f.name != ARRIVAL]), arrivals=set(new.values()))
            self._add(rows, new, [])
        return sorted(new.values())

    def rows(self, store: RunStore) -> DataFrame:
        """Rows that count in the store, of the runs that are here."""
        latest, parts = store.arrivals(), self._parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.table(self._table(sorted(parts)))
        for part, runs in sorted(parts.items()):
            gone = [n for run, n in runs.items() if latest.get(run) != n]
            if gone:
                rows = rows.where((F.col("part") != part) | ~F.col(ARRIVAL).isin(gone))
        return rows.drop("part")

    def fold(self, store: RunStore) -> None:
        """All parts in one, without the rows of replaced runs. Parts are bucketed alike, so no row is moved far."""
        parts, latest = self._parts(), store.arrivals()
        if len(parts) > 1:
            runs = {run: n for held in parts.values() for run, n in held.items() if latest.get(run) == n}
            self._add(self.rows(store), runs, sorted(parts))
            for part in parts:
                self._fs.delete(self._at(f"part={part}"), True)
