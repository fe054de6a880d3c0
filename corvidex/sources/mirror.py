"""Mirroring of several sources into read tables by cursors, committed as one.

A source is read behind a cursor of two parts, (mark, key): rows of one mark that arrive later, with a greater key, aren't
lost, and a row whose mark rises is read again. What is read is turned into rows of the read tables and merged by key. All
tables of a run are written as new versions; then one small manifest, which names the version of each table and the cursor
of each source, is written next to the ones before it. A reader takes the manifest of the highest number that is complete:
a run that dies before its manifest leaves the state as it was, and the next one begins from the cursors of that state.

On a store whose renames are not atomic the manifest is still safe: a number counts only with Spark's mark of a finished
write in its folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.sources.tables import latest


@dataclass(frozen=True)
class Source:
    """``rows`` with their cursor columns; ``derive``: the new rows as rows of read tables, by table name."""

    rows: DataFrame
    mark: str
    key: str
    derive: Callable[[DataFrame], Mapping[str, DataFrame]]


@dataclass(frozen=True)
class State:
    number: int = 0
    tables: Mapping[str, str] = field(default_factory=dict)
    cursors: Mapping[str, tuple] = field(default_factory=dict)


class Mirror:
    """Read tables below ``path``. ``keys``: the key columns of each; a table's rows carry their source's name in ``source``."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, list[str]]) -> None:
        self.spark, self.path, self.keys = spark, path, dict(keys)

    def _folders(self, below: str) -> list[str]:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        held = [x.getPath() for x in store.listStatus(place)]
        return [x.getName() for x in held if store.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]

    def state(self) -> State:
        """What the last complete run committed."""
        numbers = sorted(int(x) for x in self._folders("manifest"))
        if not numbers:
            return State()
        held = json.loads(self.spark.read.text(f"{self.path}/manifest/{numbers[-1]}", wholetext=True).first()[0])
        return State(numbers[-1], held["tables"], {k: tuple(v) for k, v in held["cursors"].items()})

    def table(self, name: str) -> DataFrame | None:
        """A read table as of the last complete run."""
        version = self.state().tables.get(name)
        return None if version is None else self.spark.read.parquet(version)

    def sync(self, sources: Mapping[str, Source], full: bool = False) -> State:
        """Read what is behind the cursors, merge it, commit. ``full``: the rows of these sources are dropped first and all
        are read again; what other sources wrote stays. A run without anything new commits nothing."""
        old = self.state()
        cursors, new = dict(old.cursors), {}
        for name, source in sources.items():
            fresh, cursor = self._behind(source, None if full else old.cursors.get(name))
            if cursor is None and not full:
                continue
            if cursor is None:
                cursors.pop(name, None)
            else:
                cursors[name] = cursor
            for table, rows in source.derive(fresh).items():
                new.setdefault(table, []).append(rows.withColumn("source", F.lit(name)))
        if not new:
            return old
        tables = dict(old.tables)
        for table, parts in new.items():
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.unionByName(part)
            keys = self.keys[table]
            merged = latest(merged, keys, [F.col("source")])
            if table in old.tables:
                held = self.spark.read.parquet(old.tables[table])
                if full:
                    held = held.where(~F.col("source").isin(*sources))
                merged = held.join(merged.select(*keys), keys, "left_anti").unionByName(merged)
            tables[table] = f"{self.path}/tables/{table}/{uuid.uuid4().hex}"
            merged.write.parquet(tables[table])
        return self._commit(State(old.number + 1, tables, cursors))

    def _behind(self, source: Source, cursor: tuple | None) -> tuple[DataFrame, tuple | None]:
        """The rows behind a cursor up to the greatest one there is now, and that one; (none, None) if there
        are none. Rows without a mark are never read: nothing says when they changed."""
        rows, at = source.rows.where(F.col(source.mark).isNotNull()), F.struct(F.col(source.mark).cast("string").alias("mark"), F.col(source.key).cast("string").alias("key"))
        mark, key = rows.schema[source.mark].dataType, rows.schema[source.key].dataType
        value = lambda x: F.struct(F.lit(x[0]).cast(mark), F.lit(x[1]).cast(key))
        here = F.struct(source.mark, source.key)
        if cursor is not None:
            rows = rows.where(here > value(cursor))
        top = rows.agg(F.max_by(at, here).alias("top")).first()["top"]
        if top is None:
            return rows.where("false"), None
        return rows.where(here <= value(tuple(top))), tuple(top)

    def _commit(self, state: State) -> State:
        held = json.dumps({"tables": state.tables, "cursors": state.cursors})
        self.spark.createDataFrame([(held,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{state.number}")
        return state
