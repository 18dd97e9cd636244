"""Versioned tables in one folder: keyed merges that rewrite only what they touch, and commits that
make several tables visible together.

A table lies in buckets by the hash of its key. A merge reads and writes only the buckets that its
batch has keys in, as new folders beside the old ones; nothing that is there is changed. A *version*
is a manifest: the folders of each bucket of each table. It becomes visible by one rename, so a
reader sees all tables of a commit or none, and whoever breaks off before leaves only folders that no
manifest names. Buckets are sorted by key: a look-up of a key opens one bucket, and skips the row
groups that cannot hold it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelgraph.sources.shared import delete, write

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another commit has taken the version."""


def _bucket(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class Store:
    """The tables below ``path``. One writer at a time is meant; a second one's commit fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self):
        return self._hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, in order."""
        fs, folder = self._fs(), self._hadoop.Path(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What ``version``, or else the last one, holds; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "notes": {}}
        lines = self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).collect()
        return json.loads(lines[0][0])

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version; None if it has none."""
        entry = self.manifest(version)["tables"].get(table)
        return _frame(self.spark, entry, entry["parts"]) if entry else None

    def lookup(self, table: str, **key) -> DataFrame | None:
        """The rows of one key (all columns that the table is bucketed by, others as wanted)."""
        entry = self.manifest()["tables"].get(table)
        if not entry:
            return None
        schema = T.StructType.fromJson(entry["schema"])
        values = {c: F.lit(v).cast(schema[c].dataType) for c, v in key.items()}
        one = self.spark.range(1).select(*(values[c].alias(c) for c in entry["by"]))
        at = str(one.select(_bucket(entry["by"], entry["buckets"])).first()[0])
        found = _frame(self.spark, entry, {at: entry["parts"].get(at, [])})
        for c, v in values.items():
            found = found.where(F.col(c) == v)
        return found

    def begin(self) -> Commit:
        return Commit(self)

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` versions names, and the older manifests."""
        fs, last = self._fs(), self.versions()[-keep:]
        named = {p.rpartition("/")[0] for v in last for e in self.manifest(v)["tables"].values() for ps in e["parts"].values() for p in ps}
        for v in self.versions():
            if v not in last:
                delete(self.spark, f"{self.path}/versions/{v:012d}")
        folder = self._hadoop.Path(f"{self.path}/data")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            if f"{self.path}/data/{f.getPath().getName()}" not in named:
                delete(self.spark, f"{self.path}/data/{f.getPath().getName()}")


def _frame(spark: SparkSession, entry: dict, parts: dict[str, list[str]]) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    paths = [p for k in sorted(parts, key=int) for p in parts[k]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class Commit:
    """Changes of several tables, staged until :meth:`commit`."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.state = store.manifest()
        self.rewritten: dict[str, list[int]] = {}

    def read(self, table: str) -> DataFrame | None:
        """A table with what is staged so far."""
        entry = self.state["tables"].get(table)
        return _frame(self.spark, entry, entry["parts"]) if entry else None

    def read_near(self, table: str, keys: DataFrame) -> DataFrame | None:
        """The rows of the buckets in which ``keys`` (the columns that the table is bucketed by) lie."""
        entry = self.state["tables"].get(table)
        if not entry:
            return None
        touched = self._touched(keys, entry)
        return _frame(self.spark, entry, {k: entry["parts"].get(k, []) for k in touched})

    def _touched(self, keys: DataFrame, entry: dict) -> list[str]:
        # at most as many rows as there are buckets
        return [str(r[0]) for r in keys.select(_bucket(entry["by"], entry["buckets"]).alias(_BUCKET)).distinct().collect()]

    def merge(self, table: str, batch: DataFrame, key: Sequence[str], *, once: Sequence[str] = (), always: Sequence[str] = (), add: Sequence[str] = (), whole: Sequence[str] = (), drop: Column | None = None, by: Sequence[str] | None = None, buckets: int = 16, at: Column | None = None) -> None:
        """Merge ``batch``, one row a key, into a table, which is made if need be.

        ``once`` columns keep their first value that is not null, ``always`` columns take the new
        one where it is not null, ``whole`` columns the new one even where it is null, ``add`` columns
        add up; rows for which ``drop`` is then true go.
        With ``at`` the table has created_at, which stays, and updated_at, which rows of the batch
        get. ``by`` (columns of the key, all of them by default) and ``buckets`` hold from the
        table's beginning.
        """
        entry = self.state["tables"].get(table)
        by = list(by or key) if not entry else entry["by"]
        buckets = entry["buckets"] if entry else buckets
        stamped = list(once) + (["created_at"] if at is not None else [])
        fresh_always = list(always) + (["updated_at"] if at is not None else [])
        new = batch.select(*key, *once, *always, *whole, *add)
        if at is not None:
            new = new.withColumns({"created_at": at, "updated_at": at})
        new = new.select(*key, *stamped, *fresh_always, *whole, *add)
        target = f"{self.store.path}/data/{table}-{uuid.uuid4().hex}"
        # the batch is read twice, and must be the same both times
        staged_at = f"{self.store.path}/data/batch-{uuid.uuid4().hex}"
        new = write(new, staged_at)
        shape = {"by": by, "buckets": buckets}
        touched = self._touched(new, shape)
        if entry:
            old = _frame(self.spark, entry, {k: entry["parts"].get(k, []) for k in touched})
            kept = {k: v for k, v in entry["parts"].items() if k not in touched}
            values = [*stamped, *fresh_always, *whole, *add]
            joined = old.join(new.select(*key, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_new")), list(key), "full_outer")
            merged = joined.select(
                *key,
                *(F.coalesce(c, f"_{c}").alias(c) for c in stamped),
                *(F.coalesce(f"_{c}", c).alias(c) for c in fresh_always),
                *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in whole),
                *((F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast(old.schema[c].dataType).alias(c) for c in add),
            )
            schema = old.schema
        else:
            merged, kept, schema = new, {}, new.schema
        if drop is not None:
            merged = merged.where(~F.coalesce(drop, F.lit(False)))
        placed = merged.withColumn(_BUCKET, _bucket(by, buckets)).repartition(max(1, len(touched)), _BUCKET).sortWithinPartitions(_BUCKET, *key)
        placed.write.partitionBy(_BUCKET).parquet(target)
        delete(self.spark, staged_at)
        fs = self.store._fs()
        there = {f.getPath().getName() for f in fs.listStatus(self.store._hadoop.Path(target))}
        parts = kept | {k: [f"{target}/{_BUCKET}={k}"] for k in touched if f"{_BUCKET}={k}" in there}
        names = [f.name for f in merged.schema.fields]
        plain = T.StructType([T.StructField(n, schema[n].dataType, True) for n in names])
        self.state["tables"][table] = {**shape, "key": list(key), "schema": plain.jsonValue(), "parts": parts}
        self.rewritten[table] = sorted({*self.rewritten.get(table, []), *map(int, touched)})

    def note(self, name: str, value) -> None:
        """Something to remember with the version, such as the last batch of a stream."""
        self.state["notes"][name] = value

    def commit(self) -> int:
        """Make all staged changes visible; the new version."""
        version = self.state["version"] + 1
        self.state["version"] = version
        fs, hadoop = self.store._fs(), self.store._hadoop
        target = hadoop.Path(f"{self.store.path}/versions/{version:012d}")
        fs.mkdirs(target.getParent())
        draft = hadoop.Path(f"{self.store.path}/versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"version {version} is there already")
        return version
