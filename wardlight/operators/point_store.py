"""A versioned store of keyed rows in hash-bucketed delta files, merged on time.

Under its root a store has

* ``data/<run>/bucket=<b>/``  the rows of one merge or compaction; never changed once written;
* ``commits/<version>.json``  one manifest per version: per bucket the runs that hold its rows, oldest
  first, the runs of quarantined rows, and the last epoch of every stream that wrote.

A merge writes its rows as a delta of the buckets they fall in. Readers take the newest row per id of
a bucket that has several runs; the order in which versions of a row arrive is of no account. A bucket
with more than ``max_deltas`` runs is rewritten as one by the merge that finds it so; all other buckets
keep their files.

A manifest is published by creating a file that must not exist yet: a hard link on a local file system,
a rename without overwriting elsewhere. So of two writers one gets the version; the other builds its
manifest anew on the one that won, with the delta it has already written. What a failed writer left
behind is in no manifest. Rows, quarantine and stream epoch change in one step.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
MAX_DELTAS = 8
_MANIFEST = re.compile(r"(\d{10})\.json")


class _Files:
    """The few file operations a store needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Create ``name`` with ``text`` in one step; False if it exists."""
        waiting = f"{name.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
        out = self.fs.create(self.path(waiting))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(self.path(waiting).toUri().getPath(), self.path(name).toUri().getPath())
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
                kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 0)
                context.rename(self.path(waiting), self.path(name), options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(self.path(waiting), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Manifests:
    """The published manifests of one root, and optimistic commits on them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(m.group(1)) for m in map(_MANIFEST.fullmatch, self.files.names("commits")) if m)

    def at(self, version: int) -> dict:
        return json.loads(self.files.text(f"commits/{version:010d}.json"))

    def current(self) -> dict | None:
        found = self.versions()
        return self.at(found[-1]) if found else None

    def commit(self, change: Callable[[dict | None], dict | None]) -> int:
        """Publish what ``change`` makes of the current manifest, again on a newer one when another
        writer was first; ``change`` gives None when there is nothing left to do."""
        while True:
            now = self.current()
            new = change(now)
            if new is None:
                return now["version"]
            version = 0 if now is None else now["version"] + 1
            if self.files.publish(f"commits/{version:010d}.json", json.dumps({**new, "version": version})):
                return version


def _schema(manifest: dict, name: str = "schema") -> T.StructType:
    return T.StructType.fromJson(manifest[name])


def _wider(one: T.StructType | None, two: T.StructType) -> T.StructType:
    """The fields of both, those of ``one`` first."""
    if one is None:
        return two
    return T.StructType(one.fields + [f for f in two.fields if f.name not in one.fieldNames()])


class PointStore:
    """``newest`` leaves one row per id; with rows of several runs it must choose alike in any order."""

    def __init__(self, spark: SparkSession, root: str, newest: Callable[[DataFrame], DataFrame], id_col: str = "id",
                 buckets: int = BUCKETS, max_deltas: int = MAX_DELTAS):
        self.spark, self.root, self.newest, self.id_col = spark, root.rstrip("/"), newest, id_col
        self.buckets, self.max_deltas = buckets, max_deltas
        self.manifests = Manifests(spark, root)

    def exists(self) -> bool:
        return bool(self.manifests.versions())

    # ---- reading --------------------------------------------------------------------------
    def _rows(self, entries: dict[str, list[str]], schema: T.StructType) -> DataFrame:
        """All rows of the given runs of the given buckets, with their bucket."""
        of_run: dict[str, list[int]] = {}
        for bucket, runs in entries.items():
            for run in runs:
                of_run.setdefault(run, []).append(int(bucket))
        with_bucket = T.StructType(schema.fields + [T.StructField("bucket", T.IntegerType())])
        out = self.spark.createDataFrame([], with_bucket)
        for run, own in of_run.items():
            out = out.unionByName(self.spark.read.schema(with_bucket).parquet(f"{self.root}/data/{run}").where(F.col("bucket").isin(own)))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The newest row of every id. Buckets of one run are scanned as they are."""
        now = self.manifests.current() if version is None else self.manifests.at(version)
        if now is None:
            raise ValueError(f"nothing was stored under {self.root}")
        schema = _schema(now)
        single = {b: runs for b, runs in now["entries"].items() if len(runs) == 1}
        several = {b: runs for b, runs in now["entries"].items() if len(runs) > 1}
        out = self._rows(single, schema).drop("bucket")
        return out.unionByName(self.newest(self._rows(several, schema).drop("bucket"))) if several else out

    def quarantine(self) -> tuple[list[str], DataFrame | None]:
        """The runs that hold quarantined rows, and those rows."""
        now = self.manifests.current()
        runs = (now or {}).get("quarantine", [])
        if not runs:
            return [], None
        return runs, self.spark.read.schema(_schema(now, "failed_schema")).parquet(*[f"{self.root}/data/{r}" for r in runs])

    # ---- writing --------------------------------------------------------------------------
    def _write(self, rows: DataFrame, hashed: str, buckets: int, unique: bool = False) -> tuple[str, list[str]]:
        """The newest of ``rows`` as a new run: its name and the buckets it has files of. ``newest`` groups by
        id, which leaves a task the ids of a few buckets, so they are written without another exchange;
        ``unique`` rows are written from where they are."""
        run, by = uuid.uuid4().hex, F.hash(self.id_col) if hashed == "hash" else F.xxhash64(self.id_col)
        newest = (rows if unique else self.newest(rows)).withColumn("bucket", F.pmod(by, F.lit(buckets)).cast("int"))
        if hashed != "hash":                         # a store made when buckets went by another hash
            newest = newest.repartition("bucket")
        newest.write.partitionBy("bucket").parquet(f"{self.root}/data/{run}")
        return run, [n.split("=", 1)[1] for n in self.manifests.files.names(f"data/{run}") if n.startswith("bucket=")]

    def merge(self, rows: DataFrame, failed: DataFrame | None = None, retried: list[str] | None = None,
              stream: tuple[str, int] | None = None, unique: bool = False) -> int:
        """Add versions of rows; returns the store's version. ``failed`` is quarantined in place of the
        runs ``retried``. A stream's epoch (``stream``) that was merged before changes nothing. ``unique``:
        the caller knows that no id repeats in ``rows``."""
        now = self.manifests.current()
        if stream and now and now["streams"].get(stream[0], -1) >= stream[1]:
            return now["version"]
        buckets = now["buckets"] if now else self.buckets
        hashed = now.get("hashed", "xxhash64") if now else "hash"
        run, touched = self._write(rows, hashed, buckets, unique)
        bad, bad_schema = None, None
        if failed is not None:
            bad = uuid.uuid4().hex
            failed.write.parquet(f"{self.root}/data/{bad}")
            bad_schema = failed.schema
            if self.spark.read.schema(bad_schema).parquet(f"{self.root}/data/{bad}").isEmpty():
                bad = None

        def change(now: dict | None) -> dict | None:
            now = now or {"buckets": buckets, "hashed": hashed, "schema": None, "entries": {}, "quarantine": [], "failed_schema": None, "streams": {}}
            if stream and now["streams"].get(stream[0], -1) >= stream[1]:
                return None
            if now["buckets"] != buckets or now.get("hashed", "xxhash64") != hashed:      # made by another writer meanwhile
                raise ValueError(f"{self.root} has {now['buckets']} buckets, not {buckets}, or goes by another hash")
            schema = _wider(_schema(now) if now["schema"] else None, rows.schema)
            entries = {b: list(runs) for b, runs in now["entries"].items()}
            for b in touched:
                entries.setdefault(b, []).append(run)
            full = {b: entries[b] for b in touched if len(entries[b]) > self.max_deltas}
            if full:
                whole = self._rows(full, schema)
                compacted, _ = self._write(whole.drop("bucket"), hashed, buckets)
                entries.update({b: [compacted] for b in full})
            waiting = [r for r in now["quarantine"] if r not in (retried or [])] + ([bad] if bad else [])
            last = {**now["streams"], **({stream[0]: stream[1]} if stream else {})}
            kept = _schema(now, "failed_schema") if now["failed_schema"] else None
            kept = _wider(kept, bad_schema) if bad_schema is not None else kept
            return {"buckets": buckets, "hashed": hashed, "schema": schema.jsonValue(), "entries": entries, "quarantine": waiting,
                    "failed_schema": kept.jsonValue() if kept else None, "streams": last}

        return self.manifests.commit(change)

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the last ``keep`` versions and delete the runs only they use; returns how
        many. Nobody may read those versions any more."""
        versions = self.manifests.versions()

        def runs(version: int) -> set[str]:
            m = self.manifests.at(version)
            return {r for own in m["entries"].values() for r in own} | set(m["quarantine"])

        used = set().union(*map(runs, versions[-keep:])) if versions else set()
        gone = set().union(*map(runs, versions[:-keep])) - used if versions[:-keep] else set()
        for version in versions[:-keep]:
            self.manifests.files.delete(f"commits/{version:010d}.json")
        for run in gone:
            self.manifests.files.delete(f"data/{run}")
        return len(gone)


class SmallTable:
    """A small table (state, counters) replaced as a whole, each time by what ``change`` makes of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root)

    def read(self) -> DataFrame | None:
        now = self.manifests.current()
        return None if now is None else self._of(now)

    def _of(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(_schema(manifest)).parquet(f"{self.root}/data/{manifest['run']}")

    def update(self, change: Callable[[DataFrame | None], DataFrame]) -> int:
        def written(now: dict | None) -> dict:
            rows, run = change(None if now is None else self._of(now)), uuid.uuid4().hex
            rows.write.parquet(f"{self.root}/data/{run}")
            return {"run": run, "schema": rows.schema.jsonValue()}

        return self.manifests.commit(written)
