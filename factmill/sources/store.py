"""Versioned tables on any file system that Spark can write: data in folders of their own, and a pointer that names them."""

from __future__ import annotations

import dataclasses
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many folders of one level of a log become one of the next.
FANOUT = 8
#: Folders of a table that is merged by key; a table keeps the number it was made with.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another commit has changed a table that this one replaces."""


@dataclasses.dataclass
class Merge:
    """Rows that replace those of their own keys and of the ``touched`` ones in a table that is kept in buckets by ``key``."""

    rows: DataFrame
    key: str
    touched: DataFrame


@dataclasses.dataclass(frozen=True)
class Part:
    path: str
    level: int = 0
    bucket: int | None = None


@dataclasses.dataclass(frozen=True)
class Table:
    parts: tuple[Part, ...] = ()
    key: str | None = None
    buckets: int | None = None

    @property
    def paths(self) -> list[str]:
        return [p.path for p in self.parts]


class Store:
    """Tables by name under ``root``; a table is one or several folders of Parquet files.

    A commit writes its data, then a pointer beside the others, and renames that to the next number, which fails if there
    is one: so a pointer is there whole or not at all, a writer that dies changes nothing, and of two commits at once the
    later one sees that it is. It then starts from the new state if the other left its tables alone, and fails
    otherwise; appends always go on. A pointer without its end, as other writers may leave it, is passed over, and its
    number is not used again. The rename must not overwrite: HDFS promises that, local file systems for one writer at a
    time, and object stores need a committer that does.

    Logs (``append``) are kept in levels: eight folders of a level become one, so n appends leave O(log n) folders, and
    each row is written O(log n) times. Tables that are merged by a key (``Merge``) are kept in buckets by its hash: a
    commit writes the buckets of the keys it touches and names the others as they are.

    With ``keep`` each commit drops all but the last ``keep`` versions; without, all stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._read: dict[str, dict[str, Table] | None] = {}  # pointers never change

    # --- pointers ---

    def _numbers(self) -> list[str]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(n for n in names if n.isdigit())

    def _pointer(self, name: str) -> dict[str, Table] | None:
        """The tables of a version, or None for a pointer that has no end."""
        if name not in self._read:
            stream = self._fs.open(self._path(f"{self.root}/_commits/{name}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._read[name] = _loads(text)
        return self._read[name]

    def _tables(self, version: str | None = None) -> dict[str, Table]:
        if version is not None:
            held = self._pointer(version)
            if held is None:
                raise ValueError(f"version {version} is not whole")
            return held
        for name in reversed(self._numbers()):
            held = self._pointer(name)
            if held is not None:
                return held
        return {}

    def _rename(self, source: str, target: str) -> bool:
        """Whether ``source`` is now ``target``; it is not if there was one."""
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        uri = self._path(self.root).toUri()
        context = jvm.org.apache.hadoop.fs.FileContext
        context = context.getFileContext(uri, self._conf) if uri.getScheme() else context.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._path(source), self._path(target), options)
        except Exception as error:
            if self._fs.exists(self._path(target)):
                return False
            raise error
        return True

    def _point(self, held: dict[str, Table]) -> str | None:
        """The version under which ``held`` stands now, or None if another commit took the number."""
        version = f"{int(max(self._numbers(), default='0')) + 1:08d}"
        aside = f"{self.root}/_commits/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(_dumps(held).encode()))
        finally:
            stream.close()
        if not self._rename(aside, f"{self.root}/_commits/{version}"):
            self._fs.delete(self._path(aside), False)
            return None
        return version

    # --- writing ---

    def commit(self, **tables: DataFrame | Merge) -> str:
        """Replace or merge the given tables; those not given stay as they are. Returns the version."""
        base = self._tables()
        made = {name: self._merged(name, base.get(name), x) if isinstance(x, Merge) else Table((Part(self._written(name, x)),)) for name, x in tables.items()}
        return self._stand(base, lambda now: made, set(made))

    def append(self, **tables: DataFrame) -> str:
        """Add rows to the given tables as folders of their own; now and then some are made into one."""
        parts = {name: Part(self._written(name, df)) for name, df in tables.items()}
        return self._stand(self._tables(), lambda now: {name: self._levelled(name, now.get(name, Table()), part) for name, part in parts.items()}, set())

    def drop(self, *names: str) -> None:
        """From the next version on there are no tables of these names; their data goes when older versions do."""
        if names and any(n in self._tables() for n in names):
            self._stand({}, lambda now: {name: None for name in names}, set())

    def _stand(self, base: dict[str, Table], change, replaced: set[str]) -> str:
        while True:
            now = self._tables()
            for name in replaced:
                if now.get(name) != base.get(name):
                    raise Conflict(name)
            version = self._point({name: t for name, t in (now | change(now)).items() if t is not None})
            if version is not None:
                if self.keep is not None:
                    self.vacuum(self.keep)
                return version

    def _written(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _levelled(self, name: str, held: Table, part: Part) -> Table:
        parts, taken, level = [*held.parts, part], [], 0
        while len(full := [p for p in parts if p.level == level]) + bool(taken) >= FANOUT:  # one that is made may fill the next level
            taken += full
            level += 1
        if taken:
            rows = self.spark.read.parquet(*(p.path for p in taken))
            one = Part(self._written(name, rows.coalesce(max(1, rows.rdd.getNumPartitions() // FANOUT))), level)
            parts = [one, *(p for p in parts if p not in taken)]
        return dataclasses.replace(held, parts=tuple(parts))

    def _merged(self, name: str, held: Table | None, merge: Merge) -> Table:
        held, rows = held or Table(), merge.rows
        keys = merge.touched.select(merge.key).union(rows.select(merge.key)).distinct()
        kept = lambda paths: self.spark.read.parquet(*paths).join(keys, merge.key, "left_anti").select(*rows.columns)
        if held.parts and held.key != merge.key:  # a table of another layout is laid out anew
            return self._bucketed(name, kept(held.paths).unionByName(rows), merge.key, BUCKETS)
        count = held.buckets or BUCKETS
        bucket = F.pmod(F.xxhash64(F.col(merge.key)), F.lit(count)).cast("int")
        asked = {r[0] for r in keys.select(bucket.alias("b")).distinct().collect()}  # at most ``count`` numbers
        if held.parts and not asked:
            return held
        mine = [p.path for p in held.parts if p.bucket in asked]
        if mine:
            rows = kept(mine).unionByName(rows)
        made = self._bucketed(name, rows, merge.key, count)
        return Table((*(p for p in held.parts if p.bucket not in asked), *made.parts), merge.key, count)

    def _bucketed(self, name: str, rows: DataFrame, key: str, count: int) -> Table:
        """``rows`` by bucket; a large bucket is written by several tasks. One without rows is an empty folder of bucket 0."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(count)).cast("int")
        rows.withColumn("__bucket", bucket).repartitionByRange("__bucket", key).write.option("compression", "zstd").partitionBy("__bucket").parquet(path)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory() and s.getPath().getName().startswith("__bucket=")]
        parts = [Part(f"{path}/{n}", 0, int(n.partition("=")[2])) for n in sorted(found)]
        if not parts:
            parts = [Part(self._written(name, rows), 0, 0)]
        return Table(tuple(parts), key, count)

    # --- reading ---

    def names(self) -> set[str]:
        return set(self._tables())

    def read(self, name: str, schema: str | None = None, version: str | None = None) -> DataFrame:
        """A table as of a version, by default the last; an empty one of ``schema`` if there is none yet."""
        held = self._tables(version).get(name)
        if held is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*held.paths)

    def versions(self) -> list[str]:
        return [n for n in self._numbers() if self._pointer(n) is not None]

    # --- cleaning ---

    def vacuum(self, keep: int = 1) -> None:
        """Drop all but the last ``keep`` versions and the data that only they name."""
        names = self.versions()
        if len(names) <= keep:
            return
        live = {p for n in names[-keep:] for t in self._tables(n).values() for p in t.paths}
        for name in names[:-keep]:
            gone = {p for t in self._tables(name).values() for p in t.paths} - live
            self._fs.delete(self._path(f"{self.root}/_commits/{name}"), False)  # first: what is named is there
            for path in gone:
                self._fs.delete(self._path(path), True)

    def sweep(self, hours: float = 24) -> int:
        """Drop data that no version names, as writers leave that died, if older than ``hours``; how many folders went."""
        live = {p for n in self.versions() for t in self._tables(n).values() for p in t.paths}
        before, n = (time.time() - 3600 * hours) * 1000, 0
        for table in self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []:
            for folder in self._fs.listStatus(table.getPath()):
                path = f"{self.root}/{table.getPath().getName()}/{folder.getPath().getName()}"
                named = path in live or any(p.startswith(path + "/") for p in live)
                pointer = table.getPath().getName() == "_commits" and not folder.getPath().getName().startswith(".")
                if not named and not pointer and folder.getModificationTime() <= before:
                    n += bool(self._fs.delete(folder.getPath(), True))
        return n


def _dumps(held: dict[str, Table]) -> str:
    tables = {name: {"key": t.key, "buckets": t.buckets, "parts": [[p.path, p.level, p.bucket] for p in t.parts]} for name, t in sorted(held.items())}
    return json.dumps({"tables": tables, "end": len(tables)})


def _loads(text: str) -> dict[str, Table] | None:
    try:
        found = json.loads(text)
        if found["end"] != len(found["tables"]):
            return None
    except (ValueError, KeyError, TypeError):
        return None
    return {name: Table(tuple(Part(*p) for p in t["parts"]), t["key"], t["buckets"]) for name, t in found["tables"].items()}
