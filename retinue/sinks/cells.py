"""Keyed tables that are written cell by cell.

:func:`upsert_cells` is the rule on two frames. :class:`CellTable` keeps such a
table on plain Parquet, in parts: one folder per write and group of columns, so
that adding histograms never rewrites image bytes and a small write costs its
own size. Every part is cut into the same buckets by key and sorted by it, with
a bloom filter on the key. So a read merges parts and groups bucket by bucket
where they lie, and a lookup reads the row groups of one bucket that may hold
the key. What a table consists of is said by manifests, small files with one
number each: a write counts, in all its groups at once, when its manifest is there.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.session import bucket_count, file_system, materialise
from retinue.sources.tables import get_row

#: Updates up to this size (as JSON text) are sent to the base table.
BROADCAST_BYTES = 16 * 1024 * 1024


def latest_cells(updates: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key with the last non-null value of every cell by ``order``.

    Partially aggregated, so a key with very many writes does not gather them.
    """
    return updates.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    )


def upsert_cells(
    base: DataFrame, updates: DataFrame, key: str = "image_name", order: str | None = None
) -> DataFrame:
    """``base`` with only the supplied (non-null) cells of ``updates`` overwritten.

    Rows of ``updates`` without any cell are not written. ``order`` decides
    between several updates of one cell; without it keys must be unique.
    """
    cols = [c for c in updates.columns if c not in (key, order)]
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    new = updates.where(some)
    new = latest_cells(new, key, order, cols) if order else new
    new = new.select(key, *[F.col(c).alias(f"new_{c}") for c in cols])
    kept = [
        F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
        for c in base.columns
        if c != key
    ]
    added = [F.col(f"new_{c}").alias(c) for c in cols if c not in base.columns]
    size = new.agg(F.sum(F.length(F.to_json(F.struct(*new.columns))))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return base.join(new, key, "full_outer").select(key, *kept, *added)
    # Few updates travel to the base, which is not shuffled. A second, key-only
    # look at the base finds the rows that are new.
    small = F.broadcast(new)
    known = base.select(key).join(F.broadcast(new.select(key)), key, "left_semi")
    fresh = new.join(known, key, "left_anti")
    absent = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns if c != key]
    return (
        base.join(small, key, "left").select(key, *kept, *added)
        .unionByName(fresh.select("*", *absent).select(key, *kept, *added))
    )


@dataclass(frozen=True)
class Part:
    """One written folder of a group. ``put`` is the number of its write, or the highest one that a base holds."""

    group: str
    folder: str
    put: int
    base: bool

    @property
    def order(self) -> int:
        """A base comes just before a write of the same number, after all lower ones."""
        return 2 * self.put + (not self.base)


@dataclass(frozen=True)
class Manifest:
    """A committed state: its number, the parts that count, and folders that counted until lately."""

    version: int
    parts: tuple[Part, ...]
    retired: tuple[str, ...] = ()

    def text(self) -> str:
        parts = [[p.group, p.folder, p.put, p.base] for p in self.parts]
        return json.dumps({"parts": parts, "retired": list(self.retired)})


class ConcurrentChange(RuntimeError):
    """What a compaction has folded was changed by another writer meanwhile; nothing was written."""


class CellTable:
    """Keyed table with named groups of cells below one folder.

    ``groups`` maps a group name to the DDL of its columns, for instance
    ``{"content": "path string, content binary", "histogram": "histogram array<int>"}``.
    They are stored beside the data with the key and the number of buckets: the
    constructor makes a table that is not there yet and refuses one of other
    groups, :meth:`open` takes what is stored.
    """

    DESCRIPTOR, COMMITS, DATA = "_table.json", "_commits", "data"
    #: Manifests behind the last one that stay, and catalog entries of old states that a session keeps.
    KEPT = 32

    def __init__(self, spark: SparkSession, root: str, groups: dict[str, str], key: str = "image_name", buckets: int | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schemas = {name: T.StructType.fromDDL(ddl) for name, ddl in groups.items()}
        self.columns = [c for schema in self.schemas.values() for c in schema.names]
        stored = self._text(self.DESCRIPTOR)
        if stored is None:
            self.buckets = buckets or bucket_count(spark)
            if self._create(self.DESCRIPTOR, json.dumps(self._description())):
                return
            stored = self._text(self.DESCRIPTOR)
        found = json.loads(stored)
        self.buckets = found["buckets"]
        if found != self._description() or (buckets or self.buckets) != self.buckets:
            raise ValueError(f"{self.root} holds a table of another shape: {found}")

    def _description(self) -> dict:
        groups = {name: [[f.name, f.dataType.simpleString()] for f in schema] for name, schema in self.schemas.items()}
        return {"key": self.key, "buckets": self.buckets, "groups": groups}

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> CellTable:
        """The table stored below ``root``, with its own groups."""
        found = _read_text(spark, f"{root.rstrip('/')}/{cls.DESCRIPTOR}")
        if found is None:
            raise FileNotFoundError(f"no table below {root}")
        shape = json.loads(found)
        groups = {name: ", ".join(f"`{c}` {kind}" for c, kind in cols) for name, cols in shape["groups"].items()}
        return cls(spark, root, groups, shape["key"])

    @classmethod
    def exists(cls, spark: SparkSession, root: str) -> bool:
        return _read_text(spark, f"{root.rstrip('/')}/{cls.DESCRIPTOR}") is not None

    @classmethod
    def drop(cls, spark: SparkSession, root: str) -> None:
        """Delete the table below ``root``, if there is one. Other files below it stay."""
        if cls.exists(spark, root):
            table = cls.open(spark, root)
            for name in table._entries():
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            for name in (cls.DESCRIPTOR, cls.COMMITS, cls.DATA):
                table._delete(name)

    # Files of the table, through the file system of its folder.

    def _names(self, folder: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.root}/{folder}")
        return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, folder: str) -> None:
        fs, path = file_system(self.spark, f"{self.root}/{folder}")
        fs.delete(path, True)

    def _text(self, name: str) -> str | None:
        return _read_text(self.spark, f"{self.root}/{name}")

    def _create(self, name: str, text: str) -> bool:
        return _create_text(self.spark, f"{self.root}/{name}", text)

    # States.

    def manifest(self) -> Manifest:
        """The latest committed state."""
        versions = sorted((int(name[:-5]) for name in self._names(self.COMMITS) if name.endswith(".json")), reverse=True)
        if not versions:
            return Manifest(0, ())
        found = json.loads(self._text(f"{self.COMMITS}/{versions[0]}.json"))
        return Manifest(versions[0], tuple(Part(*p) for p in found["parts"]), tuple(found["retired"]))

    def _commit(self, change) -> Manifest:
        """Make ``change(latest)`` the next state. If another writer was faster, it is applied to theirs."""
        while True:
            latest = self.manifest()
            wanted = change(latest)
            if wanted is None:
                return latest
            parts, retired = wanted
            state = Manifest(latest.version + 1, tuple(parts), tuple(retired))
            if self._create(f"{self.COMMITS}/{state.version}.json", state.text()):
                return state

    def put(self, updates: DataFrame, order: str | None = None, put_id: int | None = None) -> int:
        """Write the non-null cells of ``updates``; readers see those of all groups or none.

        Keys within one write are unique, unless ``order`` names the column that
        decides between several values of a cell. A repeated write of the same
        rows changes nothing, with the same ``put_id`` (it is replaced) or with a
        new one. ``updates`` is computed once; its rows move once, to their
        buckets. A ``put_id`` below one that is folded already yields to the
        folded cells and fills those that are missing there.
        """
        put_id = time.time_ns() if put_id is None else put_id
        groups = {g: [c for c in schema.names if c in updates.columns] for g, schema in self.schemas.items()}
        groups = {g: cols for g, cols in groups.items() if cols}
        if len(groups) > 1:
            updates = materialise(updates, "cells")
        parts = []
        for group, cols in groups.items():
            some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
            cells = updates.where(some)
            cells = latest_cells(cells, self.key, order, cols) if order else cells
            typed = [
                (F.col(f.name) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.schemas[group]
            ]
            parts.append(self._write(cells.select(self.key, *typed), group, put_id, base=False))

        def add(latest: Manifest):
            replaced = [p for p in latest.parts if not p.base and p.put == put_id]
            return [*(p for p in latest.parts if p not in replaced), *parts], [*latest.retired, *(p.folder for p in replaced)]

        if parts:
            self._commit(add)
        return put_id

    def _write(self, cells: DataFrame, group: str, put: int, base: bool, moved: bool = False) -> Part:
        """Write one part, bucketed and sorted by key; ``moved`` if the rows lie in their buckets already."""
        key = F.col(self.key).cast("string").alias(self.key)
        rows = cells.withColumn(self.key, key)
        if not moved:
            rows = rows.repartition(self.buckets, self.key)
        folder = f"{self.DATA}/{group}/{'base' if base else 'put'}-{put}-{uuid.uuid4().hex}"
        name = "cells_" + uuid.uuid4().hex
        writer = rows.sortWithinPartitions(self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet")
        writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("path", f"{self.root}/{folder}")
        writer.saveAsTable(name)
        # The files stay; reads name them by the manifest.
        self.spark.sql(f"DROP TABLE {name}")
        return Part(group, folder, put, base)

    def _entries(self, group: str | None = None) -> list[str]:
        """Catalog entries of this table's states in this session, oldest first."""
        prefixes = [self._entry_prefix(g) for g in ([group] if group else self.schemas)]
        found = [t.name for t in self.spark.catalog.listTables(pattern="cells_*") if t.name.startswith(tuple(prefixes))]
        return sorted(found, key=lambda name: int(name.split("_")[2]))

    def _entry_prefix(self, group: str) -> str:
        return f"cells_{hashlib.sha256(f'{self.root}/{group}'.encode()).hexdigest()[:24]}_"

    def _stored(self, group: str, state: tuple[Part, ...]) -> DataFrame | None:
        """Rows of some parts of a group, with the ``_order`` of their part, as one bucketed scan."""
        parts = [p for p in state if p.group == group]
        if not parts:
            return None
        # Equal parts have one catalog entry; the number in front tells its age.
        listed = hashlib.sha256(" ".join(sorted(p.folder for p in parts)).encode()).hexdigest()[:16]
        entries = self._entries(group)
        name = next((entry for entry in entries if entry.endswith(listed)), None)
        if name is None:
            age = int(entries[-1].split("_")[2]) + 1 if entries else 0
            name = f"{self._entry_prefix(group)}{age}_{listed}"
            for old in entries[: -self.KEPT]:
                self.spark.sql(f"DROP TABLE IF EXISTS {old}")
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schemas[group])
            layout = f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS"
            self.spark.sql(
                f"CREATE TABLE {name} (`{self.key}` string, {cols}, _order long) USING parquet"
                f" PARTITIONED BY (_order) {layout} LOCATION '{self.root}/{self.DATA}/{group}'"
            )
            places = " ".join(f"PARTITION (_order = {p.order}) LOCATION '{self.root}/{p.folder}'" for p in parts)
            self.spark.sql(f"ALTER TABLE {name} ADD {places}")
        return self.spark.table(name)

    def _group(self, group: str, cols: list[str], state: tuple[Part, ...]) -> DataFrame:
        rows = self._stored(group, state)
        if rows is None:
            fields = [T.StructField(self.key, T.StringType()), *(self.schemas[group][c] for c in cols)]
            return self.spark.createDataFrame([], T.StructType(fields))
        if sum(p.group == group for p in state) == 1:
            return rows.select(self.key, *cols)
        return latest_cells(rows, self.key, "_order", cols)

    def scan(self, cols: list[str] | None = None, parts_of: tuple[Part, ...] | None = None) -> DataFrame:
        """Key and cells of one state (the latest, or the parts given); reads only the groups and columns asked for.

        Groups meet bucket by bucket: none of their cells is moved. Of three or
        more groups the keys alone are gathered first.
        """
        cols = list(cols or self.columns)
        state = self.manifest().parts if parts_of is None else parts_of
        parts = []
        for group, schema in self.schemas.items():
            wanted = [c for c in schema.names if c in cols]
            if wanted:
                parts.append(self._group(group, wanted, state))
        if len(parts) > 2:
            keys = reduce(DataFrame.union, [part.select(self.key) for part in parts]).distinct()
            joined = reduce(lambda a, b: a.join(b, self.key, "left"), parts, keys.repartition(self.buckets, self.key))
        else:
            joined = reduce(lambda a, b: a.join(b, self.key, "full_outer"), parts)
        some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
        return joined.select(self.key, *cols).where(some)

    def get(self, value: str, cols: list[str] | None = None) -> DataFrame:
        """The row of one key. Of each part only the bucket of the key is opened, and only row groups that may hold it are read."""
        cols = list(cols or self.columns)
        state = self.manifest().parts
        parts = []
        for group, schema in self.schemas.items():
            wanted = [c for c in schema.names if c in cols]
            rows = self._stored(group, state) if wanted else None
            if rows is not None:
                found = get_row(rows, value, self.key)
                parts.append(latest_cells(found, self.key, "_order", wanted))
        if not parts:
            return self.scan(cols, state)
        # One row each at most.
        joined = reduce(lambda a, b: a.join(F.broadcast(b), self.key, "full_outer"), parts)
        absent = [F.lit(None).cast(self._type(c)).alias(c) for c in cols if c not in joined.columns]
        return joined.select("*", *absent).select(self.key, *cols)

    def _type(self, column: str) -> T.DataType:
        return next(schema[column].dataType for schema in self.schemas.values() if column in schema.names)

    def compact(self) -> None:
        """Fold the parts of every group into a new base. Reads give the same before, between and after.

        The bases count when their manifest is there. If another writer changed
        the folded parts meanwhile, :class:`ConcurrentChange` is raised and the
        table stays as it is; writes that were only added are kept. Folders
        that a state before the last one no longer used are deleted then, so
        readers of the state just replaced can finish.
        """
        state = self.manifest()
        folded: list[Part] = []
        bases: list[Part] = []
        for group, schema in self.schemas.items():
            parts = [p for p in state.parts if p.group == group]
            if len(parts) < 2:
                continue
            merged = self._group(group, schema.names, state.parts)
            bases.append(self._write(merged, group, max(p.put for p in parts), base=True, moved=True))
            folded += parts
        if not bases:
            return

        def replace(latest: Manifest):
            if any(p not in latest.parts for p in folded):
                for base in bases:
                    self._delete(base.folder)
                raise ConcurrentChange(f"parts of {self.root} were changed while they were folded")
            return [*bases, *(p for p in latest.parts if p not in folded)], [p.folder for p in folded]

        done = self._commit(replace)
        for folder in state.retired:
            self._delete(folder)
        for name in self._names(self.COMMITS):
            if name.endswith(".json") and int(name[:-5]) < done.version - self.KEPT:
                self._delete(f"{self.COMMITS}/{name}")

    def remove_unused(self, older_than_seconds: float = 86_400.0) -> int:
        """Delete parts of failed writes: folders that no kept manifest names and that are older than this."""
        named: set[str] = set()
        for name in self._names(self.COMMITS):
            if name.endswith(".json"):
                found = json.loads(self._text(f"{self.COMMITS}/{name}"))
                named |= {p[1] for p in found["parts"]} | set(found["retired"])
        removed = 0
        for group in self.schemas:
            for name in self._names(f"{self.DATA}/{group}"):
                folder = f"{self.DATA}/{group}/{name}"
                fs, path = file_system(self.spark, f"{self.root}/{folder}")
                age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
                if folder not in named and age >= older_than_seconds:
                    self._delete(folder)
                    removed += 1
        return removed


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, place = file_system(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remembered(spark: SparkSession, path: str, text: str) -> str:
    """The text stored under ``path``; ``text`` if there was none, which is stored then."""
    _create_text(spark, path, text)
    return _read_text(spark, path)


def _create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a whole file appear under ``path`` at once; False if there is one already."""
    fs, place = file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(place.getParent(), f".draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(place), options)
        return True
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
