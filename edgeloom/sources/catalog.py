"""The catalog of a scope: one JSON file beside its tables, in any file system that Spark reaches."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .. import errors, types


@dataclass
class Property:
    name: str
    kind: str
    pk: bool = False
    inc: bool = False
    stamp: bool = False
    origin: str | None = None
    destin: str | None = None


@dataclass
class Table:
    name: str
    edge: bool
    properties: list[Property]
    storage: str | None = None

    @property
    def pk(self) -> Property | None:
        return next((p for p in self.properties if p.pk), None)

    @property
    def stamp(self) -> Property | None:
        return next((p for p in self.properties if p.stamp), None)

    def find(self, name: str) -> Property:
        for p in self.properties:
            if p.name == name:
                return p
        raise errors.KeyNotFoundError(f"no field {name} in {self.name}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, types.STORED[p.kind], True, {"kind": p.kind, "pk": p.pk, "inc": p.inc, "stamp": p.stamp}) for p in self.properties])


@dataclass
class Catalog:
    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    storages: dict[str, dict] = field(default_factory=dict)
    procedures: dict[str, dict] = field(default_factory=dict)
    locks: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        raw = json.loads(text)
        raw["tables"] = {n: Table(t["name"], t["edge"], [Property(**p) for p in t["properties"]], t["storage"]) for n, t in raw["tables"].items()}
        return cls(**raw)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise errors.NoSuchTableError(name)
        return self.tables[name]

    def define(self, name: str, edge: bool, fields: list[dict], storage: str | None) -> Table:
        """Checks a type's or edge's declaration and adds it."""
        if name in self.tables:
            raise errors.DuplicateKeyError(name)
        if storage is not None and storage not in self.storages:
            raise errors.KeyNotFoundError(f"no storage {storage}")
        props: list[Property] = []
        for f in fields:
            if any(p.name == f["name"] for p in props):
                raise errors.DuplicateKeyError(f["name"])
            end = "origin" if f.get("origin") else "destin" if f.get("destin") else None
            if end:
                if not edge:
                    raise errors.InvalidError(f"{end} in a type")
                to = self.table(f["type"])
                if to.edge:
                    raise errors.InvalidError(f"{to.name} is an edge")
                props.append(Property(f["name"], to.pk.kind, **{end: to.name}))
                continue
            if f["type"].lower() not in types.KINDS:
                raise errors.InvalidError(f"no type {f['type']}")
            p = Property(f["name"], types.KINDS[f["type"].lower()], bool(f.get("pk")), bool(f.get("inc")), bool(f.get("stamp")))
            if p.stamp and p.kind != "time" or p.pk and p.kind not in ("uint", "text", "int") or p.inc and (not p.pk or p.kind == "text"):
                raise errors.InvalidError(f"{p.kind} can't be {'a stamp' if p.stamp else 'a primary key'}")
            props.append(p)
        count = lambda test: sum(bool(test(p)) for p in props)
        if count(lambda p: p.stamp) > 1:
            raise errors.InvalidError(f"two stamps in {name}")
        if edge:
            for end in ("origin", "destin"):
                if (n := count(lambda p, end=end: getattr(p, end))) != 1:
                    raise errors.InvalidError(f"{'no' if not n else 'more than one'} {end} in edge")
            if count(lambda p: p.pk):
                raise errors.InvalidError("an edge has no primary key")
        elif (n := count(lambda p: p.pk)) != 1:
            raise errors.InvalidError("no PK in type" if not n else "more than one PK in type")
        self.tables[name] = Table(name, edge, props, storage)
        return self.tables[name]


class Files:
    """Small files and folders through Hadoop's file system, so that paths may be anywhere."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written aside, then renamed: readers see the old file or the new one."""
        aside = self._path(f"{path}.new")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self._path(path), False)
        self.fs.rename(aside, self._path(path))

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def rename(self, a: str, b: str) -> None:
        self.fs.rename(self._path(a), self._path(b))

    def move_files(self, source: str, target: str) -> None:
        """Moves data files with their folders' names; their own names are unique."""
        for s in self.fs.listStatus(self._path(source)):
            name = s.getPath().getName()
            if s.isDirectory():
                self.move_files(f"{source}/{name}", f"{target}/{name}")
            elif not name.startswith(("_", ".")):
                self.fs.mkdirs(self._path(target))
                self.rename(f"{source}/{name}", f"{target}/{name}")

    def folders(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path)) if s.isDirectory()) if self.exists(path) else []
