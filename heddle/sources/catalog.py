"""Tables as Parquet folders with a JSON description: create, describe, list, update, delete, read, write.

A name is a label; every created table has an id of its own, so a table made again under an
old name shares nothing with the former. Descriptions are small files read and written
through Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from heddle.operators.reads import Relation

NAME = re.compile(r"[A-Za-z0-9_.-]{3,255}")
LIST_MOST = 100


class CatalogError(ValueError):
    pass


@dataclass
class Table:
    name: str
    hash_key: str
    range_key: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)  # key attribute -> S, N, B
    indexes: dict[str, dict] = field(default_factory=dict)
    stream_view: str | None = None
    ttl: dict = field(default_factory=lambda: {"state": "DISABLED", "attribute": None, "generation": 0})
    protected: bool = False
    status: str = "ACTIVE"
    table_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def check(self) -> None:
        if not NAME.fullmatch(self.name):
            raise CatalogError(f"not a table name: {self.name}")
        keys = {k for k in [self.hash_key, self.range_key, *(x for i in self.indexes.values() for x in (i["hash_key"], i.get("range_key")))] if k}
        if set(self.attributes) != keys:
            raise CatalogError("attribute definitions and key schemas differ")
        if set(self.attributes.values()) - {"S", "N", "B"}:
            raise CatalogError("key attributes are S, N or B")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _save(self, table: Table) -> None:
        path, fs = self._path("catalog", f"{table.name}.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(asdict(table)).encode()))
        out.close()

    def create(self, table: Table) -> Table:
        table.check()
        path, fs = self._path("catalog", f"{table.name}.json")
        if fs.exists(path):
            raise CatalogError(f"{table.name} exists")
        self._save(table)
        return table

    def describe(self, name: str) -> Table:
        path, fs = self._path("catalog", f"{name}.json")
        if not fs.exists(path):
            raise CatalogError(f"{name} does not exist")
        rows = self.spark.read.text(path.toString(), wholetext=True).collect()
        return Table(**json.loads(rows[0][0]))

    def list(self, start: str | None = None, limit: int = LIST_MOST) -> tuple[list[str], str | None]:
        if not 1 <= limit <= LIST_MOST:
            raise CatalogError("a list has 1 to 100 names")
        path, fs = self._path("catalog")
        names = sorted(s.getPath().getName()[:-5] for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []
        names = [n for n in names if start is None or n > start]
        return names[:limit], names[limit - 1] if len(names) > limit else None

    def update(self, name: str, **changes) -> Table:
        table = self.describe(name)
        for key, value in changes.items():
            setattr(table, key, value)
        table.check()
        self._save(table)
        return table

    def delete(self, name: str) -> Table:
        table = self.describe(name)
        if table.protected:
            raise CatalogError(f"{name} is protected from deletion")
        for parts in (("catalog", f"{name}.json"), ("data", table.table_id)):
            path, fs = self._path(*parts)
            fs.delete(path, True)
        return table

    def _data(self, table: Table) -> str:
        return f"{self.root}/data/{table.table_id}"

    def write(self, name: str, items: DataFrame, mode: str = "overwrite", partitions: int | None = None) -> None:
        """Items sorted by key within files, so that key predicates skip row groups."""
        table = self.describe(name)
        keys = [k for k in (table.hash_key, table.range_key) if k]
        own = items.repartitionByRange(partitions, *keys) if partitions else items
        own.sortWithinPartitions(*keys).write.mode(mode).parquet(self._data(table))

    def read(self, name: str) -> Relation:
        table = self.describe(name)
        return Relation(self.spark.read.parquet(self._data(table)), table.hash_key, table.range_key)


def as_items(df: DataFrame, hash_key: str, range_key: str | None = None, **more) -> Relation:
    return Relation(df, hash_key, range_key, **more)
