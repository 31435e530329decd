"""Reads: points, batches, ranges, scans, pages.

A Relation is a DataFrame of items with a key. Reads are lazy; only pages, which a caller
continues from, collect their bounded rows.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import values
from heddle.plans import expressions as E
from heddle.plans.columns import Compiler, _path_tree, key_predicate, project_columns, tag_of

QUERY_LIMIT, QUERY_MOST, SCAN_LIMIT, SCAN_MOST = 100, 10_000, 100, 1_000
PAGE_BYTES, UNIT_BYTES, BATCH_KEYS, TRANSACTION_KEYS = 1 << 20, 4096, 100, 100
SELECTS = ("ALL_ATTRIBUTES", "ALL_PROJECTED_ATTRIBUTES", "COUNT", "SPECIFIC_ATTRIBUTES")


class ReadError(ValueError):
    pass


@dataclass(frozen=True)
class Relation:
    items: DataFrame
    hash_key: str
    range_key: str | None = None
    #: further columns that make an index entry's order total: the base table's keys
    base_key: tuple[str, ...] = ()
    sets: dict[str, str] = field(default_factory=dict)
    projected: tuple[str, ...] | None = None
    ready: bool = True

    @property
    def key(self) -> list[str]:
        own = [self.hash_key, *([self.range_key] if self.range_key else [])]
        return own + [k for k in self.base_key if k not in own]

    def with_items(self, items: DataFrame) -> Relation:
        return replace(self, items=items)


def normalised_limit(limit: int | None, default: int, most: int) -> int:
    if limit is None:
        return default
    if limit < 1:
        raise ReadError("Limit must be at least 1")
    return min(limit, most)


def capacity_units(size: Column, consistent: bool) -> Column:
    units = F.greatest(F.lit(1), F.ceil(size / UNIT_BYTES))
    return units * (1.0 if consistent else 0.5)


def estimated_size(df: DataFrame) -> Column:
    """Bytes of an item from its typed columns: names plus text, number or binary lengths."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        column, tag = F.col(f"`{f.name}`"), tag_of(f.dataType)
        if tag == "N":
            digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.abs(column).cast("string"), r"E.*$|\.", ""), "^0+", ""), "0+$", "")
            size = F.floor((F.greatest(F.lit(1), F.length(digits)) + 1) / 2) + 1 + F.when(column < 0, 1).otherwise(0)
        elif tag == "BOOL":
            size = F.lit(1)
        elif tag == "B":
            size = F.octet_length(column)
        else:
            size = F.octet_length(column.cast("string") if tag == "S" else F.to_json(column))
        total = total + F.when(column.isNotNull(), size + len(f.name.encode())).otherwise(0).cast("long")
    return total


def get_item(table: Relation, key: dict[str, Any], projection: list[tuple] | None = None) -> DataFrame:
    if set(key) != set(table.key):
        raise ReadError("the key does not match the schema")
    found = table.items
    for name, value in key.items():
        found = found.where(F.col(f"`{name}`") == F.lit(value))
    return project_columns(found.limit(1), projection) if projection else found.limit(1)


def batch_get(table: Relation, keys: DataFrame, projection: list[tuple] | None = None) -> DataFrame:
    """Items of the distinct keys; missing keys are left out. keys: the key columns, of any size."""
    if (columns := set(keys.columns)) != set(table.key):
        raise ReadError(f"key columns {columns} do not match the schema")
    found = table.items.join(keys.distinct(), table.key, "left_semi")
    return project_columns(found, projection) if projection else found


def batch_get_request(table: Relation, keys: list[dict[str, Any]], projection: list[tuple] | None = None) -> DataFrame:
    """The request form: up to 100 distinct keys, given as values."""
    if not 1 <= len(keys) <= BATCH_KEYS:
        raise ReadError("a batch has 1 to 100 keys")
    rows = [tuple(k[n] for n in table.key) for k in keys]
    if len(set(rows)) != len(rows):
        raise ReadError("a key is given twice")
    spark = table.items.sparkSession
    schema = table.items.select(table.key).schema
    small = spark.createDataFrame(rows, schema)
    return batch_get(table, F.broadcast(small), projection)  # 100 rows at most


def transact_get_request(table: Relation, keys: list[dict[str, Any]]) -> DataFrame:
    """The request form: 1 to 100 distinct keys, given as values."""
    if not 1 <= len(keys) <= TRANSACTION_KEYS:
        raise ReadError("a transaction reads 1 to 100 items")
    rows = [tuple(k[n] for n in table.key) for k in keys]
    if len(set(rows)) != len(rows):
        raise ReadError("a key is given twice")
    kinds = ", ".join(f"`{k}` {table.items.schema[k].dataType.simpleString()}" for k in table.key)
    return transact_get(table, table.items.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{kinds}, ordinal int"))


def transact_get(table: Relation, keys: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per request row, in its order; a missing item leaves nulls."""
    return keys.join(table.items, table.key, "left").orderBy(ordinal)


def ordered(table: Relation, forward: bool = True) -> list[Column]:
    return [F.col(f"`{k}`").asc() if forward else F.col(f"`{k}`").desc() for k in table.key]


def after(table: Relation, start: dict[str, Any], forward: bool = True) -> Column:
    """Seek: the key tuple is beyond start in the reading direction."""
    kinds = {f.name: f.dataType for f in table.items.schema.fields}
    columns = [F.col(f"`{k}`") for k in table.key]
    at = [F.lit(start[k]).cast(kinds[k]) for k in table.key]
    # (a, b) > (x, y) as a >= x AND (a > x OR a = x AND b > y): bare comparisons, which reach the scan
    beyond = None
    for column, value in reversed(list(zip(columns, at, strict=True))):
        further = column > value if forward else column < value
        beyond = further if beyond is None else further | ((column == value) & beyond)
    return (columns[0] >= at[0] if forward else columns[0] <= at[0]) & beyond


@dataclass
class Page:
    items: list[dict]
    count: int
    scanned: int
    last_key: dict[str, Any] | None
    units: float


@dataclass
class Range:
    """A bound range read; ``rows`` is lazy, ``page`` runs it."""

    table: Relation
    predicate: Column | None
    filter: Any = None
    projection: list[tuple] | None = None
    select: str = "ALL_ATTRIBUTES"
    limit: int | None = None
    forward: bool = True
    start: dict[str, Any] | None = None
    consistent: bool = False

    def _selected(self) -> DataFrame:
        own = self.table.items
        if self.predicate is not None:
            own = own.where(self.predicate)
        # entries lacking a key attribute are not in the relation
        for k in self.table.key:
            own = own.where(F.col(f"`{k}`").isNotNull())
        return own.where(after(self.table, self.start, self.forward)) if self.start else own

    def admitted(self) -> DataFrame:
        """The evaluated rows: the limit, in key order, before any filter."""
        own = self._selected().orderBy(*ordered(self.table, self.forward))
        return own.limit(self.limit) if self.limit else own

    def rows(self) -> DataFrame:
        own = self.admitted()
        if self.filter is not None:
            own = own.where(Compiler(own.schema, self.table.sets).predicate(self.filter))
        if self.select == "COUNT":
            return own.agg(F.count("*").alias("count"))
        if self.projection:
            return project_columns(own, self.projection)
        return own.select(*self.table.projected) if self.table.projected and self.select == "ALL_PROJECTED_ATTRIBUTES" else own

    def page(self, default: int = QUERY_LIMIT, most: int = QUERY_MOST, size: Column | None = None) -> Page:
        """At most ``limit`` rows and 1 MiB are evaluated; one row more tells whether the page is the last."""
        limit = normalised_limit(self.limit, default, most)
        own = self._selected().orderBy(*ordered(self.table, self.forward)).limit(limit + 1)
        size = size if size is not None else estimated_size(own)
        passes = F.lit(True) if self.filter is None else Compiler(own.schema, self.table.sets).condition(self.filter)
        order = ordered(self.table, self.forward)
        # at most ``limit`` + 1 slim rows in one window; rows beyond the first that passes the budget stay where they are
        before = F.coalesce(F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = own.withColumns({"__size": size, "__pass": passes}).withColumn("__before", before).where(F.col("__before") <= PAGE_BYTES).orderBy(*order).collect()
        taken, used = 0, 0
        for row in rows[:limit]:
            if taken and used + row["__size"] > PAGE_BYTES:
                break
            used += row["__size"]
            taken += 1
        evaluated = rows[:taken]
        kept = [r for r in evaluated if r["__pass"]]
        more = taken < len(rows) or used > PAGE_BYTES
        last = {k: evaluated[-1][k] for k in self.table.key} if taken and more else None
        items = [] if self.select == "COUNT" else [_shown(r.asDict(recursive=True), self.projection) for r in kept]
        units = max(1, -(-used // UNIT_BYTES)) * (1.0 if self.consistent else 0.5)
        return Page(items, len(kept), len(evaluated), last, units)


def _shown(row: dict, projection: list[tuple] | None) -> dict:
    row = {k: v for k, v in row.items() if not k.startswith("__") and v is not None}
    if not projection:
        return row
    return _nested(row, _path_tree(projection)) or {}


def _nested(found: Any, tree: dict) -> Any:
    """What the paths of the tree select, in the shape it has in the item; None if nothing."""
    if not tree:
        return found
    if isinstance(found, dict):
        return {k: v for k, below in tree.items() if isinstance(k, str) and (v := _nested(found.get(k), below)) is not None} or None
    if isinstance(found, (list, tuple)):
        return [v for i, below in sorted((k, b) for k, b in tree.items() if isinstance(k, int)) if i < len(found) and (v := _nested(found[i], below)) is not None] or None
    return None


def _bind(table: Relation, names, bound, filter_text, projection_text, attributes, select):
    if not table.ready:
        raise ReadError("the index is not active")
    if select not in (None, *SELECTS):
        raise ReadError(f"unknown Select {select}")
    if select == "SPECIFIC_ATTRIBUTES" and not (projection_text or attributes):
        raise ReadError("SPECIFIC_ATTRIBUTES needs a projection")
    if select in ("COUNT", "ALL_ATTRIBUTES", "ALL_PROJECTED_ATTRIBUTES") and projection_text:
        raise ReadError(f"{select} takes no projection")
    tree = E.condition(filter_text, names, bound, whole=False) if filter_text else None
    paths = E.projection(projection_text, names, whole=False) if projection_text else [(a,) for a in attributes] if attributes else None
    if table.projected is not None:
        for path in [*(paths or []), *(E.attributes(tree) if tree is not None else [])]:
            if path[0] not in table.projected:
                raise ReadError(f"{path[0]} is not projected into the index")
    return tree, paths, select or ("SPECIFIC_ATTRIBUTES" if paths else "ALL_ATTRIBUTES")


def query(table: Relation, condition: str, *, names=None, bound=None, filter=None, projection=None, attributes=None, select=None, limit=None, forward=True, start=None, consistent=False) -> Range:
    tree, paths, select = _bind(table, names, bound, filter, projection, attributes, select)
    schema = table.items.schema
    range_type = tag_of(schema[table.range_key].dataType) if table.range_key else "S"
    key = E.key_condition(E.condition(condition, names, bound, whole=False), table.hash_key, table.range_key, range_type)
    if limit is not None:
        limit = normalised_limit(limit, QUERY_LIMIT, QUERY_MOST)
    return Range(table, key_predicate(key, schema, table.hash_key, table.range_key), tree, paths, select, limit, forward, start, consistent)


def scan(table: Relation, *, names=None, bound=None, filter=None, projection=None, attributes=None, select=None, limit=None, start=None, consistent=False, segment=None) -> Range:
    if segment is not None:
        raise ReadError("parallel scan is not offered: Spark splits a scan by itself")
    tree, paths, select = _bind(table, names, bound, filter, projection, attributes, select)
    if limit is not None:
        limit = normalised_limit(limit, SCAN_LIMIT, SCAN_MOST)
    return Range(table, None, tree, paths, select, limit, True, start, consistent)


def whole_scan(table: Relation, filter: str | None = None, names=None, bound=None) -> DataFrame:
    """A scan without pages or order: one pass, no sort, the filter pushed down where it can be."""
    if not filter:
        return table.items
    return table.items.where(Compiler(table.items.schema, table.sets).predicate(E.condition(filter, names, bound)))


def source_page(own: Range) -> DataFrame:
    """Rows as (key, item) pairs."""
    rows = own.rows()
    return rows.select(F.struct(*[F.col(f"`{k}`") for k in own.table.key]).alias("key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("item"))


def budgeted(table: Relation, size: Column, budget: int = PAGE_BYTES, limit: int = QUERY_LIMIT) -> DataFrame:
    """First page of every partition key: rows whose running size stays within the budget (the first always does)."""
    w = Window.partitionBy(table.hash_key).orderBy(*[F.col(k) for k in table.key[1:]])
    own = table.items.withColumn("page_bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("page_row", F.row_number().over(w))
    return own.where(((F.col("page_bytes") <= budget) | (F.col("page_row") == 1)) & (F.col("page_row") <= limit))


def token(last_key: dict[str, Any] | None) -> str | None:
    return None if last_key is None else base64.urlsafe_b64encode(values.canonical_json({k: str(v) for k, v in last_key.items()}).encode()).decode()


def from_token(text: str) -> dict[str, str]:
    return json.loads(base64.urlsafe_b64decode(text))


def billing(log: DataFrame) -> DataFrame:
    """Tallies per operation of a log with columns operation, bytes, consistent."""
    return log.groupBy("operation").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"), F.sum(capacity_units(F.col("bytes"), True)).alias("units"))


def places(rows: DataFrame, order: list[str], column: str = "place") -> DataFrame:
    """rows with their place, from 1, in the order of the columns (nulls first, the whole order distinct).

    Bounds from a sample by hash cut the order into ranges; a row's place is its number in its
    range, after the counts of the ranges before. The bounds only deal out the work.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select(*order).orderBy(F.xxhash64(*order)).limit(20 * ranges).orderBy(*order).collect()
    bounds = sample[20::20]
    typed = lambda row: F.struct(*[F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, row)])
    own = F.struct(*order)
    # the number of bounds at or before a row, by halving steps
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.array(*map(typed, bounds)), n + step - 1) <= own, n + step).otherwise(n)) if bounds else F.lit(0)
    dealt = rows.withColumn("__range", at)
    counts = dealt.groupBy("__range").count().collect()  # one row a range
    before, total = {}, 0
    for r in sorted(counts):
        before[r["__range"]], total = total, total + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x).cast(kind) for k, v in before.items() for x, kind in ((k, "int"), (v, "long"))]), F.col("__range")) if before else F.lit(0)
    return dealt.withColumn(column, (start + F.row_number().over(Window.partitionBy("__range").orderBy(*order))).cast("long")).drop("__range")
