"""Tagged item values ({"S": ..}, {"N": ..}, ..) as JSON text and Python objects."""

from __future__ import annotations

import base64
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions import numbers

TAGS = ("S", "N", "B", "SS", "NS", "BS", "BOOL", "NULL", "L", "M")
Value = dict[str, Any]
Item = dict[str, Value]


def tag(value: Value) -> str:
    return next(iter(value))


def canonical(value: Value) -> Any:
    """A form equal for equal values: numbers by value, sets unordered, maps by key."""
    kind, inner = next(iter(value.items()))
    if kind == "N":
        return ("N", numbers.canonical(inner))
    if kind == "NS":
        return ("NS", tuple(sorted(map(numbers.canonical, inner))))
    if kind in ("SS", "BS"):
        return (kind, tuple(sorted(inner)))
    if kind == "L":
        return ("L", tuple(map(canonical, inner)))
    if kind == "M":
        return ("M", tuple(sorted((k, canonical(v)) for k, v in inner.items())))
    return (kind, inner)


def equal(a: Value | None, b: Value | None) -> bool:
    return a is not None and b is not None and canonical(a) == canonical(b)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def to_plain(value: Value) -> Any:
    kind, inner = next(iter(value.items()))
    if kind == "N":
        return int(inner) if inner.lstrip("-").isdigit() else float(inner)
    if kind == "NULL":
        return None
    if kind == "L":
        return [to_plain(v) for v in inner]
    if kind == "M":
        return {k: to_plain(v) for k, v in inner.items()}
    if kind == "NS":
        return [to_plain({"N": v}) for v in inner]
    return inner


def from_plain(value: Any) -> Value:
    if value is None:
        return {"NULL": True}
    if isinstance(value, bool):
        return {"BOOL": value}
    if isinstance(value, (int, float)):
        return {"N": numbers.canonical(repr(value))}
    if isinstance(value, bytes):
        return {"B": base64.b64encode(value).decode()}
    if isinstance(value, list):
        return {"L": [from_plain(v) for v in value]}
    if isinstance(value, dict):
        return {"M": {k: from_plain(v) for k, v in value.items()}}
    return {"S": value}


def value_size(value: Value) -> int:
    kind, inner = next(iter(value.items()))
    if kind == "S":
        return len(inner.encode())
    if kind == "N":
        return numbers.size(inner)
    if kind == "B":
        return len(base64.b64decode(inner))
    if kind == "SS":
        return sum(len(v.encode()) for v in inner)
    if kind == "NS":
        return sum(map(numbers.size, inner))
    if kind == "BS":
        return sum(len(base64.b64decode(v)) for v in inner)
    if kind == "L":
        return 3 + len(inner) + sum(map(value_size, inner))
    if kind == "M":
        return 3 + len(inner) + sum(len(k.encode()) + value_size(v) for k, v in inner.items())
    return 1


def item_size(item: Item) -> int:
    return sum(len(k.encode()) + value_size(v) for k, v in item.items())


def size_of(value: Value) -> int | None:
    """size(path): UTF-16 units, bytes or members; None for numbers, booleans and nulls."""
    kind, inner = next(iter(value.items()))
    if kind == "S":
        return len(inner.encode("utf-16-be")) // 2
    if kind == "B":
        return len(base64.b64decode(inner))
    return len(inner) if kind in ("SS", "NS", "BS", "L", "M") else None


def check(value: Value, depth: int = 1) -> None:
    """The rules of a stored value: one known tag, sets non-empty and unique, nesting up to 32."""
    if len(value) != 1 or tag(value) not in TAGS:
        raise ValueError("a value has exactly one known type tag")
    if depth > 32:
        raise ValueError("nesting beyond 32 levels")
    kind, inner = next(iter(value.items()))
    if kind == "N":
        numbers.parts(inner)
    if kind in ("SS", "NS", "BS"):
        members = [numbers.canonical(v) for v in inner] if kind == "NS" else inner
        if not members or len(set(members)) != len(members):
            raise ValueError("a set has one member at least and no duplicates")
    for child in inner if kind == "L" else inner.values() if kind == "M" else ():
        check(child, depth + 1)


def item_size_column(item: Column) -> Column:
    """Logical size of an item given as tagged JSON text."""

    @F.pandas_udf("long")
    def sizes(items: pd.Series) -> pd.Series:
        return items.map(lambda x: item_size(json.loads(x)) if x is not None else None).astype("Int64")

    return sizes(item)


def tagged_json(columns: dict[str, tuple[str, Column]]) -> Column:
    """Tagged JSON of typed columns, name -> (tag, column); null columns are absent attributes."""
    fields = []
    for name, (kind, column) in columns.items():
        shown = column.cast("string") if kind in ("N", "S") else F.base64(column) if kind == "B" else column
        fields.append(F.when(column.isNotNull(), F.struct(shown.alias(kind))).alias(name))
    return F.to_json(F.struct(*fields))
