"""Conditions compiled to DataFrame columns over typed attributes.

An attribute is a column: numbers are N, strings S, binaries B, booleans BOOL, structs and
maps M, arrays L (or the set type given). A null column is an absent attribute. Every leaf
is two-valued, so AND, OR and NOT are SQL's. Comparisons with literals stay plain column
predicates beneath a coalesce, and key conditions are bare predicates, which reach the scan.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import numbers, values
from heddle.plans.expressions import Attribute, Between, Both, Call, Compare, In, KeyCondition, Literal, Not, Size


def tag_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "N"
    if isinstance(kind, T.BinaryType):
        return "B"
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "M"
    if isinstance(kind, T.ArrayType):
        return "L"
    return "S"


class Compiler:
    """Compiles against a schema; sets: array columns that are sets, name -> SS, NS or BS."""

    def __init__(self, schema: T.StructType, sets: dict[str, str] | None = None):
        self.schema, self.sets = schema, sets or {}

    def attribute(self, path: tuple) -> tuple[Column, str, T.DataType] | None:
        """(column, tag, type), None where the schema has no such attribute."""
        name = path[0]
        if name not in self.schema.fieldNames():
            return None
        column, kind = F.col(f"`{name}`"), self.schema[name].dataType
        tag = self.sets.get(name) or tag_of(kind)
        for step in path[1:]:
            if isinstance(step, int):
                if not isinstance(kind, T.ArrayType) or tag != "L":
                    return None
                column, kind = F.try_element_at(column, F.lit(step + 1)), kind.elementType
            elif isinstance(kind, T.MapType):
                column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
            elif isinstance(kind, T.StructType) and step in kind.fieldNames():
                column, kind = column.getField(step), kind[step].dataType
            else:
                return None
            tag = tag_of(kind)
        return column, tag, kind

    def _literal(self, value: values.Value, kind: T.DataType | None = None) -> Column:
        tag, inner = next(iter(value.items()))
        if tag == "N":
            text = numbers.canonical(inner)
            if isinstance(kind, (T.DoubleType, T.FloatType)) or (kind is not None and "." in text and not isinstance(kind, T.DecimalType)):
                return F.lit(float(text))
            if "." not in text and -(2**63) <= int(text) < 2**63:
                return F.lit(int(text))
            return F.lit(text).cast("decimal(38,10)" if isinstance(kind, T.DecimalType) else "double")
        if tag == "B":
            return F.lit(base64.b64decode(inner))
        if tag in ("SS", "NS", "BS", "L"):
            members = inner if tag == "L" else [{tag[0]: v} for v in inner]
            return F.array(*[self._literal(m, kind.elementType if isinstance(kind, T.ArrayType) else None) for m in members])
        if tag == "NULL":
            return F.lit(None)
        return F.lit(inner)

    def _side(self, node) -> tuple[Column, str, T.DataType | None] | None:
        if isinstance(node, Literal):
            value = node.value
            return self._literal(value), values.tag(value), None
        if isinstance(node, Size):
            found = self.attribute(node.path.path)
            size = self.size(found) if found else None
            return (size, "N", T.LongType()) if size is not None else None
        return self.attribute(node.path)

    @staticmethod
    def size(found: tuple[Column, str, T.DataType]) -> Column | None:
        column, tag, kind = found
        if tag == "S":
            return (F.octet_length(F.encode(column.cast("string"), "UTF-16BE")) / 2).cast("long")
        if tag == "B":
            return F.octet_length(column).cast("long")
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.when(column.isNotNull(), F.size(column)).cast("long")
        return None

    def _equal(self, left, right) -> Column:
        """Null or boolean; false for other types."""
        a, b = self._side(left), self._side(right)
        if a is None or b is None:
            return F.lit(False)
        if a[2] is None and b[2] is not None:
            left, right, a, b = right, left, b, a
        if a[1] != b[1] and not {a[1], b[1]} <= {"L", "SS", "NS", "BS"}:
            return F.lit(False)
        if b[2] is None:
            value = right.value
            if {a[1], b[1]} & {"SS", "NS", "BS"} and a[1] != b[1]:
                return F.lit(False)
            b = (self._literal(value, a[2]), b[1], None)
        if a[1] in ("SS", "NS", "BS"):
            return F.array_sort(a[0]) == F.array_sort(b[0])
        if a[1] == "M":
            return self._same_maps(a[0], a[2], b[0], b[2]) if b[2] is not None else self._map_is(a[0], a[2], right.value)
        return a[0] == b[0]

    def _same(self, a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
        """Equality of two values that may both be absent."""
        if tag_of(a_kind) != tag_of(b_kind):
            return a.isNull() & b.isNull()
        if tag_of(a_kind) == "M":
            return (a.isNull() & b.isNull()) | F.coalesce(self._same_maps(a, a_kind, b, b_kind), F.lit(False))
        return a.eqNullSafe(b)

    def _same_maps(self, a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
        """Equality of two maps, whatever the order of their members; a null member is absent. Null if either is null."""
        if isinstance(a_kind, T.MapType) and isinstance(b_kind, T.MapType):
            live = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
            entries = lambda m: F.array_sort(F.map_entries(live(m)))
            return entries(a) == entries(b) if tag_of(a_kind.valueType) == tag_of(b_kind.valueType) else (F.size(live(a)) == 0) & (F.size(live(b)) == 0)
        if isinstance(a_kind, T.MapType):
            return self._same_maps(b, b_kind, a, a_kind)
        fields = {f.name: f.dataType for f in a_kind.fields}
        if isinstance(b_kind, T.MapType):
            others = F.size(F.map_filter(b, lambda k, v: v.isNotNull() & ~k.isin(list(fields)))) == 0
            same = others
            for name, kind in fields.items():
                same = same & self._same(a.getField(name), kind, F.try_element_at(b, F.lit(name)), b_kind.valueType)
        else:
            theirs = {f.name: f.dataType for f in b_kind.fields}
            same = F.lit(True)
            for name in dict.fromkeys([*fields, *theirs]):
                if name in fields and name in theirs:
                    same = same & self._same(a.getField(name), fields[name], b.getField(name), theirs[name])
                else:
                    same = same & (a.getField(name) if name in fields else b.getField(name)).isNull()
        return F.when(a.isNotNull() & b.isNotNull(), same)

    def _map_is(self, column: Column, kind: T.DataType, value: values.Value) -> Column:
        """Equality with a literal map, member by member; a null member of the column is absent."""
        inner = value["M"]
        if isinstance(kind, T.StructType):
            fields = {f.name: f.dataType for f in kind.fields}
            same = F.lit(set(inner) <= set(fields))
            for name, own in fields.items():
                member = column.getField(name)
                same = same & (self._is(member, own, inner[name]) if name in inner else member.isNull())
        else:
            same = F.size(F.map_filter(column, lambda _, v: v.isNotNull())) == len(inner)
            for name, member in inner.items():
                same = same & self._is(F.try_element_at(column, F.lit(name)), kind.valueType, member)
        return F.when(column.isNotNull(), same)

    def _is(self, column: Column, kind: T.DataType, value: values.Value) -> Column:
        tag = values.tag(value)
        if tag == "NULL" or tag != tag_of(kind) and not {tag, tag_of(kind)} <= {"L", "SS", "NS", "BS"}:
            return F.lit(False)  # a typed column holds no null value: null is absence
        if tag == "M":
            return F.coalesce(self._map_is(column, kind, value), F.lit(False))
        return F.coalesce(column == self._literal(value, kind), F.lit(False))

    def _ordered(self, left, right, op: str) -> Column:
        a, b = self._side(left), self._side(right)
        if a is None or b is None:
            return F.lit(False)
        if a[2] is None and b[2] is not None:
            flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
            return self._ordered(right, left, flip[op])
        x, tag, kind = a
        if tag not in ("S", "N", "B") or b[1] not in ("S", "N", "B"):
            return F.lit(False)
        if b[2] is None:  # the literal's own type is not looked at
            text = next(iter(right.value.values()))
            if tag == "N":
                try:
                    y = self._literal({"N": text}, kind)
                except numbers.NumberError:
                    return F.lit(False)
            else:
                y = F.lit(text)
        else:
            y = b[0] if (b[1] == "N") == (tag == "N") else b[0].try_cast("double") if tag == "N" else b[0].cast("string")
            y = F.base64(y) if b[1] == "B" and tag == "B" else y
        if tag == "B":
            x = F.base64(x)
        elif tag == "S" and not isinstance(kind, T.StringType):
            x = x.cast("string")
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def condition(self, node) -> Column:
        no = F.lit(False)
        if isinstance(node, Both):
            left, right = self.condition(node.left), self.condition(node.right)
            return left & right if node.op == "AND" else left | right
        if isinstance(node, Not):
            return ~self.condition(node.inner)
        if isinstance(node, Compare):
            if node.op == "=":
                return F.coalesce(self._equal(node.left, node.right), no)
            if node.op == "<>":
                differs = F.coalesce(~self._equal(node.left, node.right), F.lit(True))
                if isinstance(node.left, Size):
                    side = self._side(node.left)
                    return differs & side[0].isNotNull() if side else no
                return differs
            return F.coalesce(self._ordered(node.left, node.right, node.op), no)
        if isinstance(node, Between):
            return F.coalesce(self._ordered(node.subject, node.low, ">=") & self._ordered(node.subject, node.high, "<="), no)
        if isinstance(node, In):
            out = no
            for member in node.members:
                out = out | F.coalesce(self._equal(node.subject, member), no)
            return out
        if isinstance(node, Call):
            return self._call(node)
        raise TypeError(node)

    def predicate(self, node) -> Column:
        """For WHERE, where null and false are one: leaves outside any NOT stay bare, so they reach the scan."""
        if isinstance(node, Both):
            left, right = self.predicate(node.left), self.predicate(node.right)
            return left & right if node.op == "AND" else left | right
        if isinstance(node, Compare) and node.op != "<>":
            return self._equal(node.left, node.right) if node.op == "=" else self._ordered(node.left, node.right, node.op)
        if isinstance(node, Between):
            return self._ordered(node.subject, node.low, ">=") & self._ordered(node.subject, node.high, "<=")
        if isinstance(node, In):
            out = self._equal(node.subject, node.members[0])
            for member in node.members[1:]:
                out = out | self._equal(node.subject, member)
            return out
        if isinstance(node, Call) and node.name == "begins_with":
            found, operand = self.attribute(node.path.path), self._side(node.operand)
            if found and operand and found[1] == operand[1] == "S" and isinstance(found[2], T.StringType):
                return found[0].startswith(operand[0])
        return self.condition(node)

    def _call(self, node: Call) -> Column:
        no = F.lit(False)
        found = self.attribute(node.path.path)
        if node.name == "attribute_exists":
            return found[0].isNotNull() if found else no
        if node.name == "attribute_not_exists":
            return found[0].isNull() if found else F.lit(True)
        if found is None:
            return no
        column, tag, kind = found
        if node.name == "attribute_type":
            return column.isNotNull() if next(iter(node.operand.value.values())) == tag else no
        operand = self._side(node.operand)
        if operand is None:
            return no
        value, wanted, operand_kind = operand
        if isinstance(node.operand, Literal) and isinstance(kind, T.ArrayType):
            value = self._literal(node.operand.value, kind.elementType)
        if node.name == "begins_with":
            return F.coalesce(column.cast("string").startswith(value) if tag == "S" else F.startswith(column, value), no) if tag == wanted and tag in ("S", "B") else no
        if tag == "S":
            return F.coalesce(F.contains(column.cast("string"), value), no) if wanted == "S" else no
        if tag == "B":
            return F.coalesce(F.contains(column, value) & (F.octet_length(value) > 0), no) if wanted == "B" else no
        if tag in ("SS", "NS", "BS"):
            return F.coalesce(F.array_contains(column, value), no) if wanted == tag[0] else no
        if tag == "L" and tag_of(kind.elementType) == wanted:
            return F.coalesce(F.array_contains(column, value), no)
        return no


def key_predicate(key: KeyCondition, schema: T.StructType, hash_key: str, range_key: str | None) -> Column:
    """A bare predicate over the key columns: null keys never match, and it pushes down."""
    own = Compiler(schema)
    out = F.col(f"`{hash_key}`") == own._literal(key.hash_value.value, schema[hash_key].dataType)
    if key.op is None:
        return out
    column, kind = F.col(f"`{range_key}`"), schema[range_key].dataType

    def bound(literal: Literal) -> Column:
        made = own._literal(literal.value, kind)
        return made.cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else made

    first = bound(key.operands[0])
    if key.op == "between":
        return out & column.between(first, bound(key.operands[1]))
    if key.op == "begins_with":
        return out & (column.startswith(first) if isinstance(kind, T.StringType) else F.startswith(column, first))
    return out & {"=": column == first, "<": column < first, "<=": column <= first, ">": column > first, ">=": column >= first}[key.op]


def project_columns(df: DataFrame, paths: list[tuple]) -> DataFrame:
    """Typed projection that keeps the nesting: ``a.x, b.x`` gives a struct a and a struct b, each with its x.

    Members of a list keep their order and close ranks. An attribute that is not there is null.
    """
    return df.select(*[_projected(Compiler(df.schema), (name,), below).alias(name) for name, below in _path_tree(paths).items()])


def _path_tree(paths: list[tuple]) -> dict:
    """Steps to subtrees in the order given; an empty one is a whole value."""
    root: dict = {}
    for path in paths:
        level = root
        for step in path:
            level = level.setdefault(step, {})
    return root


def _projected(own: Compiler, path: tuple, below: dict) -> Column:
    found = own.attribute(path)
    if found is None:
        return F.lit(None).cast("string")
    if not below:
        return found[0]
    if all(isinstance(step, int) for step in below):
        return F.when(found[0].isNotNull(), F.array_compact(F.array(*[_projected(own, (*path, i), below[i]) for i in sorted(below)])))
    members = {name: tree for name, tree in below.items() if isinstance(name, str) and own.attribute((*path, name)) is not None}
    made = [_projected(own, (*path, name), tree).alias(name) for name, tree in members.items()]
    if not made:
        return F.lit(None).cast("string")
    some = made[0].isNotNull()
    for member in made[1:]:
        some = some | member.isNotNull()
    return F.when(some, F.struct(*made))


__all__ = ["Attribute", "Compiler", "_path_tree", "key_predicate", "project_columns", "tag_of"]
