"""ReadSequence: a bounded graph of dependent reads as one lazy plan of joins.

Nodes are Get, BatchGet and Query steps on relations; an input binds key attributes from an
earlier node's columns, from constants or from a string template. Every node becomes a
DataFrame with an ``invocation`` and, for dependent nodes, the parent's columns it was
bound from; Catalyst chooses how to join.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators.reads import Relation

STEPS_MOST, CHILD_LIMIT, CHILD_MOST, TOTAL_MOST = 16, 25, 100, 2048
TEMPLATE = re.compile(r"\{(\w+)\}")


class SequenceError(ValueError):
    pass


@dataclass(frozen=True)
class From:
    """A value of an earlier node: its column (a path of struct fields) and what to do if it is missing."""

    node: str
    column: str
    missing: str = "SKIP"  # SKIP, NULL, ERROR


@dataclass(frozen=True)
class Template:
    text: str
    inputs: dict[str, From]


@dataclass
class Node:
    name: str
    kind: str  # GET, BATCH_GET, QUERY
    relation: Relation
    key: dict[str, Any] = field(default_factory=dict)  # attribute -> From, Template or constant
    many: bool = False
    limit: int | None = None
    after: tuple[str, ...] = ()
    #: the node whose rows the invocations go over; the others it is bound from have one row each
    iterate: str | None = None


def _inputs(node: Node) -> list[From]:
    found: list[From] = []
    for source in node.key.values():
        found += [source] if isinstance(source, From) else list(source.inputs.values()) if isinstance(source, Template) else []
    return found


def schedule(nodes: list[Node]) -> list[list[str]]:
    """Waves of nodes whose inputs are all in earlier waves."""
    if not 1 <= len(nodes) <= STEPS_MOST:
        raise SequenceError("a sequence has 1 to 16 steps")
    names = {n.name for n in nodes}
    if len(names) != len(nodes):
        raise SequenceError("two nodes have one name")
    needs = {n.name: {f.node for f in _inputs(n)} | set(n.after) for n in nodes}
    for name, wanted in needs.items():
        if wanted - names:
            raise SequenceError(f"{name} depends on an unknown node")
    waves: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(nodes):
        wave = sorted(n for n in needs if n not in done and needs[n] <= done)
        if not wave:
            raise SequenceError("the nodes depend on each other in a cycle")
        waves.append(wave)
        done |= set(wave)
    return waves


def digest(nodes: list[Node]) -> str:
    shape = [[n.name, n.kind, sorted((k, repr(v)) for k, v in n.key.items()), n.many, n.limit] for n in nodes]
    return hashlib.sha256(json.dumps(shape, default=str).encode()).hexdigest()


def token(nodes: list[Node], position: dict[str, Any]) -> str:
    body = json.dumps({"graph": digest(nodes), "at": position}, sort_keys=True, default=str)
    return json.dumps({"body": body, "sum": hashlib.sha256(body.encode()).hexdigest()})


def resume(nodes: list[Node], text: str) -> dict[str, Any]:
    outer = json.loads(text)
    if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sum"]:
        raise SequenceError("the token is damaged")
    body = json.loads(outer["body"])
    if body["graph"] != digest(nodes):
        raise SequenceError("the token belongs to another graph")
    return body["at"]


def _value(source, kinds: dict, single: dict[str, DataFrame]) -> Column:
    """The bound value; kinds: the types of the parent's columns; single: nodes of one row, where a second one is an error."""
    if isinstance(source, From):
        found = single[source.node].select(source.column).scalar() if source.node in single else F.col(f"__parent.{source.column}")
        return F.when(found.isNull(), F.raise_error(F.lit(f"{source.node}.{source.column} is missing"))).otherwise(found) if source.missing == "ERROR" else found
    if isinstance(source, Template):
        pieces: list[Column] = []
        at = 0
        for match in TEMPLATE.finditer(source.text):
            value = _value(source.inputs[match[1]], kinds, single)
            part = source.inputs[match[1]]
            kind = single[part.node].schema[part.column].dataType if part.node in single else kinds.get(part.column, T.StringType())
            if not isinstance(kind, (T.StringType, T.NullType)):
                raise SequenceError(f"{part.column} is not a string: a template takes no other values")
            pieces += [F.lit(source.text[at : match.start()]), value]
            at = match.end()
        return F.concat(*pieces, F.lit(source.text[at:]))
    return F.lit(source)


def read_sequence(nodes: list[Node], consistency: str = "EVENTUAL") -> dict[str, DataFrame]:
    """Every node's rows: the relation's columns, ``invocation`` and ``__parent`` of dependent nodes.

    Dependent Gets keep the first invocation of every key; a Get that finds nothing keeps its
    invocation with null attributes; Queries keep the rows they find, in key order, at most
    ``limit`` an invocation.
    """
    if consistency not in ("EVENTUAL", "STRONG", "TRANSACTIONAL"):
        raise SequenceError(f"unknown consistency {consistency}")
    by_name = {n.name: n for n in nodes}
    out: dict[str, DataFrame] = {}
    for name in (n for wave in schedule(nodes) for n in wave):
        node = by_name[name]
        parents = {f.node for f in _inputs(node)}
        if len(parents) > 1 and node.iterate not in parents:
            raise SequenceError(f"{name} is bound from several nodes and must name the one it iterates over")
        over = node.iterate if len(parents) > 1 else next(iter(parents), None)
        if node.kind == "QUERY" and node.many and node.limit is None:
            raise SequenceError(f"{name} iterates and must state a limit")
        if node.limit is not None and not 1 <= node.limit <= CHILD_MOST:
            raise SequenceError("a child limit is 1 to 100")
        if consistency != "EVENTUAL" and node.relation.base_key:
            raise SequenceError("an index is read with eventual consistency")
        out[name] = _node(node, out[over] if over else None, {p: out[p] for p in parents - {over}})
    return out


def _node(node: Node, parent: DataFrame | None, single: dict[str, DataFrame]) -> DataFrame:
    items, keys = node.relation.items, list(node.key)
    if parent is None:
        own = items
        for k, v in node.key.items():
            own = own.where(F.col(k).isin(v) if isinstance(v, (list, tuple)) else F.col(k) == F.lit(v))
        if node.limit:
            own = own.orderBy(*node.relation.key).limit(node.limit)
        return own.withColumn("invocation", F.lit(0).cast("long")).withColumn("__order", F.struct(*[F.col(f"`{k}`") for k in node.relation.key]))
    source = parent.select(F.struct(*[c for c in parent.columns if not c.startswith("__")]).alias("__parent"), F.col("__order").alias("__before"))
    kinds = {f.name: f.dataType for f in parent.schema.fields}
    bound = source
    for k, v in node.key.items():
        bound = bound.withColumn(f"__k_{k}", _value(v, kinds, single))
    skipped = [f"__k_{k}" for k, v in node.key.items() if not isinstance(v, From) or v.missing != "NULL"]
    for column in skipped:
        bound = bound.where(F.col(column).isNotNull())
    if node.kind in ("GET", "BATCH_GET"):
        # the first invocation of every key, in the order of the rows it was bound from
        first = F.min_by(F.struct("__parent", "__before"), F.struct("__before", F.to_json("__parent")))
        bound = bound.groupBy(*[f"__k_{k}" for k in keys]).agg(first.alias("__first")).select(*[f"__k_{k}" for k in keys], "__first.*")
    bound = bound.withColumn("invocation", F.xxhash64(*[F.col(f"__k_{k}") for k in keys], F.to_json("__parent")))
    child = items.select(*[F.col(f"`{c}`").alias(f"__i_{c}") for c in items.columns])  # a node may read its parent's relation
    joined = bound.join(child, [F.col(f"__k_{k}") == F.col(f"__i_{k}") for k in keys], "left" if node.kind == "GET" else "inner")
    if node.limit:
        w = Window.partitionBy("invocation").orderBy(*[f"__i_{k}" for k in node.relation.key])
        joined = joined.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= node.limit).drop("__n")
    shown = [F.coalesce(f"__i_{c}", f"__k_{c}").alias(c) if c in keys and node.kind == "GET" else F.col(f"__i_{c}").alias(c) for c in items.columns]
    order = F.struct(F.col("__before").alias("before"), F.struct(*[F.col(f"__i_{k}").alias(k) for k in node.relation.key]).alias("own")).alias("__order")
    return joined.select(*shown, "invocation", "__parent", order)


def one(rows: DataFrame, missing: str = "ERROR") -> DataFrame:
    """ONE cardinality: fails on more than one row, and on none if missing is ERROR."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    own = rows.limit(2).withColumn("__n", n)  # two rows
    own = own.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one value"))).otherwise(True)).drop("__n")
    if missing == "ERROR" and own.isEmpty():
        raise SequenceError("no value")
    return own


SELECTOR = re.compile(r"^\$\.(Get\.Item|(?:BatchGet|Query)\.Items(?:\[(\*|\d+)\])?)((?:\.\w+|\[\d+\])*)$")


def select(rows: DataFrame, selector: str, order: list[str]) -> DataFrame:
    """Values of ``$.Get.Item.path``, ``$.Query.Items[*].path``, ``$.Query.Items[i].path``: column value."""
    match = SELECTOR.match(selector)
    if not match:
        raise SequenceError(f"not a selector: {selector}")
    own = rows.orderBy(*order)
    if match[2] and match[2] != "*":
        own = own.offset(int(match[2])).limit(1)
    value: Column | None = None
    for name, position in re.findall(r"\.(\w+)|\[(\d+)\]", match[3]):
        value = F.try_element_at(value, F.lit(int(position) + 1)) if position else F.col(name) if value is None else value.getField(name)
    return own.select((value if value is not None else F.struct(*rows.columns)).alias("value"))


def mapped(parent: DataFrame, child: Relation, parent_column: str, indexer: int | None = None, constant: dict[str, Any] | None = None) -> DataFrame:
    """A mapped edge: the parent's indexer value (or column) equals the child's hash key."""
    value = F.try_element_at(F.col("indexer_values"), F.lit(indexer + 1)) if indexer is not None else F.col(parent_column)
    own = child.items
    for k, v in (constant or {}).items():
        own = own.where(F.col(k) == F.lit(v))
    renamed = own.withColumn("__h", F.col(child.hash_key))
    return parent.withColumn("__v", value).join(renamed, F.col("__v") == F.col("__h")).drop("__v", "__h")
