"""Writes as state transitions: (state, requests) to (state after, outcomes).

State and requests are DataFrames of typed columns with a common key; a request row carries
the item it writes. Conditions are evaluated on the stored item (absent: all null), in one
full join for the whole batch that also makes the state after it, so a batch costs one
shuffle of the changes and, unless the state is bucketed by key, one of the state. Requests must have distinct keys, as batches
and transactions require; ``latest_requests`` folds a longer log first.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import values
from heddle.operators.reads import estimated_size
from heddle.plans import expressions as E
from heddle.plans.columns import Compiler
from heddle.plans.evaluate import UpdateError, apply_update, changed, holds

BATCH_MOST, TRANSACTION_MOST, ITEM_BYTES, TRANSACTION_BYTES = 25, 100, 400 << 10, 4 << 20


class WriteError(ValueError):
    pass


def check_distinct(requests: DataFrame, key: list[str]) -> DataFrame:
    """requests, failing when run if a key occurs twice."""
    w = Window.partitionBy(*key)
    single = F.when(F.col("__n") > 1, F.raise_error(F.lit("two requests on one item"))).otherwise(True)  # a filter, which no pruning removes
    return requests.withColumn("__n", F.count("*").over(w)).where(single).drop("__n")


def latest_requests(requests: DataFrame, key: list[str], seq: str) -> DataFrame:
    columns = [c for c in requests.columns if c not in key]
    return requests.groupBy(*key).agg(F.max_by(F.struct(*columns), seq).alias("r")).select(*key, "r.*")


def _beside(state: DataFrame, requests: DataFrame, key: list[str], name: str = "__new") -> DataFrame:
    """State and requests in one full join: stored columns under their names, the request's in a struct."""
    columns = [c for c in requests.columns if c not in key]
    shaped = requests.select(*key, F.struct(*[F.col(c) for c in columns]).alias(name), F.lit(True).alias("__request"))
    return state.withColumn("__stored", F.lit(True)).join(shaped, key, "full_outer")


def _accepts(observed: DataFrame, condition, sets=None) -> Column:
    """Whether a row's request holds; rows without a request are never accepted."""
    if condition is None:
        return F.col("__request").isNotNull()
    # the absent item has no attributes, not even its key
    stored = Compiler(observed.schema, sets).condition(condition)
    return F.when(F.col("__request").isNull(), False).when(F.col("__stored").isNotNull(), stored).otherwise(F.lit(holds(condition, {})))


def _outcomes(observed: DataFrame, state: DataFrame, key: list[str], returns: str) -> DataFrame:
    if returns not in ("NONE", "ALL_OLD"):
        raise WriteError(f"unknown ReturnValues {returns}")
    own = observed.where("__request")
    old = [F.when(F.col("__ok") & F.col("__stored").isNotNull(), F.struct(*state.columns)).alias("old")] if returns == "ALL_OLD" else []
    return own.select(*key, F.col("__ok").alias("accepted"), F.col("__stored").isNotNull().alias("existed"), *old)


def _kept(observed: DataFrame) -> DataFrame:
    """Rows that exist afterwards: stored ones and accepted requests."""
    return observed.where(F.col("__stored").isNotNull() | F.col("__ok"))


def put(state: DataFrame, requests: DataFrame, key: list[str], condition=None, sets=None, returns: str = "NONE") -> tuple[DataFrame, DataFrame]:
    """(state after, outcomes): whole items replace or join the stored ones where the condition holds.

    outcomes: the key, accepted, existed, and old (the replaced item) with ``returns`` ALL_OLD.
    """
    observed = _beside(state, requests, key)
    observed = observed.withColumn("__ok", _accepts(observed, condition, sets))
    new = [c for c in requests.columns if c not in key]
    old = [c for c in state.columns if c not in key]

    def shown(c: str) -> Column:
        written = F.col(f"__new.`{c}`") if c in new else F.lit(None)
        return F.when(F.col("__ok"), written).otherwise(F.col(f"`{c}`") if c in old else F.lit(None)).alias(c)

    order = [*state.columns, *[c for c in new if c not in state.columns]]
    after = _kept(observed).select(*[F.col(f"`{c}`") if c in key else shown(c) for c in order])
    return after, _outcomes(observed, state, key, returns)


def delete(state: DataFrame, requests: DataFrame, key: list[str], condition=None, sets=None, returns: str = "NONE") -> tuple[DataFrame, DataFrame]:
    """(state after, outcomes). Deleting what is not there succeeds."""
    marked = requests.select(*key, F.lit(True).alias("__request"))
    observed = state.withColumn("__stored", F.lit(True)).join(marked, key, "full_outer")
    observed = observed.withColumn("__ok", _accepts(observed, condition, sets))
    return observed.where(F.col("__stored").isNotNull() & ~F.col("__ok")).select(*state.columns), _outcomes(observed, state, key, returns)


def update_columns(state: DataFrame, requests: DataFrame, key: list[str], assignments: dict[str, Column], condition=None, sets=None, returns: str = "NONE") -> tuple[DataFrame, DataFrame]:
    """Typed upsert: assignments map attributes to columns over the stored attributes and ``new`` (the request).

    Assignments are applied in order, each seeing the ones before it; null removes. Keys cannot be assigned.
    """
    if set(assignments) & set(key):
        raise WriteError("key attributes cannot be updated")
    observed = _beside(state, requests, key, "new")
    observed = observed.withColumn("__ok", _accepts(observed, condition, sets))
    outcomes = _outcomes(observed, state, key, returns)
    own = _kept(observed)
    for name, value in assignments.items():
        own = own.withColumn(name, F.when(F.col("__ok"), value).otherwise(F.col(f"`{name}`") if name in own.columns else F.lit(None)))
    return own.select(*dict.fromkeys([*state.columns, *assignments])), outcomes


def update_items(state: DataFrame, requests: DataFrame, key: list[str], update: str, names=None, bound=None, condition: str | None = None, returns: str = "NONE", item: str = "item") -> DataFrame:
    """The general update over tagged-JSON items: key, accepted, new_item, returned, error.

    For items that have no typed columns; batches go through Arrow, an item at a time.
    """
    actions = E.update(update, names, bound, whole=False)
    tree = E.condition(condition, names, bound, whole=False) if condition else None
    if any(a.path[0] in key for a in actions):
        raise WriteError("key attributes cannot be updated")
    joined = requests.select(*key, F.to_json(F.struct(*key)).alias("__key")).join(state.select(*key, item), key, "left")

    @F.pandas_udf("accepted boolean, new_item string, returned string, error string")
    def run(old: pd.Series) -> pd.DataFrame:
        rows = []
        for text in old:
            stored = json.loads(text) if text is not None else None
            if tree is not None and not holds(tree, stored):
                rows.append((False, text, None, "condition failed"))
                continue
            try:
                new = apply_update(stored, actions, tuple(key))
                for value in new.values():
                    values.check(value)
                if values.item_size(new) > ITEM_BYTES:
                    raise UpdateError("the item is larger than 400 KiB")
                rows.append((True, values.canonical_json(new), values.canonical_json(changed(stored, new, actions, returns)), None))
            except ValueError as error:
                rows.append((False, text, None, str(error)))
        return pd.DataFrame(rows, columns=["accepted", "new_item", "returned", "error"])

    return joined.select(*key, run(F.col(item)).alias("r")).select(*key, "r.*")


def batch_write(state: DataFrame, requests: DataFrame, key: list[str], action: str = "action") -> DataFrame:
    """State after puts and deletes of one batch of any size (column action: PUT or DELETE); a key may occur once."""
    own = check_distinct(requests, key)
    new = [c for c in requests.columns if c not in (*key, action)]
    observed = _beside(state, own, key)
    kept = observed.where(F.col("__request").isNull() | (F.col(f"__new.`{action}`") == "PUT"))
    pick = lambda c: F.when(F.col("__request").isNull(), F.col(f"`{c}`")).otherwise(F.col(f"__new.`{c}`") if c in new else F.lit(None)).alias(c)
    return kept.select(*[F.col(f"`{c}`") if c in key else pick(c) for c in state.columns])


def batch_write_request(state: DataFrame, requests: list[dict], key: list[str], action: str = "action") -> DataFrame:
    """The request form: 1 to 25 puts and deletes given as values, of at most 400 KiB each."""
    if not 1 <= len(requests) <= BATCH_MOST:
        raise WriteError("a batch has 1 to 25 requests")
    if any(r[action] not in ("PUT", "DELETE") for r in requests):
        raise WriteError("a batch holds puts and deletes")
    if len({tuple(r[k] for k in key) for r in requests}) < len(requests):
        raise WriteError("two requests on one item")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    rows = state.sparkSession.createDataFrame([tuple(r.get(c) for c in (*state.columns, action)) for r in requests], f"{kinds}, `{action}` string")
    if rows.agg(F.max(estimated_size(rows.drop(action)))).first()[0] > ITEM_BYTES:
        raise WriteError("an item is larger than 400 KiB")
    return batch_write(state, rows, key, action)


def transact(
    state: DataFrame, members: DataFrame, key: list[str], conditions: dict[str, Column], *, updates: dict[str, Column] | None = None, txn: str = "txn", kind: str = "kind", rule: str = "rule",
) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing batches over one snapshot: (state after, a row per member with its reason).

    members: txn, ordinal, kind (PUT, UPDATE, DELETE, CHECK), rule (a name in ``conditions``, or
    null), the key and the new item's columns. conditions: columns over the stored attributes.
    updates: for UPDATE members, attributes as columns over the stored ones and ``new`` (the
    member); without it they take the member's columns that are not null. Two members of a
    transaction on one item fail it. Of the transactions whose own conditions hold and that
    write one item, the first has it and the others fail with a conflict. More than 100 members
    or 4 MiB of new items fail a transaction; an unknown kind or rule is an error.
    """
    columns = [c for c in state.columns if c not in key]
    known = F.col(kind).isin("PUT", "UPDATE", "DELETE", "CHECK") & (F.col(rule).isNull() | F.col(rule).isin(list(conditions)))
    # a filter, which no pruning removes
    checked = members.where(F.when(~F.coalesce(known, F.lit(False)), F.raise_error(F.concat(F.lit("unknown kind or rule: "), F.coalesce(kind, F.lit("null")), F.lit(" "), F.coalesce(rule, F.lit("null"))))).otherwise(True))
    size = F.when(F.col(kind).isin("PUT", "UPDATE"), estimated_size(members.select(*key, *columns))).otherwise(0)
    own = checked.select(txn, "ordinal", kind, rule, *key, F.struct(*[F.col(c) for c in columns]).alias("new"), size.alias("__size"))
    seen = own.join(state.withColumn("__stored", F.lit(True)), key, "left")
    passed = F.lit(True)
    for name, condition in conditions.items():
        passed = F.when(F.col(rule) == name, F.coalesce(condition, F.lit(False))).otherwise(passed)
    whole = Window.partitionBy(txn)
    twice = F.count("*").over(Window.partitionBy(txn, *key)) > 1
    judged = seen.withColumn("__twice", twice).withColumn("__passed", passed)
    fits = (F.count("*").over(whole) <= TRANSACTION_MOST) & (F.sum("__size").over(whole) <= TRANSACTION_BYTES)
    judged = judged.withColumn("__alone", F.min(F.col("__passed") & ~F.col("__twice")).over(whole) & fits).withColumn("__fits", fits)
    # among the transactions that hold by themselves and write one item the first has it
    contends = F.col("__alone") & (F.col(kind) != "CHECK")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(contends.desc(), txn, "ordinal"))
    conflict = contends & (rank > 1)
    reason = F.when(F.col("__twice"), "DuplicateItem").when(~F.col("__fits"), "TooLarge").when(~F.col("__passed"), "ConditionalCheckFailed").when(conflict, "TransactionConflict").otherwise("None")
    judged = judged.withColumn("reason", reason)
    outcome = judged.withColumn("applied", F.min(F.col("reason") == "None").over(whole))
    writes = outcome.where(F.col("applied") & (F.col(kind) != "CHECK"))

    def written(c: str) -> Column:
        updated = (updates[c] if c in updates else F.col(f"`{c}`")) if updates is not None else F.coalesce(F.col(f"new.`{c}`"), F.col(f"`{c}`"))
        return F.when(F.col(kind) == "UPDATE", updated).otherwise(F.col(f"new.`{c}`")).alias(c)

    changes = writes.select(*key, F.struct(F.col(kind).alias("kind"), *[written(c) for c in columns]).alias("__new"), F.lit(True).alias("__request"))
    beside = state.withColumn("__stored", F.lit(True)).join(changes, key, "full_outer").where(F.col("__request").isNull() | (F.col("__new.kind") != "DELETE"))
    after = beside.select(*[F.col(f"`{c}`") if c in key else F.when(F.col("__request").isNull(), F.col(f"`{c}`")).otherwise(F.col(f"__new.`{c}`")).alias(c) for c in state.columns])
    return after, outcome.select(txn, "ordinal", *key, "reason", "applied")


def replay(requests: DataFrame, receipts: DataFrame, now, token: str = "token", digest: str = "digest") -> DataFrame:
    """Idempotency: requests with outcome NEW, REPLAY (stored response) or MISMATCH, by unexpired receipts."""
    live = receipts.where(F.col("expires_at") > F.lit(now)).select(token, F.col(digest).alias("__digest"), F.col("response").alias("stored_response"))
    own = requests.join(live, token, "left")
    outcome = F.when(F.col("__digest").isNull(), "NEW").when(F.col("__digest") == F.col(digest), "REPLAY").otherwise("MISMATCH")
    return own.withColumn("outcome", outcome).withColumn("stored_response", F.when(F.col("outcome") == "REPLAY", F.col("stored_response"))).drop("__digest")


def capped_put(state: DataFrame, requests: DataFrame, key: list[str], group: str, cap: int) -> DataFrame:
    """New entities join a group only up to its cap, the smallest keys first; stored keys are left as they are."""
    fresh = requests.join(state.select(*key), key, "left_anti")
    held = state.groupBy(group).agg(F.count("*").alias("__held"))
    ranked = fresh.join(held, group, "left").withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*key)))
    return state.unionByName(ranked.where(F.coalesce("__held", F.lit(0)) + F.col("__n") <= cap).select(*state.columns))


def stamped(items: DataFrame, now: int, column: str = "updated_at") -> DataFrame:
    return items.withColumn(column, F.lit(now).cast("long"))


def indexers(stored: Column, requested: Column) -> Column:
    """Indexer lists on update: absent keeps, a list replaces, an empty one clears."""
    return F.when(requested.isNull(), stored).otherwise(requested)


def reject_legacy(request: dict) -> None:
    for name in ("Expected", "AttributeUpdates", "ConditionalOperator"):
        if name in request:
            raise WriteError(f"{name} is a legacy parameter")
