"""Secondary indexes, expiry and retention as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators.reads import Relation
from heddle.plans.columns import tag_of


class IndexError_(ValueError):
    pass


def index(table: Relation, hash_key: str, range_key: str | None = None, projection: str = "ALL", include: tuple[str, ...] = ()) -> Relation:
    """The sparse index: items with all index keys; KEYS_ONLY, INCLUDE or ALL attributes."""
    keys = [hash_key, *([range_key] if range_key else [])]
    if projection not in ("ALL", "KEYS_ONLY", "INCLUDE"):
        raise IndexError_(f"unknown projection {projection}")
    own = table.items
    for k in keys:
        own = own.where(F.col(f"`{k}`").isNotNull())
    columns = None
    if projection != "ALL":
        columns = tuple(dict.fromkeys([*table.key, *keys, *(include if projection == "INCLUDE" else ())]))
        own = own.select(*[f"`{c}`" for c in columns])
    return Relation(own, hash_key, range_key, tuple(table.key), table.sets, columns)


def check_key_types(items: DataFrame, wanted: dict[str, str]) -> None:
    """Index key attributes must have the declared type."""
    for name, tag in wanted.items():
        if tag_of(items.schema[name].dataType) != tag:
            raise IndexError_(f"{name} is not of type {tag}")


def maintenance(changes: DataFrame, key: list[str], index_key: list[str], projected: list[str] | None) -> DataFrame:
    """Index actions for changes with structs old and new (null: absent): key, action (DELETE, PUT), entry.

    An entry whose index key moves is deleted and put; an unchanged projection is skipped,
    but never for ALL (projected None).
    """
    has = lambda side: F.col(side).isNotNull() & F.greatest(*[F.col(f"{side}.{k}").isNull().cast("int") for k in index_key], F.lit(0)).eqNullSafe(0)
    same_key = F.lit(True)
    for k in index_key:
        same_key = same_key & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    same = F.lit(projected is not None) & same_key
    for c in projected or []:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    entry = lambda side: F.struct(*[F.col(f"{side}.{k}").alias(k) for k in dict.fromkeys([*index_key, *(projected or [])])])
    drop = has("old") & ~(has("new") & same_key)
    put = has("new") & ~(has("old") & same)
    actions = F.filter(F.array(F.when(drop, F.struct(F.lit("DELETE").alias("action"), entry("old").alias("entry"))), F.when(put, F.struct(F.lit("PUT").alias("action"), entry("new").alias("entry")))), lambda a: a.isNotNull())
    return changes.select(*key, F.explode(actions).alias("a")).select(*key, "a.action", "a.entry")


def apply_actions(entries: DataFrame, actions: DataFrame, key: list[str], index_key: list[str]) -> DataFrame:
    """The index after a batch of maintenance actions (at most one DELETE and one PUT an item)."""
    flat = actions.select(*key, "action", "entry.*")
    gone = flat.where("action = 'DELETE'").select(*dict.fromkeys([*key, *index_key]))
    puts = flat.where("action = 'PUT'").drop("action")
    at = list(dict.fromkeys([*key, *index_key]))
    kept = entries.join(gone, at, "left_anti").join(puts.select(*at), at, "left_anti")
    return kept.unionByName(puts.select(*entries.columns))


def build_states(builds: DataFrame) -> DataFrame:
    """Phase of index builds with columns cursor, low, high, scanned, projected_through, conflicts."""
    phase = (
        F.when(F.col("conflicts") > 0, "BLOCKED").when(~F.col("scanned"), "SCANNING").when((F.col("cursor") >= F.col("high")) & (F.col("projected_through") >= F.col("high")), "ACTIVE").otherwise("CATCHING_UP")
    )
    return builds.withColumn("phase", phase).withColumn("queryable", F.col("phase") == "ACTIVE")


def lag_policy(lag_ms: Column) -> Column:
    """Struct: delayed (from 400 ms) and share of writes throttled (10 to 75 % from 1 s, 90 % from 3 s)."""
    share = F.when(lag_ms >= 3000, 0.9).when(lag_ms >= 1000, 0.1 + (lag_ms - 1000) / 2000.0 * 0.65).otherwise(0.0)
    return F.struct((lag_ms >= 400).alias("delayed"), share.alias("throttled"))


# -- expiry -----------------------------------------------------------------------------------


def ttl_index(items: DataFrame, attribute: str) -> DataFrame:
    """Items whose attribute reads as whole seconds, with ttl_seconds."""
    column, kind = F.col(f"`{attribute}`"), items.schema[attribute].dataType
    if tag_of(kind) != "N":
        return items.withColumn("ttl_seconds", F.lit(None).cast("long")).where("ttl_seconds IS NOT NULL")
    # by value, as the text of a double of 10^7 or more has an exponent; 2^63 as a double would be cut to the greatest long
    whole = (column % 1 == 0) & (column < 2.0**63) if isinstance(kind, (T.FloatType, T.DoubleType)) else column % 1 == 0
    return items.withColumn("ttl_seconds", F.when(whole, column.try_cast("long"))).where("ttl_seconds IS NOT NULL")


def expired(items: DataFrame, attribute: str, cutoff: int, key: list[str]) -> DataFrame:
    """Victims of a sweep: expiry at or before the cutoff. Each is re-checked when it is deleted."""
    return ttl_index(items, attribute).where(F.col("ttl_seconds") <= cutoff).select(*key, "ttl_seconds")


def sweep(items: DataFrame, attribute: str, victims: DataFrame, key: list[str]) -> DataFrame:
    """items without the victims that still have the expiry they were chosen for."""
    own = ttl_index(items, attribute).join(victims, [*key, "ttl_seconds"], "left_semi").select(*key)
    return items.join(own, key, "left_anti")


TTL_STATES = {("DISABLED", True): "ENABLING", ("ENABLING", None): "ENABLED", ("ENABLED", False): "DISABLING", ("DISABLING", None): "DISABLED"}


def ttl_transition(state: str, enable: bool | None, generation: int) -> tuple[str, int]:
    """Next state of the expiry setting (enable None: the background step ends) and its generation."""
    if (state, enable) not in TTL_STATES:
        raise IndexError_(f"expiry is {state}")
    return TTL_STATES[(state, enable)], generation + (enable is not None)


# -- retention ----------------------------------------------------------------------------------


def removable_history(history: DataFrame, key: list[str], version: str, published_at: str, cutoff) -> DataFrame:
    """Versions that cleanup may drop, per item: those strictly below the protected boundary.

    With u the first version not yet past the cutoff, the boundary is the smaller of u's
    predecessor (or u, if it has none) and the current version; if all are past the cutoff
    only the current version is protected.
    """
    w = Window.partitionBy(*key).orderBy(version)
    fresh = F.col(published_at) > F.lit(cutoff)
    marked = history.withColumn("__before", F.lag(version).over(w))
    bounds = marked.groupBy(*key).agg(F.min(F.when(fresh, F.coalesce("__before", version))).alias("__kept"), F.max(version).alias("__live"))
    joined = history.join(bounds, key)
    return joined.where(F.col(version) < F.least(F.coalesce("__kept", "__live"), F.col("__live"))).select(*history.columns)


def trim_lanes(log: DataFrame, lane: str, seq: str, at: str, cutoff) -> DataFrame:
    """What stays of a log: per lane, the prefix of rows at or before the cutoff goes; the first later row keeps its suffix."""
    first = log.where(F.col(at) > F.lit(cutoff)).groupBy(lane).agg(F.min(seq).alias("__first"))
    return log.join(first, lane).where(F.col(seq) >= F.col("__first")).drop("__first")


def orphans(rows: DataFrame, owners: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(owners, on, "left_anti")


def trim_receipts(receipts: DataFrame, now) -> DataFrame:
    return receipts.where(F.col("expires_at") > F.lit(now))


def retention_hours(hours: int) -> int | None:
    """Stream durations: 24 to 61320 hours, -1 for ever (None)."""
    if hours == -1:
        return None
    if not 24 <= hours <= 61_320:
        raise IndexError_("a stream duration is 24 to 61320 hours, or -1")
    return hours
