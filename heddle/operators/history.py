"""Item history and change streams: snapshots in order to current state, images, pages, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators import reads

VIEWS = {"KEYS_ONLY": (), "NEW_IMAGE": ("new",), "OLD_IMAGE": ("old",), "NEW_AND_OLD_IMAGES": ("new", "old")}
STREAM_LIMIT, SYSTEM_LIMIT = 1000, 8192


class StreamError(ValueError):
    pass


def current(log: DataFrame, key: list[str], seq: list[str], deleted: Column | None = None) -> DataFrame:
    """The latest snapshot of every key; keys whose latest is a deletion are gone.

    max_by combines before the shuffle, so a key with a long history moves one row a task.
    """
    columns = [c for c in log.columns if c not in key]
    row = F.struct(*[F.col(f"`{c}`") for c in columns], *([deleted.alias("__gone")] if deleted is not None else []))
    latest = log.groupBy(*key).agg(F.max_by(row, F.struct(*seq)).alias("r"))
    return (latest.where("NOT r.__gone") if deleted is not None else latest).select(*key, *[F.col(f"r.`{c}`") for c in columns])


def images(log: DataFrame, key: list[str], seq: list[str], deleted: Column | None = None) -> DataFrame:
    """key, seq, event_name, old, new: INSERT, MODIFY or REMOVE from successive snapshots.

    The window needs an item's versions in one task; they spill, and an item's versions are
    bounded by retention. For a log of a few enormous items use ``images_by_bucket``.
    """
    columns = [c for c in log.columns if c not in key and c not in seq]
    new = F.struct(*[F.col(f"`{c}`") for c in columns])
    shown = log.withColumn("new", F.when(~deleted, new) if deleted is not None else new)
    own = shown.withColumn("old", F.lag("new").over(Window.partitionBy(*key).orderBy(*seq)))
    name = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "REMOVE").otherwise("MODIFY")
    return own.where("old IS NOT NULL OR new IS NOT NULL").select(*key, *seq, name.alias("event_name"), "old", "new")


def images_by_bucket(log: DataFrame, key: list[str], seq: str, deleted: Column | None = None, width: int = 1_000_000) -> DataFrame:
    """``images`` for items with very many versions: windows over (key, seq div width) only.

    The first version of a bucket takes its predecessor from the last version of the key's
    previous bucket, found over one row a bucket.
    """
    columns = [c for c in log.columns if c not in [*key, seq]]
    new = F.struct(*[F.col(f"`{c}`") for c in columns])
    own = log.withColumn("new", F.when(~deleted, new) if deleted is not None else new).withColumn("__b", F.floor(F.col(seq) / width))
    inner = own.withColumn("__row", F.struct("new")).withColumn("__old", F.lag("__row").over(Window.partitionBy(*key, "__b").orderBy(seq)))
    lasts = own.groupBy(*key, "__b").agg(F.max_by(F.struct("new"), seq).alias("__last"))
    before = lasts.withColumn("__before", F.lag("__last").over(Window.partitionBy(*key).orderBy("__b"))).drop("__last")
    joined = inner.join(before, [*key, "__b"]).withColumn("old", F.coalesce("__old", "__before")["new"])
    name = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "REMOVE").otherwise("MODIFY")
    return joined.where("old IS NOT NULL OR new IS NOT NULL").select(*key, seq, name.alias("event_name"), "old", "new")


def view(records: DataFrame, kind: str) -> DataFrame:
    """A stream view; the event name is chosen before images are hidden."""
    if kind not in VIEWS:
        raise StreamError(f"unknown view {kind}")
    return records.drop(*[c for c in ("old", "new") if c not in VIEWS[kind]])


def start_at(log: DataFrame, seq: str, kind: str, at: int | None = None) -> DataFrame:
    """TRIM_HORIZON, LATEST (nothing yet), AT_SEQUENCE_NUMBER, AFTER_SEQUENCE_NUMBER."""
    if kind == "TRIM_HORIZON":
        return log
    if kind == "LATEST":
        return log.limit(0)
    if kind not in ("AT_SEQUENCE_NUMBER", "AFTER_SEQUENCE_NUMBER") or at is None:
        raise StreamError(f"unknown iterator {kind}")
    return log.where(F.col(seq) >= at) if kind == "AT_SEQUENCE_NUMBER" else log.where(F.col(seq) > at)


def check_not_trimmed(horizon: int, at: int) -> None:
    if at < horizon:
        raise StreamError("the sequence number has been trimmed")


def records_page(log: DataFrame, lane: str, seq: str, position: dict, limit: int = STREAM_LIMIT) -> tuple[DataFrame, dict]:
    """The next rows of every lane after its position, at most ``limit`` a lane, and the new positions."""
    if not 1 <= limit <= SYSTEM_LIMIT:
        raise StreamError("the limit is out of range")
    at = F.coalesce(F.create_map(*[F.lit(x) for pair in position.items() for x in pair])[F.col(lane)], F.lit(-1)) if position else F.lit(-1)
    w = Window.partitionBy(lane).orderBy(seq)
    page = log.where(F.col(seq) > at).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
    ends = {r[0]: r[1] for r in page.groupBy(lane).agg(F.max(seq)).collect()}  # one row a lane
    return page, position | ends


def item_history(log: DataFrame, key: dict, seq: list[str], forward: bool = True, after: int | None = None) -> DataFrame:
    own = log
    for name, value in key.items():
        own = own.where(F.col(name) == F.lit(value))
    if after is not None:
        own = own.where(F.col(seq[0]) > after if forward else F.col(seq[0]) < after)
    return own.orderBy(*[F.col(s).asc() if forward else F.col(s).desc() for s in seq])


def change_markers(log: DataFrame, table: str, seq: str, slot: Column) -> DataFrame:
    """Per slot and table, the latest version."""
    return log.groupBy(slot.alias("slot"), table).agg(F.max(seq).alias("latest"))


def append_once(stream: DataFrame, batch: DataFrame, operation: str, seq: str) -> DataFrame:
    """Append rows whose operation id the stream has not seen, numbered on from its end in the order of the ids."""
    fresh = batch.dropDuplicates([operation]).join(stream.select(operation), operation, "left_anti")
    end = stream.agg(F.max(seq)).first()[0]  # one number
    # places, unlike ids by task, are the same however often and however dealt the rows are computed
    numbered = reads.places(fresh, [operation], "__place").withColumn(seq, F.lit(-1 if end is None else end) + F.col("__place"))
    return stream.unionByName(numbered.select(*stream.columns))


def advance(position: int | None, target: int, exists: bool) -> int:
    """A cursor moves forward to items that exist; to its own place is no move."""
    if not exists:
        raise StreamError("the target does not exist")
    if position is not None and target < position:
        raise StreamError("a cursor cannot move backward")
    return target


def read_cursor(stream: DataFrame, seq: str, position: int | None, limit: int) -> tuple[list, int | None]:
    """Up to ``limit`` rows after the position; the position moves to the last of them."""
    own = stream if position is None else stream.where(F.col(seq) > position)
    rows = own.orderBy(seq).limit(limit).collect()
    return rows, rows[-1][seq] if rows else position


def lineage_split(lanes: DataFrame, parent: str, at: int) -> DataFrame:
    """lanes (lane, parent, sealed, low, high of the routing range): the parent sealed and its two children; repeated calls change nothing."""
    if not lanes.where(F.col("parent") == parent).isEmpty():
        return lanes
    own = lanes.where((F.col("lane") == parent) & ~F.col("sealed"))
    child = lambda name, low, high: own.select(F.concat(F.col("lane"), F.lit(name)).alias("lane"), F.col("lane").alias("parent"), F.lit(False).alias("sealed"), low.alias("low"), high.alias("high"))
    sealed = lanes.withColumn("sealed", F.col("sealed") | (F.col("lane") == parent))
    return sealed.unionByName(child(".0", F.col("low"), F.lit(at).cast("long"))).unionByName(child(".1", F.lit(at).cast("long"), F.col("high")))


# -- replication --------------------------------------------------------------------------------

#: Baseline < mutation < expiration at the same clock; then origin, position, ordinal.
RANKS = {"BASELINE": 0, "MUTATION": 1, "EXPIRATION": 2}


def event_order(rank: Column) -> Column:
    """Order of replicated events: baselines first, then clock, origin, position, ordinal, rank."""
    return F.struct((rank > 0).cast("int").alias("mutated"), F.col("physical_ms"), F.col("logical"), F.col("origin"), F.col("position"), F.col("ordinal"), rank.alias("rank"))


def winners(events: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Last writer wins: the whole event with the greatest order for every key."""
    columns = [c for c in events.columns if c not in key]
    best = events.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("w"))
    return best.select(*key, "w.*")


def import_events(state: DataFrame, incoming: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The state after incoming events: an event replaces what it is strictly greater than."""
    both = state.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return winners(both, key, F.struct(order.alias("o"), (-F.col("__new")).alias("s"))).drop("__new")


def advance_clock(wall: int, persisted: tuple[int, int], observed: tuple[int, int] = (0, 0)) -> tuple[int, int]:
    """Hybrid clock: the greatest physical time, its logical part bumped unless the wall is ahead."""
    physical = max(wall, persisted[0], observed[0])
    logical = max([c[1] for c in (persisted, observed) if c[0] == physical], default=-1)
    return physical, logical + 1


# -- load control ---------------------------------------------------------------------------------


def pressure(samples: DataFrame, partition: str, at: str, load: str, capacity: float, *, queue: bool = False) -> DataFrame:
    """Pressure of partitions after each sample, streaks of high and low samples, and what they call for.

    A sample's ratio of load to capacity is smoothed (0.4 of the newest) over all samples; its
    distance from one adds up to an integral clamped to -2..4; pressure is the smoothed ratio and
    a fifth of the integral. Streaks count samples of at least 1 and of at most 0.35. Three high
    ones at a pressure of 1.3 SPLIT (a queue has a partition added at 1.2: ADD); twelve low ones
    at a pressure of at most 0.35 DRAIN.
    """
    # one pass over every partition's samples in order, a batch at a time: nothing is held but the last state
    ordered = samples.withColumn("__x", (F.col(load) / capacity).cast("double")).repartition(partition).sortWithinPartitions(partition, F.asc_nulls_last(at), "__x")
    kept = [partition, at, *[c for c in samples.columns if c not in (partition, at)]]
    schema = T.StructType([*[samples.schema[c] for c in kept], T.StructField("pressure", T.DoubleType()), T.StructField("high_streak", T.IntegerType()), T.StructField("low_streak", T.IntegerType())])

    def states(batches):
        import pyarrow as pa

        owner, e, i, h, low = [], 0.0, 0.0, 0, 0
        for batch in batches:
            found = ([], [], [])
            for p, x in zip(batch.column(partition).to_pylist(), batch.column("__x").to_pylist(), strict=True):
                if [p] != owner and not (owner and p != p and owner[0] != owner[0]):  # NaN is one partition
                    owner, e, i, h, low = [p], 0.0, 0.0, 0, 0
                # as in SQL: a null makes the smoothed ratio null, the clamp passes over nulls, NaN is the greatest
                e = None if x is None or e is None else x if e <= 0 else 0.4 * x + 0.6 * e
                i = 4.0 if e is None or not i + e - 1.0 < 4.0 else max(-2.0, i + e - 1.0)
                h = h + 1 if x is not None and not x < 1.0 else 0
                low = low + 1 if x is not None and x <= 0.35 else 0
                for column, value in zip(found, (None if e is None else e + 0.2 * i, h, low)):
                    column.append(value)
            own = [batch.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(found, (pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(own, [*kept, "pressure", "high_streak", "low_streak"])

    high = (F.col("high_streak") >= 3) & (F.col("pressure") >= (1.2 if queue else 1.3))
    low = (F.col("low_streak") >= 12) & (F.col("pressure") <= 0.35)
    return ordered.mapInArrow(states, schema).withColumn("action", F.when(high, "ADD" if queue else "SPLIT").when(low, "DRAIN").otherwise("KEEP"))
