"""Exact top-k by inner product with MaxScore over stored postings.

A signed dimension is a term. Candidates are cut into shards as they are read, and each
shard is stored once as a row: its vectors, and for every dimension the list of rows with
a positive and the list with a negative component. Queries are stored as blocks. Every
block meets every shard once, in tasks that hold one of each.

For a query, dimension d can add at most U_d = the largest q_d * x_d of the shard, if
positive. The non-essential dimensions are the longest run of smallest bounds whose sum
stays below the query's threshold: a row that gains nothing from an essential one cannot
reach it. The essential dimensions' lists of the sign that gains are traversed. For rows
that may still reach the threshold, what the essential dimensions take away follows, from the
lists of the other sign or, if few rows are left, by probing them; then the others are probed
in falling order of bound, while a row can reach it. The shards' best rows
are merged last.

Thresholds are the k-th best score in a bounded sample of candidates (``SAMPLE``), a lower
bound of the true one, which never changes the result. Scores are exact: integers of 64
bits where no sum can pass them, Python's integers elsewhere. A component of 2^63 or more,
or a returned score that needs more than 64 bits, is an error that says so.

Vectors that are null, or hold null, NaN or infinite components take no part, nor do rows
without an id. Vectors of other lengths count as padded with zeros; an empty one scores 0.
Rows repeated with the same id and vector are rows of their own: a query is only kept from
itself. An empty table or no query gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import Scratch

SHARD_ROWS, SHARD_VALUES = 8192, 1 << 20
BLOCK_ROWS, BLOCK_VALUES = 2048, 1 << 18
SAMPLE, SAMPLE_VALUES = 2048, 1 << 20
SHARDS_A_GROUP = 4
LOWEST = -(2**62)
HITS = {"block": pa.int64(), "i": pa.int32(), "query_id": pa.int64(), "times": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "same": pa.bool_(), "wide": pa.bool_()}


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), bad)


def floors(vector: Column, factor: int) -> Column:
    scaled = lambda x: F.when(F.abs(x * factor) < 2.0**63, F.floor(x * factor)).otherwise(F.raise_error(F.lit("a component needs more than 64 bits")).cast("long"))
    return F.transform(vector.cast("array<double>"), scaled)


def narrow(values: np.ndarray) -> np.ndarray:
    """The smallest signed type that holds the values."""
    most = max(int(values.max()), -int(values.min()) - 1) if len(values) else 0
    return values.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


@dataclass
class Vectors:
    """Row i holds values[ends[i-1]:ends[i]]."""

    ids: np.ndarray
    ends: np.ndarray
    values: np.ndarray

    def matrix(self, width: int) -> np.ndarray:
        sizes = np.diff(self.ends, prepend=0)
        out = np.zeros((len(self.ids), width), self.values.dtype)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(self.values)) - np.repeat(self.ends - sizes, sizes)
        kept = at < width
        out[row[kept], at[kept]] = self.values[kept]
        return out


def vectors_of(ids: pa.Array, lists: pa.Array) -> Vectors:
    if isinstance(lists, pa.ChunkedArray):
        lists, ids = lists.combine_chunks(), ids.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return Vectors(ids.to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64), lists.flatten().to_numpy(zero_copy_only=False))


def cut(batches: Iterator[pa.RecordBatch], rows: int, values: int) -> Iterator[pa.Table]:
    """The batches' rows in pieces of at most ``rows`` rows and about ``values`` values (one row at least)."""
    held: list[pa.RecordBatch] = []
    n = total = 0
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        start = 0
        for i, size in enumerate(sizes.tolist()):
            if n and (n == rows or total + size > values):
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, start, n, total = [], i, 0, 0
            n, total = n + 1, total + size
        held.append(batch.slice(start))
    if n:
        yield pa.Table.from_batches(held)


POSTED = "number long, kind string, ids binary, ends binary, vals binary, starts binary, rows binary, list_vals binary"


def posted(own: Vectors, number: int) -> dict:
    """A shard as a row: starts[2 d] and starts[2 d + 1] begin the lists of d's negative and positive components."""
    values = narrow(own.values)
    sizes = np.diff(own.ends, prepend=0)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    dim = np.arange(len(values)) - np.repeat(own.ends - sizes, sizes)
    entry = np.flatnonzero(values)
    term = dim[entry] * 2 + (values[entry] > 0)
    entry = entry[np.argsort(term, kind="stable")]
    width = int(sizes.max()) if len(sizes) else 0
    starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=2 * width))))
    parts = {"ids": own.ids.astype(np.int64), "ends": own.ends, "vals": values, "starts": starts.astype(np.int64), "rows": row[entry], "list_vals": values[entry]}
    return {"number": number, "kind": values.dtype.str} | {k: v.tobytes() for k, v in parts.items()}


class Shard:
    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.ends, self.starts, self.rows = read("ids", np.int64), read("ends", np.int64), read("starts", np.int64), read("rows", np.int32)
        self.values, self.posted = read("vals", row["kind"]).astype(np.int64), read("list_vals", row["kind"]).astype(np.int64)
        self.begin = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        self.width = (len(self.starts) - 1) // 2
        lists = [self.posted[a:b] for a, b in zip(self.starts, self.starts[1:], strict=False)]
        self.low = np.array([x.min() if len(x) else 0 for x in lists[::2]], np.int64)
        self.high = np.array([x.max() if len(x) else 0 for x in lists[1::2]], np.int64)
        self.most = np.maximum(self.high.astype(float), -self.low.astype(float))
        self.even = len(self.ids) * self.width == len(self.values) and self.width > 0

    def wide(self) -> Shard:
        """The same shard over Python's integers."""
        if self.values.dtype != object:
            self.values, self.posted, self.low, self.high = (x.astype(object) for x in (self.values, self.posted, self.low, self.high))
        return self

    def at(self, rows: np.ndarray, d: int) -> np.ndarray:
        """Component d of the rows; 0 beyond a row's end."""
        if self.even:  # all vectors have one length
            return self.values[rows * self.width + d]
        place = self.begin[rows] + d
        inside = place < self.ends[rows]
        out = self.values[np.where(inside, place, 0)] if len(self.values) else np.zeros(len(rows), np.int64)
        return np.where(inside, out, 0)


def search(shard: Shard, query_id: int, query: np.ndarray, theta: int, k: int) -> list[tuple[int, int, bool]]:
    """The shard's k best (score, id, whether it equals the query) of those that reach theta; more where they tie."""
    width = min(shard.width, len(query))
    if np.abs(query[:width].astype(float)) @ shard.most[:width] >= 2.0**61:
        shard = shard.wide()
    kind = shard.values.dtype
    q = query[:width].astype(kind)
    gain = np.maximum(np.maximum(q * shard.high[:width], q * shard.low[:width]), 0)
    order = np.argsort(gain, kind="stable")
    reach = np.cumsum(gain[order])
    split = int(np.searchsorted(reach, theta)) if theta > 0 else 0  # bounds that sum to less than theta
    rest = int(reach[split - 1]) if split else 0
    essential, others = [d for d in order[split:].tolist() if q[d]], [d for d in order[:split][::-1].tolist() if q[d]]
    score = np.zeros(len(shard.ids), kind)

    def traverse(d: int, sign: int) -> None:
        a, b = shard.starts[2 * d + sign], shard.starts[2 * d + sign + 1]
        score[shard.rows[a:b]] += shard.posted[a:b] * q[d]

    for d in essential:
        traverse(d, int(q[d] > 0))
    alive = np.flatnonzero((score > 0) & (score + rest >= theta)) if theta > 0 else np.arange(len(shard.ids))
    many = 8 * len(alive) > len(shard.ids)
    if many:  # the lists of the other sign cost less than probing so many rows
        for d in essential:
            traverse(d, int(q[d] < 0))
        alive = alive[score[alive] + rest >= theta]
    part = score[alive]
    for d in [] if many else essential:  # what the lists of the other sign take away
        if not len(alive):
            break
        part = part + np.minimum(shard.at(alive, d) * q[d], 0)
        on = part + rest >= theta
        if not on.all():
            alive, part = alive[on], part[on]
    for d in others:
        if not len(alive):
            break
        part = part + shard.at(alive, d) * q[d]
        rest -= int(gain[d])
        on = part + rest >= theta
        if not on.all():
            alive, part = alive[on], part[on]
    on = part >= theta
    alive, part = alive[on], part[on]
    if len(alive) > k:  # all rows tied with the k-th stay until ids decide
        bar = np.sort(part)[len(part) - k]
        on = part >= bar
        alive, part = alive[on], part[on]
    best = sorted(zip((-part).tolist(), shard.ids[alive].tolist(), alive.tolist(), strict=True))[:k]
    out = []
    for s, i, row in best:
        own = shard.values[shard.begin[row] : shard.ends[row]]
        out.append((-s, i, i == query_id and len(own) == len(query) and bool((own == query).all())))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best other rows, ties to the smaller id."""
    with Scratch(vectors.sparkSession) as scratch:
        rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), floors(F.col(vector_col), factor).alias("v"), is_query.alias("q"))

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, piece in enumerate(cut(batches, SHARD_ROWS, SHARD_VALUES)):
                yield pa.RecordBatch.from_pylist([posted(vectors_of(piece.column(0), piece.column(1)), TaskContext.get().partitionId() << 32 | i)], schema=shard_schema)

        binary = pa.binary()
        shard_schema = pa.schema([("number", pa.int64()), ("kind", pa.string()), *[(n, binary) for n in ("ids", "ends", "vals", "starts", "rows", "list_vals")]])
        stored = scratch.keep(rows.select("vec_id", "v").mapInArrow(shards, POSTED), "postings")

        sample = rows.select("vec_id", "v").limit(SAMPLE).toArrow()
        some = next(cut(iter(sample.to_batches()), SAMPLE, SAMPLE_VALUES), None)
        sampled = vectors_of(some.column(0), some.column(1)) if some is not None else None

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, piece in enumerate(cut(batches, BLOCK_ROWS, BLOCK_VALUES)):
                own = vectors_of(piece.column(0), piece.column(1))
                floor = thresholds(own, sampled, k)
                row = {"block": TaskContext.get().partitionId() << 32 | i, "q_ids": own.ids.tobytes(), "q_ends": own.ends.tobytes(), "q_vals": own.values.tobytes(), "q_times": piece.column(2).to_numpy().tobytes(), "q_floor": floor.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), *[(n, binary) for n in ("q_ids", "q_ends", "q_vals", "q_times", "q_floor")]]))

        wanted = rows.where("q").groupBy("vec_id", "v").agg(F.count("*").alias("times"))
        asked = scratch.keep(wanted.mapInArrow(blocks, "block long, q_ids binary, q_ends binary, q_vals binary, q_times binary, q_floor binary"), "queries")

        groups = max(1, stored.count() // SHARDS_A_GROUP)
        # every block goes to every group of shards: the stated query set against all rows, in blocks
        dealt = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        pairs = stored.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups))).join(dealt, "g").drop("g")

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in (r for one in range(batch.num_rows) for r in batch.slice(one, 1).to_pylist()):
                    shard = Shard(row)
                    ids, times, floor = (np.frombuffer(row[n], np.int64) for n in ("q_ids", "q_times", "q_floor"))
                    queries = np.split(np.frombuffer(row["q_vals"], np.int64), np.frombuffer(row["q_ends"], np.int64)[:-1])
                    out: list[list] = [[] for _ in HITS]
                    for i, (q, v) in enumerate(zip(ids.tolist(), queries, strict=True)):
                        for s, vec, same in search(shard, q, v, int(floor[i]), k + 1):  # the query itself may be among them
                            held = min(max(s, -(2**63)), 2**63 - 1)
                            for column, value in zip(out, (row["block"], i, q, int(times[i]), vec, held, same, held != s), strict=True):
                                column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, HITS.values(), strict=True)], list(HITS))

        hits = pairs.mapInArrow(found, "block long, i int, query_id long, times long, vec_id long, score long, same boolean, wide boolean")
        own = Window.partitionBy("block", "i", "same").orderBy(F.desc("score"), "vec_id")
        others = hits.withColumn("n", F.row_number().over(own)).where(~F.col("same") | (F.col("n") > 1))
        ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        result = ranked.select(F.explode(F.sequence(F.lit(1).cast("long"), "times")), "query_id", "rank", "vec_id", F.when(F.col("wide"), F.raise_error(F.lit("a score needs more than 64 bits"))).otherwise(F.col("score")).alias("score")).drop("col")
        return scratch.result(result, "top")


def thresholds(queries: Vectors, sampled: Vectors | None, k: int) -> np.ndarray:
    """A lower bound of every query's k-th best score: k others at least reach the (k+1)-th best of any sample."""
    floor = np.full(len(queries.ids), LOWEST, np.int64)
    if sampled is None or len(sampled.ids) <= k or not len(sampled.values) or not len(queries.values):
        return floor
    width = int(np.diff(sampled.ends, prepend=0).max())
    x, q = sampled.matrix(width).astype(float), queries.matrix(width).astype(float)
    if np.abs(x).max() * np.abs(q).max() * width < 2**53:  # sums of doubles are exact
        at = len(sampled.ids) - k - 1
        for start in range(0, len(q), 256):
            floor[start : start + 256] = np.partition(q[start : start + 256] @ x.T, at, axis=1)[:, at]
    return floor
