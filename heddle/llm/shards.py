"""Training-order shards: token sequences at the places a keyed permutation gives them.

All documents form one stream of token ids (each document ends with the end id): they are
dealt to PARTS parts by a hash of doc_id and text, and lie in order of doc_id in each, so the
stream depends neither on how the input is stored nor on ``partitions``, which only deals out work. Sequence j is the stream's ids [j * S, (j + 1) * S). A keyed Feistel network
over the smallest a x b grid that holds n sequences, walked until it falls below n, maps
j to its global slot, without any table of the permutation. Shard k holds the slots
[k * R, (k + 1) * R): records of a fixed stride (S uint16 ids, then one newline byte), so
slot s is read at byte (s mod R) * stride of shard s div R, and a reader resumes from a
slot number alone. The last sequence is padded with the end id; the manifest has its true
length.

Spark's text writer puts the shards into the shared store, so a lost executor only repeats
its own files and a shard appears whole or not at all. ``write`` with ``resume=True``
leaves shards of the right size as they are and writes the others from the tokenised
table in the same folder; other arguments than the stored manifest's are an error. Only a
resumed run lists the shards on the driver (a few dozen bytes each).

Null and empty texts are one end id. Null doc_ids come first in a part; rows with the same
doc_id and text are interchangeable. Very long texts are cut like all others; other columns
are not read, whatever their names. An empty table has no shards. Ids must be below 65536.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import new_path, remove
from heddle.llm.word_ids import pack

ROUNDS = 6
#: Parts of the stream, several a task to even out their sizes. Another number makes another order.
PARTS = 2048


class Permutation:
    """A permutation of 0..n-1: a Feistel network over Z_a x Z_b, with cycle-walking."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.a = max(1, int(np.ceil(np.sqrt(n))))
        self.b = max(1, -(-n // self.a))
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        x = (x.astype(np.uint64) + self.keys[r]) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = ((left.astype(np.uint64) + self._round(right, r) % np.uint64(self.a)) % np.uint64(self.a)).astype(np.int64)
            else:
                right = ((right.astype(np.uint64) + self._round(left, r) % np.uint64(self.b)) % np.uint64(self.b)).astype(np.int64)
        return left * self.b + right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x, np.int64))
        while (high := out >= self.n).any():  # ends: the walk returns to its start, which is below n
            out[high] = self._once(out[high])
        return out


def tokenised(docs: DataFrame, tokenizer_file: str, end: int, *, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """part, start (ids before the row in its part), ids (uint16): the stream, cut by a hash of doc_id and text."""

    @F.arrow_udf("binary")
    def coded(texts: pa.Array) -> pa.Array:
        out = []
        for data in pack(texts, tokenizer_file, end):
            ids = np.frombuffer(data, "<u4")
            if len(ids) and ids.max() >= 65536:
                raise ValueError("token ids beyond uint16")
            out.append(ids.astype("<u2").tobytes())
        return pa.array(out, pa.binary())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            parts = batch.column(0).to_numpy()
            sizes = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            before = np.cumsum(sizes) - sizes
            first = np.flatnonzero(np.diff(parts, prepend=-1 if last is None else last))  # rows that begin a part
            offset = np.zeros(len(parts), np.int64)
            offset[:] = total
            for k in first:
                offset[k:] = -before[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before + offset), batch.column(3)], ["part", "start", "ids"])
            if len(parts):
                last, total = parts[-1], int(before[-1] + offset[-1] + sizes[-1])

    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), coded(F.col(text_col)).alias("ids"))
    dealt = own.withColumn("part", F.pmod(F.xxhash64("id", "tie"), F.lit(PARTS)).cast("int")).select("part", "id", "tie", "ids")
    return dealt.repartition(partitions, "part").sortWithinPartitions("part", "id", "tie").mapInArrow(number, "part int, start long, ids binary")


def pieces(stream: DataFrame, offsets: dict[int, int], total: int, key: str, length: int, per_shard: int) -> DataFrame:
    """shard, slot, at (first id's place in the sequence), ids (zstd): every document cut at sequence edges."""
    permutation = Permutation(-(-total // length), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress  # the shuffle's own compression is weak on ids
        for batch in batches:
            part, start, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // 2
            first = start + np.array([offsets[p] for p in part.tolist()], np.int64)
            low, high = first // length, (first + np.maximum(sizes, 1) - 1) // length
            counts = np.where(sizes > 0, high - low + 1, 0)
            row = np.repeat(np.arange(len(data)), counts)
            sequence = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            a = np.maximum(first[row], sequence * length)
            b = np.minimum(first[row] + sizes[row], (sequence + 1) * length)
            slot = permutation(sequence) if len(sequence) else sequence
            cut = [squeeze(data[r][x:y]) for r, x, y in zip(row.tolist(), ((a - first[row]) * 2).tolist(), ((b - first[row]) * 2).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), pa.array((a - sequence * length).astype(np.int32)), pa.array(cut, pa.binary())], ["shard", "slot", "at", "ids"])

    return stream.mapInArrow(run, "shard long, slot long, at int, ids binary")


def records(cut: DataFrame, shards: int, length: int, end: int, partitions: int) -> DataFrame:
    """shard, value: the records of each shard, in slot order; a task has a range of whole shards."""
    tasks = max(1, min(partitions, shards))
    own = F.floor(F.col("shard") * tasks / shards).cast("int")
    ordered = cut.repartitionById(tasks, own).sortWithinPartitions("shard", "slot", "at")
    filler = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slot, held = None, None, []
        restore = zstandard.ZstdDecompressor().decompress

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "value"])

        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for k, s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != slot and held:
                    done.append((shard, _padded(b"".join(held), length, filler)))
                    held = []
                    if len(done) >= 512:
                        yield out(done)
                        done = []
                shard, slot = k, s
                held.append(restore(data))
        if held:
            done.append((shard, _padded(b"".join(held), length, filler)))
        if done:
            yield out(done)

    return ordered.mapInArrow(run, "shard long, value binary")


def _padded(data: bytes, length: int, filler: bytes) -> bytes:
    return data + filler * (length - len(data) // 2)


def _sizes(spark: SparkSession, folder: str) -> dict[int, list[tuple[str, int]]]:
    """The shard files in a folder, by shard."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[tuple[str, int]]] = {}
    if fs.exists(root):
        files = fs.listFiles(root, True)
        while files.hasNext():
            f = files.next()
            path = f.getPath().toString()
            if "/shard=" in path and "/_temporary/" not in path and f.getPath().getName().startswith("part-"):
                found.setdefault(int(path.split("/shard=")[1].split("/")[0]), []).append((path, f.getLen()))
    return found


def write(
    docs: DataFrame, folder: str, tokenizer_file: str, *, key: str = "epoch-0", length: int = 2048, per_shard: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, resume: bool = False,
) -> dict:
    """Write the shards of one epoch below folder; returns the manifest (also kept as manifest/ there)."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))  # tasks, not the order
    table, shards = f"{folder}/tokenised", f"{folder}/shards"
    if not resume:
        tokenised(docs, tokenizer_file, end, id_col=id_col, text_col=text_col, partitions=partitions).write.option("compression", "zstd").parquet(table)
    stream = spark.read.schema("part int, start long, ids binary").parquet(table)
    ends = stream.groupBy("part").agg(F.max(F.col("start") + F.octet_length("ids") / 2).cast("long").alias("n")).orderBy("part").collect()  # a row per part
    offsets, total = {}, 0
    for part, n in ends:
        offsets[part] = total
        total += n
    sequences = -(-total // length)
    manifest = {"key": key, "length": length, "per_shard": per_shard, "end": end, "tokens": total, "sequences": sequences, "parts": PARTS, "stride": 2 * length + 1, "shards": -(-sequences // per_shard)}
    missing: set[int] | None = None  # None: all
    if resume:
        stored = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
        if stored != manifest:
            raise ValueError(f"the folder holds shards of another manifest: {stored}")
        found = _sizes(spark, shards)
        missing = {k for k in range(manifest["shards"]) if [s for _, s in found.get(k, [])] != [min(per_shard, sequences - k * per_shard) * manifest["stride"]]}
        for k in found.keys() & missing:
            remove(spark, f"{shards}/shard={k}")
    else:  # before the shards, so that a run that stops can be resumed
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(f"{folder}/manifest")
    if sequences and missing != set():
        cut = pieces(stream, offsets, total, key, length, per_shard)
        if missing is not None:
            cut = cut.join(spark.createDataFrame([(k,) for k in sorted(missing)], "shard long"), "shard", "left_semi")
        # the text writer copies the bytes as they are and ends every record with one newline byte
        rows = records(cut, manifest["shards"], length, end, partitions).select("shard", F.col("value").cast("string").alias("value"))
        rows.write.mode("append").partitionBy("shard").text(shards)
    return manifest


def read(spark: SparkSession, folder: str, manifest: dict, first: int = 0) -> DataFrame:
    """slot, ids (binary uint16 of the sequence), from slot ``first`` on, read from the shard files."""
    stride, length, per_shard = manifest["stride"], manifest["length"], manifest["per_shard"]
    if not manifest["sequences"]:
        return spark.createDataFrame([], "slot long, ids binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long")
    chosen = files.select(shard.alias("shard"), "content").where(F.col("shard") >= first // per_shard)
    each = chosen.select("shard", "content", F.explode(F.sequence(F.lit(0), (F.octet_length("content") / stride).cast("int") - 1)).alias("k"))
    slot: Column = F.col("shard") * per_shard + F.col("k")
    return each.select(slot.alias("slot"), F.expr(f"substring(content, k * {stride} + 1, {2 * length})").alias("ids")).where(F.col("slot") >= first)


def materialise_order(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """slot, sequence's ids as read back from shards written to the shared folder."""
    spark = docs.sparkSession
    folder = new_path(spark, "shards")
    manifest = write(docs, folder, tokenizer_file, **options)
    return read(spark, folder, manifest)

