"""Shared helpers: the cluster's shared folder, bounded Arrow batches, text rules.

Words everywhere are ``[^\\x20\\x09-\\x0D]+``: the bytes form ``bytes.split()`` splits
at exactly these six characters, unlike ``str.split()``.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 form of the word pattern of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="heddle-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder: a lost executor costs nothing upstream of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder, removed when it ends; ``result`` stays.

    A failed run leaves none of them either.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.kept:
            remove(self.spark, path)

    def keep(self, df: DataFrame, name: str, *, compression: str = "zstd") -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = next(p for own, p in self.kept if own is df)
        self.kept = [(own, p) for own, p in self.kept if p != path]
        remove(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return materialise(df, name)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of an Arrow batch between Spark and Python: whole texts are long, workers are small.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo: the folds of the contracts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
