"""Packing by power-of-two decomposition.

A document of n ids becomes n // 4096 pieces of 4096 and one piece for each set bit of
the rest, largest first. Each piece is a sequence of its own whose length is a power of
two, so sequences of equal length form buckets that batch without padding, and no
sequence crosses a document. No shuffle: every row is decomposed where it is read.

Null or empty text: only the end id, one piece of length 1. Repeated rows are packed
each, under their own sequence ids. Very long texts are whole: each of their pieces is a
row. An empty table gives no rows. Only the id and the text column are read, so other
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.word_ids import packed_ids

LIMIT_BITS = 12


def pieces(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    sequence_id: the bucket (log2 of the length) above a number unique among all pieces.
    """
    limit = 1 << LIMIT_BITS
    coded = docs.select(F.col(id_col).alias("doc_id"), packed_ids(F.col(text_col), tokenizer_file, end).alias("ids"))
    n = F.octet_length("ids") / 4
    sized = coded.withColumn("doc_tokens", n.cast("long"))
    whole = F.expr(f"IF(doc_tokens >= {limit}, transform(sequence(0L, shiftright(doc_tokens, {LIMIT_BITS}) - 1), k -> named_struct('start', k * {limit}, 'length', {limit}L)), array())")
    bits = ", ".join(str(b) for b in reversed(range(LIMIT_BITS)))
    # the bits above b of n are already cut off when the piece of bit b starts
    rest = F.expr(
        f"transform(filter(array({bits}), b -> (shiftright(doc_tokens, b) & 1L) = 1L), "
        "b -> named_struct('start', shiftleft(shiftright(doc_tokens, b + 1), b + 1), 'length', shiftleft(1L, b)))"
    )
    # each piece takes its own ids along, so that no row of a piece holds its whole document
    with_ids = "transform(cuts, p -> struct(p.start, p.length, substring(ids, CAST(p.start * 4 + 1 AS INT), CAST(p.length * 4 AS INT)) AS ids))"
    cut = sized.withColumn("cuts", F.concat(whole, rest)).select("doc_id", "doc_tokens", F.explode(F.expr(with_ids)).alias("p"))
    bucket = F.log2(F.col("p.length").cast("double")).cast("int").cast("long")
    return cut.select(
        "doc_id",
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.col("p.ids").alias("ids"),
        "doc_tokens",
        (F.shiftleft(bucket, 55) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet, one folder per sequence length."""
    packed.write.partitionBy("length").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
