"""Hashes that route, index and check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def routing_hash(key: Column) -> Column:
    """Top 64 bits of SHA-256 of the key's text, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def partition_of(key: Column, partitions: int) -> Column:
    """Equal ranges of the routing hash: range i holds hashes in [i, i + 1) * 2^64 / partitions."""
    top = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.shiftright(top * partitions, 32).cast("int")


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for byte in text.encode():
        h = (h ^ byte) * 0x01000193 % 2**32
    return h


def change_slot(table: str) -> int:
    return fnv1a(table) % 256


def change_slot_column(table: Column) -> Column:
    """change_slot of a text column."""
    data, n = table.cast("binary"), F.octet_length(table)
    byte = lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0x811C9DC5).cast("long"), lambda h, i: h.bitwiseXOR(byte(i)) * 0x01000193 % 2**32) % 256


def body_digest(body: Column) -> Column:
    return F.md5(body.cast("binary"))


def prefix_upper_bound(prefix: str) -> str | None:
    """The least string above every string with the prefix, None if there is none."""
    points = [ord(c) for c in prefix]
    while points:
        last = points.pop() + 1
        if last == 0xD800:
            last = 0xE000
        if last <= 0x10FFFF:
            return "".join(map(chr, points)) + chr(last)
    return None


def prefix_upper_bytes(prefix: bytes) -> bytes | None:
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None
