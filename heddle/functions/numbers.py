"""Item numbers: decimal text of up to 38 significant digits, adjusted exponent -130..125.

``canonical`` and ``sort_key`` work on text of any size; ``sort_key_column`` orders a column
of such text as bytes. Columns that fit DECIMAL or DOUBLE should stay typed instead.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAMMAR = re.compile(r"([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?")
MAX_DIGITS, LOWEST, HIGHEST = 38, -130, 125
KEY_BYTES = 41


class NumberError(ValueError):
    pass


def parts(text: str, lowest: int = LOWEST, highest: int = HIGHEST) -> tuple[int, str, int]:
    """(sign, significant digits, adjusted exponent); zero is (0, "", 0)."""
    match = GRAMMAR.fullmatch(text)
    if not match or not (match[2] or match[3]):
        raise NumberError(f"not a number: {text!r}")
    whole, fraction = match[2], match[3] or ""
    exponent = int(match[4] or 0) - len(fraction)
    digits = (whole + fraction).lstrip("0")
    trimmed = digits.rstrip("0")
    exponent += len(digits) - len(trimmed)
    if not trimmed:
        return 0, "", 0
    if len(trimmed) > MAX_DIGITS:
        raise NumberError("more than 38 significant digits")
    adjusted = exponent + len(trimmed) - 1
    if not lowest <= adjusted <= highest:
        raise NumberError("exponent out of range")
    return (-1 if match[1] == "-" else 1), trimmed, adjusted


def canonical(text: str, lowest: int = LOWEST, highest: int = HIGHEST) -> str:
    """Plain decimal notation without needless zeros, sign or exponent."""
    sign, digits, adjusted = parts(text, lowest, highest)
    if not sign:
        return "0"
    if adjusted >= len(digits) - 1:
        body = digits + "0" * (adjusted - len(digits) + 1)
    elif adjusted >= 0:
        body = f"{digits[: adjusted + 1]}.{digits[adjusted + 1 :]}"
    else:
        body = "0." + "0" * (-adjusted - 1) + digits
    return "-" + body if sign < 0 else body


def sort_key(text: str) -> bytes:
    """41 bytes whose order is the numbers' order."""
    sign, digits, adjusted = parts(text)
    if not sign:
        return b"\x01" + bytes(KEY_BYTES - 1)
    body = (adjusted + 1000).to_bytes(2, "big") + digits.ljust(MAX_DIGITS, "0").encode()
    return b"\x02" + body if sign > 0 else b"\x00" + bytes(255 - b for b in body)


def from_sort_key(key: bytes) -> str:
    if key[0] == 1:
        return "0"
    body = key[1:] if key[0] == 2 else bytes(255 - b for b in key[1:])
    adjusted, digits = int.from_bytes(body[:2], "big") - 1000, body[2:].decode()
    return canonical(f"{'-' if key[0] == 0 else ''}{digits[0]}.{digits[1:]}e{adjusted}")


def size(text: str) -> int:
    sign, digits, _ = parts(text)
    return (max(1, len(digits)) + 1) // 2 + 1 + (sign < 0)


def add(a: str, b: str, minus: bool = False) -> str:
    """Exact a + b (a - b); a result beyond 38 digits or the exponent range is an error."""
    from decimal import Context, Decimal, Inexact

    exact = Context(prec=400)
    total = exact.subtract(Decimal(a), Decimal(b)) if minus else exact.add(Decimal(a), Decimal(b))
    del Inexact
    return canonical(format(total, "f"))


def less(a: str, b: str) -> bool:
    return sort_key(a) < sort_key(b)


def canonical_column(text: Column) -> Column:
    """Canonical text; null where the text is no item number."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _quiet(canonical, v))

    return convert(text)


def sort_key_column(text: Column) -> Column:
    @F.pandas_udf("binary")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _quiet(sort_key, v))

    return convert(text)


def _quiet(function, value):
    try:
        return function(value) if value is not None else None
    except NumberError:
        return None
