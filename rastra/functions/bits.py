"""Whole numbers in binary columns, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, at: Column | int) -> Column:
    """The unsigned byte at a 0-based place; null beyond the end."""
    one = F.substring(data, (at if isinstance(at, Column) else F.lit(at)).cast("int") + 1, F.lit(1))
    return F.conv(F.nullif(F.hex(one), F.lit("")), 16, 10).cast("long")


def le_uint(data: Column, at: Column | int, size: int) -> Column:
    """The little-endian unsigned number of ``size`` bytes (at most 7) at a 0-based place; null if any byte is missing."""
    total = byte_at(data, at)
    for i in range(1, size):
        total = total + F.shiftleft(byte_at(data, at + i), 8 * i)
    return total


def be_uint(data: Column, at: Column | int, size: int) -> Column:
    """The big-endian unsigned number of ``size`` bytes (at most 7)."""
    total = F.shiftleft(byte_at(data, at), 8 * (size - 1))
    for i in range(1, size):
        total = total + F.shiftleft(byte_at(data, at + i), 8 * (size - 1 - i))
    return total


def le_bytes(n: Column, size: int) -> Column:
    """A number as ``size`` little-endian bytes."""
    parts = [F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)]
    return F.unhex(F.concat(*parts))


def ascii_text(data: Column) -> Column:
    """Bytes as text, one character for each."""
    return F.decode(data, "ISO-8859-1")


def bit(n: Column, mask: int) -> Column:
    """Whether any bit of the mask is set."""
    return n.bitwiseAND(F.lit(mask)) != 0
