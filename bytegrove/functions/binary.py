"""Reading bytes of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read(content: Column, size: Column, offset: Column, count: Column) -> Column:
    """Bytes from an offset, fewer at the end; empty exactly there, NULL past it."""
    return F.when(offset <= size, F.substring(content, (offset + 1).cast("int"), count.cast("int")))


def text_view(content: Column) -> Column:
    """Bytes as characters one for one, so places in it are byte offsets."""
    return F.decode(content, "ISO-8859-1")


def starts_with(content: Column, pattern: bytes) -> Column:
    return F.substring(content, 1, len(pattern)) == F.lit(pattern)


def _uint(content: Column, places: list[int]) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(content, p + 1, 1)) for p in places]), 16, 10).cast("long")


def uint_be(content: Column, offset: int, width: int) -> Column:
    """Unsigned big-endian number."""
    return F.conv(F.hex(F.substring(content, offset + 1, width)), 16, 10).cast("long")


def uint_le(content: Column, offset: int, width: int) -> Column:
    """Unsigned little-endian number."""
    return _uint(content, [offset + width - 1 - i for i in range(width)])
