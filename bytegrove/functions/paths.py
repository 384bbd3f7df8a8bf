"""Names and extensions of paths, by bytes.

Every match is on bytes. A path is seen as the string whose characters are its bytes (ISO 8859-1),
so a pattern in UTF-8 compares as its own bytes and nothing but A-Z folds.
"""

from __future__ import annotations

import os
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_view(path: Column, raw: Column | None = None) -> Column:
    """A path's bytes as characters; ``raw`` holds them where the path isn't UTF-8."""
    data = F.encode(path, "UTF-8") if raw is None else F.coalesce(raw, F.encode(path, "UTF-8"))
    return F.decode(data, "ISO-8859-1")


def pattern_view(pattern: str | bytes) -> str:
    return (pattern.encode() if isinstance(pattern, str) else pattern).decode("latin-1")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; lower() would fold other letters, too."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold_pattern(pattern: str | bytes) -> str:
    """A pattern's byte view, folded like ascii_lower()."""
    return pattern_view(pattern).translate({ord(a): ord(b) for a, b in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)})


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash; all of a path without either."""
    return F.regexp_replace(path, r"(?s)^.*[/\\]", "")


def extension(name: Column) -> Column:
    """What follows the last dot; empty without one."""
    return F.when(F.instr(name, ".") == 0, "").otherwise(F.substring_index(name, ".", -1))


def path_columns(path: str | bytes | os.PathLike) -> tuple[str, bytes | None]:
    """Printable path, and the bytes themselves where they aren't UTF-8."""
    data = os.fsencode(path)
    try:
        return data.decode(), None
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace"), data


def is_lossless(raw: Column) -> Column:
    return raw.isNull()
