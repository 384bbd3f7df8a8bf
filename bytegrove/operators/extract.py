"""Extractors as expressions: entries of a content, and the content of an entry.

Entries are announced first, with a path and a size that the filter sees; only what passes is
extracted. The two are separate expressions, so bytes are made above the filter, never below it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identify import Content

ENTRIES = "array<struct<path:string,size:bigint,skip_filter:boolean,locator:string>>"


@dataclass(frozen=True)
class Extraction:
    """What part of the parent to look at; the whole of it unless a request said otherwise."""

    offset: Column
    length: Column
    params: Column


class Extractor(Protocol):
    def entries(self, c: Content, x: Extraction) -> Column:
        """ENTRIES in order; NULL or empty for none."""

    def extract(self, c: Content, x: Extraction, entry: Column) -> Column:
        """content() of an entry; NULL drops the entry."""


def entry(path: Column, size: Column, locator: Column | None = None, skip_filter: bool = False) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(path.alias("path"), size.cast("long").alias("size"), F.lit(skip_filter).alias("skip_filter"), (none if locator is None else locator.cast("string")).alias("locator"))


def content(data: Column, path: Column, pinned_type: str | None = None) -> Column:
    return F.struct(data.alias("content"), path.alias("path"), F.lit(pinned_type).cast("string").alias("pinned_type"))
