"""What a content is: pinned type, magic bytes, file name, extension, or a test of its own.

The longest matching magic is the only magic candidate; a candidate that its identifier's test
rejects gives way to the file name's, then the extension's, then to identifiers without a prefilter
in registration order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binary import text_view
from ..functions.matcher import Patterns
from ..functions.paths import ascii_lower, byte_view, extension, file_name, fold_pattern, pattern_view

#: Bytes of a content that magic patterns may look at.
MAGIC_WINDOW = 16


@dataclass(frozen=True)
class Content:
    """Columns of one content as plugins see them."""

    path: Column
    path_raw: Column
    size: Column
    content: Column
    pinned_type: Column
    type: Column
    is_folder: Column
    depth: Column

    @classmethod
    def of(cls) -> Content:
        return cls(*[F.col(c) for c in cls.__dataclass_fields__])


Validator = Callable[[Content], Column]


@dataclass(frozen=True)
class Identifier:
    """A type with its prefilter (at most one kind) and its test (none: any candidate will do)."""

    type: str
    magic: Sequence[bytes] = ()
    extensions: Sequence[str] = ()
    names: Sequence[str] = ()
    validate: Validator | None = None

    def __post_init__(self) -> None:
        if sum(map(bool, (self.magic, self.extensions, self.names))) > 1:
            raise ValueError(f"identifier of {self.type}: one kind of prefilter at most")
        for m in self.magic:
            if len(m) > MAGIC_WINDOW:
                raise ValueError(f"identifier of {self.type}: a magic must be at most {MAGIC_WINDOW} bytes")


class IdentifierSet:
    def __init__(self, identifiers: Sequence[Identifier], trie_prefix: bool = False):
        seen: set[str] = set()
        for i in identifiers:
            if i.type in seen:
                raise ValueError(f"two identifiers for type {i.type}")
            seen.add(i.type)
        self.identifiers, self.trie_prefix = list(identifiers), trie_prefix
        self.magic = Patterns([(pattern_view(m), i.type) for i in identifiers for m in i.magic])
        self.extensions = Patterns([(fold_pattern(e), i.type) for i in identifiers for e in i.extensions])
        self.names = Patterns([(fold_pattern(n), i.type) for i in identifiers for n in i.names])

    def _confirmed(self, candidate: Column, c: Content, kind: Callable[[Identifier], object]) -> Column:
        """The candidate type if its identifier's test holds."""
        ok = F.lit(True)
        for i in self.identifiers:
            if i.validate is not None and kind(i):
                ok = F.when(candidate == i.type, F.coalesce(i.validate(c), F.lit(False))).otherwise(ok)
        return F.when(ok, candidate)

    @staticmethod
    def keys(c: Content) -> dict[str, Column]:
        """Folded name and extension, as columns of their own: they are used more than once."""
        name = ascii_lower(file_name(byte_view(c.path, c.path_raw)))
        return {"name_key": name, "ext_key": extension(name)}

    def resolve(self, c: Content) -> Column:
        """struct<type, type_source> from a content and its keys(); both NULL if nothing identifies it."""
        name, ext = F.col("name_key"), F.col("ext_key")
        head = text_view(F.substring(c.content, 1, MAGIC_WINDOW))
        found = [(c.pinned_type, "pinned")]
        if self.magic:
            found.append((self._confirmed(self.magic.longest_prefix(head), c, lambda i: i.magic), "magic"))
        if self.names:
            found.append((self._confirmed(self.names.exact(name, self.trie_prefix), c, lambda i: i.names), "name"))
        if self.extensions:
            found.append((self._confirmed(self.extensions.exact(ext, self.trie_prefix), c, lambda i: i.extensions), "extension"))
        for i in self.identifiers:
            if not (i.magic or i.extensions or i.names):
                ok = F.lit(True) if i.validate is None else i.validate(c)
                found.append((F.when(ok, i.type), "validate"))
        return F.coalesce(*[F.when(t.isNotNull(), F.struct(t.alias("type"), F.lit(s).alias("type_source"))) for t, s in found], F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("type_source")))
