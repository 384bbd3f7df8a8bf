"""Sets of byte patterns as Column expressions.

A few patterns become a CASE, longest first; more become an array probed by length, so plans stay
small. Where a pattern occurs twice, the first one registered wins if all patterns have two to four
bytes and are fewer than sixteen, else the last one.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns in a CASE, at most.
CASE_LIMIT = 16


class Patterns:
    """(pattern's byte view, value) pairs in registration order."""

    def __init__(self, pairs: Sequence[tuple[str, str]]):
        short = len(pairs) < CASE_LIMIT and all(2 <= len(p) <= 4 for p, _ in pairs)
        keep: dict[str, str] = {}
        for pattern, value in pairs:
            if not (short and pattern in keep):
                keep[pattern] = value
        self.values = dict(sorted(keep.items(), key=lambda p: -len(p[0])))

    def __bool__(self) -> bool:
        return bool(self.values)

    def longest_prefix(self, text: Column) -> Column:
        """Value of the longest pattern that the text starts with; NULL for empty text."""
        none = F.lit(None).cast("string")
        if not self.values:
            return none
        if len(self.values) <= CASE_LIMIT:
            out = none
            for pattern, value in reversed(self.values.items()):
                out = F.when(text.startswith(pattern) if pattern else F.lit(True), value).otherwise(out)
            found = out
        else:
            lengths = sorted({len(p) for p in self.values}, reverse=True)
            table = self._map()
            found = F.coalesce(*[table[F.substring(text, 1, n)] if n else table[F.lit("")] for n in lengths])
        return F.when(F.length(text) > 0, found)

    def exact(self, text: Column, trie_prefix: bool = False) -> Column:
        """Value of the pattern that equals the text; NULL for empty text.

        ``trie_prefix`` also lets a text that begins some longer pattern match as its own longest
        pattern, as a walk over a prefix tree that ends inside a word would.
        """
        if not self.values:
            return F.lit(None).cast("string")
        found = self._map()[text]
        if trie_prefix:
            inside = F.exists(F.array(*map(F.lit, self.values)), lambda p: p.startswith(text))
            found = F.coalesce(found, F.when(inside, self.longest_prefix(text)))
        return F.when(F.length(text) > 0, found)

    def _map(self) -> Column:
        return F.create_map(*map(F.lit, chain.from_iterable(self.values.items())))
