"""Ordered include and exclude rules over entries' paths and sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import ascii_lower, byte_view, extension, file_name, fold_pattern


class Precedence(IntEnum):
    LOWEST = 0
    LOW = 1
    MEDIUM = 2
    HIGH = 3
    HIGHEST = 4


Rule = Callable[[Column, Column, Column, Column], Column]  # extension, name, path, size


class Filter:
    """The first rule that matches decides, else the default does."""

    def __init__(self, rules: list[tuple[Rule, bool]], default: bool):
        self.rules, self.default = rules, default

    def passes(self, path: Column, size: Column, raw: Column | None = None) -> Column:
        name = file_name(byte_view(path, raw))
        ext, name = ascii_lower(extension(name)), ascii_lower(name)
        out = F.lit(self.default)
        for rule, verdict in reversed(self.rules):
            out = F.when(rule(ext, name, path, size), verdict).otherwise(out)
        return out


class FilterBuilder:
    """Rules run by falling precedence, within one in the order they were added."""

    def __init__(self) -> None:
        self._rules: list[tuple[Precedence, Rule, bool]] = []

    def _names(self, precedence: Precedence, names: Iterable[str], verdict: bool, which: int) -> FilterBuilder:
        folded = [fold_pattern(n) for n in names if n]
        if folded:
            self._rules.append((Precedence(precedence), lambda *c: c[which].isin(*folded), verdict))
        return self

    def include_extensions(self, precedence: Precedence, names: Iterable[str]) -> FilterBuilder:
        return self._names(precedence, names, True, 0)

    def exclude_extensions(self, precedence: Precedence, names: Iterable[str]) -> FilterBuilder:
        return self._names(precedence, names, False, 0)

    def include_file_names(self, precedence: Precedence, names: Iterable[str]) -> FilterBuilder:
        return self._names(precedence, names, True, 1)

    def exclude_file_names(self, precedence: Precedence, names: Iterable[str]) -> FilterBuilder:
        return self._names(precedence, names, False, 1)

    def include(self, precedence: Precedence, test: Callable[[Column, Column], Column]) -> FilterBuilder:
        """Allow what ``test(path, size)`` is true for; false and NULL go on to the next rule."""
        self._rules.append((Precedence(precedence), lambda _e, _n, path, size: test(path, size), True))
        return self

    def exclude(self, precedence: Precedence, test: Callable[[Column, Column], Column]) -> FilterBuilder:
        self._rules.append((Precedence(precedence), lambda _e, _n, path, size: test(path, size), False))
        return self

    def _ready(self, default: bool) -> Filter:
        ordered = sorted(self._rules, key=lambda r: -r[0])
        return Filter([(rule, verdict) for _, rule, verdict in ordered], default)

    def allow_the_rest(self) -> Filter:
        return self._ready(True)

    def deny_the_rest(self) -> Filter:
        return self._ready(False)
