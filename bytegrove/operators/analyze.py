"""Analyzers as expressions over a content: values, run-wide folds, findings, requests, control.

An analyzer runs for contents of its type, a generic one for every content after the typed ones;
by rising priority, ties in registration order. Skip and Exit end the chain of that content; what
was put out up to there, the deciding analyzer included, stays.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identify import Content

CONTINUE, SKIP, EXIT = "continue", "skip", "exit"

VALUES = "array<struct<key:string,value:variant>>"
FOLDS = "array<struct<key:string,op:string,number:bigint,value:variant>>"
FINDINGS = "array<struct<finding:string,source:string,metadata:variant>>"
REQUESTS = "array<struct<type:string,offset:bigint,length:bigint,params:variant>>"
FOLD_OPS = ("set", "sum", "min", "max", "count")


def variant(value: Column, nested: bool = False) -> Column:
    """A value of any type; structs, maps and arrays need ``nested``."""
    return F.to_variant_object(value) if nested else value.cast("variant")


def value_of(value: Column | tuple[Column, bool]) -> Column:
    return variant(*value) if isinstance(value, tuple) else variant(value)


def request(type: str, offset: Column | int = 0, length: Column | int | None = None, params: Mapping[str, Column] | None = None) -> Column:
    """A request to run the extractors of a type over a part of the current content."""
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    named = F.to_variant_object(F.struct(*[v.alias(k) for k, v in params.items()])) if params else F.lit(None).cast("variant")
    return F.struct(F.lit(type).alias("type"), number(offset).alias("offset"), number(length).alias("length"), named.alias("params"))


def finding(text: Column, source: Column | None = None, metadata: Column | None = None) -> Column:
    return F.struct(text.cast("string").alias("finding"), (F.lit(None) if source is None else source).cast("string").alias("source"), (F.lit(None).cast("variant") if metadata is None else F.to_variant_object(metadata)).alias("metadata"))


@dataclass(frozen=True)
class Output:
    """What an analyzer puts out. NULL values are not set; NULL arrays are empty.

    ``values``: by name a Column, or (Column, True) for a struct; ``folds``: by name an operation
    and a Column; ``findings`` and ``requests``: arrays of finding() and request() structs;
    ``action``: CONTINUE, SKIP or EXIT, NULL continues.
    """

    values: Mapping[str, Column | tuple[Column, bool]] = field(default_factory=dict)
    folds: Mapping[str, tuple[str, Column]] = field(default_factory=dict)
    findings: Column | None = None
    requests: Column | None = None
    action: Column | None = None


@dataclass(frozen=True)
class Analyzer:
    name: str
    analyze: Callable[[Content], Output]
    requires: str | Sequence[str] = ()

    def __post_init__(self) -> None:
        if isinstance(self.requires, str):  # one name
            object.__setattr__(self, "requires", (self.requires,))
        if not self.name:
            raise ValueError("an analyzer needs a name")


@dataclass(frozen=True)
class Registered:
    analyzer: Analyzer
    priority: int
    type: str | None
    index: int


class AnalyzerList:
    def __init__(self, registered: Sequence[Registered], types: Sequence[str]):
        for r in registered:
            if not 0 <= r.priority <= 255:
                raise ValueError(f"priority of {r.analyzer.name} is not in 0..255")
            if r.type is not None and r.type not in types:
                raise ValueError(f"{r.type} is not a content type")
        place = {t: k for k, t in enumerate(types)}
        self.ordered = sorted(registered, key=lambda r: (r.type is None, place.get(r.type, 0), r.priority, r.index))
        self._check_dependencies(registered)

    @staticmethod
    def _check_dependencies(registered: Sequence[Registered]) -> None:
        last = {r.analyzer.name: r for r in registered}
        for r in registered:
            for need in r.analyzer.requires:
                found = last.get(need)
                if found is None:
                    raise ValueError(f"Dependency {need} not found for analyzer {r.analyzer.name}")
                if found.priority >= r.priority:
                    raise ValueError(f"Dependency {need} must have a priority smaller than analyzer {r.analyzer.name}")
                if found.type != r.type and (found.type is None or r.type is not None):
                    warnings.warn(f"{need} does not run before {r.analyzer.name} on one object", stacklevel=4)

    def names(self, type: str | None) -> list[str]:
        """Analyzers of a type, or the generic ones, in the order they run."""
        return [r.analyzer.name for r in self.ordered if r.type == type]

    def outputs(self, c: Content) -> dict[str, Column]:
        """values, folds, findings, requests (arrays) and action of a content."""
        parts: dict[str, list[Column]] = {"values": [], "folds": [], "findings": [], "requests": []}
        alive, action = F.lit(True), F.lit(CONTINUE)
        for r in self.ordered:
            out = r.analyzer.analyze(c)
            runs = alive if r.type is None else alive & F.coalesce(c.type == r.type, F.lit(False))
            values = [F.struct(F.lit(k).alias("key"), value_of(v).alias("value")) for k, v in out.values.items()]
            folds = []
            for k, (op, v) in out.folds.items():
                if op not in FOLD_OPS:
                    raise ValueError(f"{op} is not one of {FOLD_OPS}")
                number = v.cast("long") if op != "set" else F.lit(None).cast("long")
                folds.append(F.struct(F.lit(k).alias("key"), F.lit(op).alias("op"), number.alias("number"), variant(v).alias("value")))
            for name, rows, schema in (("values", F.filter(F.array(*values), lambda x: x["value"].isNotNull()) if values else None, VALUES), ("folds", F.filter(F.array(*folds), lambda x: x["value"].isNotNull()) if folds else None, FOLDS), ("findings", out.findings, FINDINGS), ("requests", out.requests, REQUESTS)):
                if rows is not None:
                    parts[name].append(F.when(runs, F.coalesce(rows, F.array().cast(schema))).otherwise(F.array().cast(schema)))
            if out.action is not None:
                mine = F.coalesce(out.action, F.lit(CONTINUE))
                action = F.when(runs & (mine != CONTINUE), mine).otherwise(action)
                alive = alive & ~(runs & (mine != CONTINUE))
        empty = {"values": VALUES, "folds": FOLDS, "findings": FINDINGS, "requests": REQUESTS}
        made = {k: (F.concat(*v) if len(v) > 1 else v[0]) if v else F.array().cast(empty[k]) for k, v in parts.items()}
        return made | {"action": action}


