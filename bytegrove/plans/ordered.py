"""The ordered tier: plugins written as Python objects, one root after another in each task.

For plugins that keep state, look at run-wide values while the scan goes on, or decide by the number
of objects seen. A root is one unit of work, and roots run side by side. Results have the schema of
OBJECTS, with values, run-wide values and findings as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analyze import CONTINUE, EXIT, SKIP
from .staging import bound_batches

OBJECTS = "scan_id long, object_id long, parent_id long, depth int, path string, size long, type string, action string, values string, findings string, globals string"


@dataclass
class Item:
    """A content: bytes (None: unreadable), path, size as announced, pinned type."""

    path: str
    content: bytes | None
    pinned_type: str | None = None
    size: int = -1
    is_folder: bool = False

    def __post_init__(self) -> None:
        if self.size < 0:
            self.size = len(self.content or b"")

    def read(self, offset: int, count: int) -> bytes | None:
        """Fewer bytes at the end, none exactly there; None past it or if unreadable."""
        if self.content is None or offset > len(self.content):
            return None
        return self.content[offset : offset + count]


@dataclass
class Entry:
    path: str
    size: int
    skip_filter: bool = False


@dataclass
class Request:
    type: str
    offset: int = 0
    length: int | None = None
    params: dict[str, Any] | None = None


@dataclass
class Context:
    """What analyzers write to. ``globals`` lives as long as the scan, ``values`` as the object."""

    globals: dict[str, Any] = field(default_factory=dict)
    values: dict[str, Any] | None = None
    objects_scanned: int = 0
    requests: list[Request] = field(default_factory=list)
    findings: list[tuple] = field(default_factory=list)

    def set(self, key: str, value: Any) -> None:
        """Set a value of the current object."""
        if self.values is None:
            self.values = {}
        self.values[key] = value

    def update(self, key: str, change: Callable[[Any], Any]) -> bool:
        """Change a run-wide value; False if it isn't set."""
        if key not in self.globals:
            return False
        self.globals[key] = change(self.globals[key])
        return True

    def request(self, type: str, offset: int = 0, length: int | None = None, **params: Any) -> None:
        self.requests.append(Request(type, offset, length, params or None))

    def add_finding(self, text: str, source: str | None = None, metadata: Any = None) -> None:
        self.findings.append((text, source, metadata))


Analyze = Callable[[Item, Context], str | None]
#: Yields (entry, materialise) for a content and the part asked for.
Extract = Callable[[Item, Request], Iterator[tuple[Entry, Callable[[], Item | None]]] | None]


@dataclass
class Plugins:
    """A scan's plugins, made anew for each root by the factory that OrderedScanner is given.

    ``identify(item)`` gives a type or None; it is asked only where no type is pinned.
    ``analyzers``: (type or None for generic, priority, function); ``extractors``: (type, function).
    """

    identify: Callable[[Item], str | None]
    analyzers: list[tuple[str | None, int, Analyze]] = field(default_factory=list)
    extractors: list[tuple[str, Extract]] = field(default_factory=list)
    passes: Callable[[str, int], bool] | None = None
    max_depth: int = 8


def scan_one(plugins: Plugins, root: Item, filter_root: bool = False) -> tuple[list[dict], dict]:
    """One root's objects in depth-first order, and the run-wide values."""
    context, objects = Context(), []
    if filter_root and plugins.passes and not plugins.passes(root.path, root.size):
        return [], {}
    order = sorted(range(len(plugins.analyzers)), key=lambda i: (plugins.analyzers[i][0] is None, plugins.analyzers[i][1], i))

    def visit(item: Item, depth: int, parent: int | None) -> bool:
        """False ends the scan."""
        me = len(objects)
        kind = item.pinned_type or plugins.identify(item)
        row = {"object_id": me, "parent_id": parent, "depth": depth, "path": item.path, "size": item.size, "type": kind, "action": CONTINUE}
        objects.append(row)
        context.values, context.requests, context.findings, context.objects_scanned = None, [], [], len(objects)
        for i in order:
            wanted, _, analyze = plugins.analyzers[i]
            if wanted is None or wanted == kind:
                row["action"] = analyze(item, context) or CONTINUE
                if row["action"] != CONTINUE:
                    break
        row["values"], row["findings"] = context.values, context.findings
        mine = context.requests
        if row["action"] == EXIT:
            return False
        if row["action"] == SKIP or depth >= plugins.max_depth:
            return True
        for ask in [Request(kind, 0, item.size) if kind else None, *mine]:
            for type, extract in plugins.extractors:
                if ask is None or type != ask.type:
                    continue
                for entry, materialise in extract(item, ask) or ():
                    if not entry.skip_filter and plugins.passes and not plugins.passes(entry.path, entry.size):
                        continue
                    child = materialise()
                    if child is not None and not visit(child, depth + 1, me):
                        return False
        return True

    visit(root, 1, None)
    return objects, context.globals


class OrderedScanner:
    """``factory`` makes the plugins of one root; it is shipped to the tasks."""

    def __init__(self, factory: Callable[[], Plugins]):
        self.factory = factory

    def scan(self, contents: DataFrame, filter_root: bool = False) -> DataFrame:
        """OBJECTS of all roots; ``globals`` is on each scan's first object."""
        factory = self.factory
        bound_batches(contents.sparkSession)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for scan_id, path, size, data, pinned in pdf.itertuples(index=False):
                    root = Item(path, None if data is None else bytes(data), None if pd.isna(pinned) else pinned, int(size))
                    objects, shared = scan_one(factory(), root, filter_root)
                    for o in objects:
                        o["scan_id"] = scan_id
                        o["values"] = None if o["values"] is None else json.dumps(o["values"], sort_keys=True)
                        o["findings"] = json.dumps(o["findings"])
                        o["globals"] = json.dumps(shared, sort_keys=True) if o["object_id"] == 0 else None
                    if objects:
                        out = pd.DataFrame(objects)[[c.strip().split(" ")[0] for c in OBJECTS.split(",")]]
                        out["parent_id"] = out["parent_id"].astype("Int64")
                        yield out

        rows = contents
        if "pinned_type" not in rows.columns:
            rows = rows.withColumn("pinned_type", F.lit(None).cast("string"))
        if "size" not in rows.columns:
            rows = rows.withColumn("size", F.coalesce(F.length("content"), F.lit(0)).cast("long"))
        return rows.select("scan_id", "path", F.col("size").cast("long").alias("size"), "content", "pinned_type").mapInPandas(run, OBJECTS)
