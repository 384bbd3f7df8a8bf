"""The set tier: every generation of contents is one plan.

A scan identifies all contents of a generation, runs their analyzers as one projection, and explodes
their entries into the next generation. Order in a scan is kept as a key: the parent's key followed
by phase (own type or number of the request), extractor and entry, so keys sort in depth-first order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import CONTINUE, Analyzer, AnalyzerList, Registered
from ..operators.extract import ENTRIES, Extraction, Extractor
from ..operators.filters import Filter
from ..operators.identify import Content, Identifier, IdentifierSet
from .result import ScanResult
from .staging import Staging, bound_batches

DEFAULT_DEPTH, MOST_DEPTH = 8, (1 << 32) - 3
ROW = ("scan_id", "order_key", "depth", "path", "path_raw", "size", "content", "pinned_type", "is_folder")
DEFAULTS = {"path_raw": "binary", "pinned_type": "string", "content": "binary"}


class ScannerBuilder:
    """Declares content types and the plugins of a scan."""

    def __init__(self, types: Sequence[str]):
        self.types = list(types)
        if not self.types or len(set(self.types)) != len(self.types) or not all(isinstance(t, str) and t for t in self.types):
            raise ValueError("content types must be one or more distinct names")
        if len(self.types) > 65535:
            raise ValueError("too many content types")
        self._identifiers: list[Identifier] = []
        self._analyzers: list[Registered] = []
        self._extractors: list[tuple[str, Extractor]] = []
        self._filter: Filter | None = None
        self._depth, self._budget, self._trie_prefix = DEFAULT_DEPTH, None, False

    def _known(self, type: str) -> str:
        if type not in self.types:
            raise ValueError(f"{type} is not a content type")
        return type

    def add_identifier(self, identifier: Identifier) -> ScannerBuilder:
        self._known(identifier.type)
        self._identifiers.append(identifier)
        return self

    def add_analyzer(self, type: str, priority: int, analyzer: Analyzer) -> ScannerBuilder:
        self._analyzers.append(Registered(analyzer, priority, self._known(type), len(self._analyzers)))
        return self

    def add_generic_analyzer(self, priority: int, analyzer: Analyzer) -> ScannerBuilder:
        self._analyzers.append(Registered(analyzer, priority, None, len(self._analyzers)))
        return self

    def add_extractor(self, type: str, extractor: Extractor) -> ScannerBuilder:
        self._extractors.append((self._known(type), extractor))
        return self

    def filter(self, rules: Filter) -> ScannerBuilder:
        self._filter = rules
        return self

    def max_depth(self, depth: int) -> ScannerBuilder:
        self._depth = min(max(1, depth), MOST_DEPTH)
        return self

    def object_budget(self, objects: int) -> ScannerBuilder:
        """End a scan after so many objects in depth-first order."""
        self._budget = max(1, objects)
        return self

    def trie_prefix(self, on: bool = True) -> ScannerBuilder:
        """Let names and extensions match as a walk over a prefix tree would."""
        self._trie_prefix = on
        return self

    def build(self) -> Scanner:
        return Scanner(IdentifierSet(self._identifiers, self._trie_prefix), AnalyzerList(self._analyzers, self.types), list(self._extractors), self._filter, self._depth, self._budget)


class Scanner:
    """A fixed set of plugins; scans share nothing."""

    def __init__(self, identifiers: IdentifierSet, analyzers: AnalyzerList, extractors: list[tuple[str, Extractor]], rules: Filter | None, depth: int, budget: int | None):
        self.identifiers, self.analyzers, self.extractors = identifiers, analyzers, extractors
        self.rules, self.depth, self.budget = rules, depth, budget
        self.may_stop = any(r.analyzer.analyze(Content.of()).action is not None for r in analyzers.ordered) if SparkSession.getActiveSession() else True

    def _observe(self, rows: DataFrame) -> DataFrame:
        """Identify and analyze one generation."""
        c = Content.of()
        typed = rows.withColumns(self.identifiers.keys(c)).withColumn("t", self.identifiers.resolve(c)).select(*ROW, "t.type", "t.type_source")
        made = self.analyzers.outputs(c)
        return typed.select(*ROW, "type", "type_source", *[v.alias(k) for k, v in made.items()])

    def _children(self, seen: DataFrame) -> DataFrame | None:
        """The next generation: entries that pass the filter, with their contents."""
        parents = seen.where((F.col("action") == CONTINUE) & (F.col("depth") < self.depth))
        asks = any(r.analyzer.analyze(Content.of()).requests is not None for r in self.analyzers.ordered)
        out = []
        whole = Extraction(F.lit(0).cast("long"), F.col("size"), F.lit(None).cast("variant"))
        for k, (type, extractor) in enumerate(self.extractors):
            mine = parents.where(F.col("type") == type)
            out.append(self._expand(mine.withColumn("phase", F.lit(0)), k, extractor, whole))
            if asks:
                asked = parents.select("*", F.posexplode("requests").alias("place", "ask")).where(F.col("ask.type") == type)
                out.append(self._expand(asked.withColumn("phase", F.col("place") + 1), k, extractor, Extraction(F.col("ask.offset"), F.col("ask.length"), F.col("ask.params"))))
        return reduce(DataFrame.unionByName, out) if out else None

    def _expand(self, parents: DataFrame, number: int, extractor: Extractor, x: Extraction) -> DataFrame:
        c = Content.of()
        found = parents.select("*", F.posexplode(extractor.entries(c, x).cast(ENTRIES)).alias("at", "e"))
        if self.rules is not None:
            found = found.where(F.col("e.skip_filter") | self.rules.passes(F.col("e.path"), F.col("e.size")))
        made = found.withColumn("x", extractor.extract(c, x, F.col("e"))).where(F.col("x").isNotNull())
        return made.select(
            "scan_id",
            F.concat("order_key", F.array(F.col("phase"), F.lit(number), F.col("at"))).alias("order_key"),
            (F.col("depth") + 1).alias("depth"),
            F.col("x.path").alias("path"),
            F.lit(None).cast("binary").alias("path_raw"),
            F.coalesce(F.length("x.content"), F.lit(0)).cast("long").alias("size"),
            F.col("x.content").alias("content"),
            F.col("x.pinned_type").alias("pinned_type"),
            F.lit(False).alias("is_folder"),
        )

    def scan(self, contents: DataFrame, filter_root: bool = False) -> ScanResult:
        """Scan every root; rows that bring an order_key and depth are a tree walked already."""
        bound_batches(contents.sparkSession)
        rows = contents
        for name, kind in DEFAULTS.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        if "size" not in rows.columns:
            rows = rows.withColumn("size", F.coalesce(F.length("content"), F.lit(0)).cast("long"))
        if "is_folder" not in rows.columns:
            rows = rows.withColumn("is_folder", F.lit(False))
        walked = "order_key" in rows.columns
        if not walked:
            rows = rows.withColumn("order_key", F.array().cast("array<int>")).withColumn("depth", F.lit(1))
        rows = rows.select(*ROW).where(F.col("depth") <= self.depth)
        if self.rules is not None and (filter_root or walked):
            passes = self.rules.passes(F.col("path"), F.col("size"), F.col("path_raw"))
            inner = (F.col("depth") > 1) & ~F.col("is_folder") if walked else F.lit(False)
            rows = rows.where(passes | ~(inner | (F.lit(filter_root) & (F.col("depth") == 1))))
        if not self.extractors or self.depth == 1:
            return ScanResult(self._observe(rows).drop("content"), walked, self.may_stop, self.budget)
        staging = Staging(contents.sparkSession)
        seen = staging.stage(self._observe(rows), "generation-1")
        all_seen, k = [seen], 1
        while k < self.depth:
            k += 1
            seen = staging.stage(self._observe(self._children(seen)), f"generation-{k}")
            if seen.isEmpty():
                break
            all_seen.append(seen)
        every = reduce(DataFrame.unionByName, [s.drop("content") for s in all_seen])
        return ScanResult(every, walked or len(all_seen) > 1, self.may_stop, self.budget)


