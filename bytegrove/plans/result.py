"""What a scan found: objects, their values and findings, run-wide values, and the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.analyze import EXIT, SKIP

#: Steps of an order key for each generation: phase, extractor, entry.
STEPS = 3


class ScanResult:
    """Lazy views over the analyzed contents of a scan."""

    def __init__(self, seen: DataFrame, tree: bool, may_stop: bool, budget: int | None):
        if may_stop and tree:
            seen = self._stopped(seen)
        if tree:
            order = Window.partitionBy("scan_id").orderBy("order_key")
            seen = seen.withColumn("object_id", (F.row_number().over(order) - 1).cast("long"))
        else:
            seen = seen.withColumn("object_id", F.lit(0).cast("long"))
        if budget is not None:
            seen = seen.where(F.col("object_id") < budget)
        self._seen, self._tree = seen, tree

    @staticmethod
    def _stopped(seen: DataFrame) -> DataFrame:
        """Without what comes after a scan's first Exit, or below a skipped object."""
        exits = seen.where(F.col("action") == EXIT).groupBy("scan_id").agg(F.min("order_key").alias("last"))
        seen = seen.join(exits, "scan_id", "left").where(F.col("last").isNull() | (F.col("order_key") <= F.col("last"))).drop("last")
        skipped = seen.where(F.col("action").isin(SKIP, EXIT)).select("scan_id", F.col("order_key").alias("above")).distinct()
        above = F.transform(F.sequence(F.lit(0), F.greatest(F.col("depth") - 2, F.lit(0))), lambda k: F.slice("order_key", F.lit(1), k * STEPS))
        held = seen.where("depth > 1").select("scan_id", "order_key", F.explode(above).alias("above")).join(skipped, ["scan_id", "above"], "left_semi").select("scan_id", "order_key").distinct()
        return seen.join(held, ["scan_id", "order_key"], "left_anti")

    @property
    def objects(self) -> DataFrame:
        """scan_id, object_id, parent_id, depth, order_key, path, path_raw, size, type, type_source, is_folder, action."""
        cols = ["scan_id", "object_id", "depth", "order_key", "path", "path_raw", "size", "type", "type_source", "is_folder", "action"]
        rows = self._seen.select(*cols)
        if not self._tree:
            return rows.withColumn("parent_id", F.lit(None).cast("long"))
        up = rows.select("scan_id", F.col("order_key").alias("up"), F.col("object_id").alias("parent_id"))
        rows = rows.withColumn("up", F.when(F.col("depth") > 1, F.slice("order_key", F.lit(1), F.size("order_key") - STEPS)))
        return rows.join(up, ["scan_id", "up"], "left").drop("up")

    def objects_scanned(self) -> DataFrame:
        """scan_id, objects."""
        return self._seen.groupBy("scan_id").agg(F.count(F.lit(1)).alias("objects"))

    def roots(self) -> DataFrame:
        return self.objects.where("object_id = 0")

    def links(self) -> DataFrame:
        """Objects with parent, first child and next sibling."""
        rows = self.objects.select("scan_id", "object_id", "parent_id", "order_key")
        beside = Window.partitionBy("scan_id", "parent_id").orderBy("order_key")
        rows = rows.withColumn("next_sibling", F.when(F.col("parent_id").isNotNull(), F.lead("object_id").over(beside)))
        first = rows.where("parent_id is not null").groupBy("scan_id", F.col("parent_id").alias("object_id")).agg(F.min("object_id").alias("first_child"))
        return rows.join(first, ["scan_id", "object_id"], "left").drop("order_key")

    def values(self) -> DataFrame:
        """scan_id, object_id, key, value: each object's values; of one set twice the later."""
        rows = self._seen.select("scan_id", "object_id", F.posexplode("values").alias("at", "v")).select("scan_id", "object_id", "at", "v.*")
        last = Window.partitionBy("scan_id", "object_id", "key").orderBy(F.desc("at"))
        return rows.withColumn("rank", F.row_number().over(last)).where("rank = 1").select("scan_id", "object_id", "key", "value")

    def globals(self) -> DataFrame:
        """scan_id, key, op, number, value: run-wide values; ``set`` keeps the last in order.

        A sum beyond 64 bits has no number, and its value is the sum.
        """
        rows = self._seen.select("scan_id", "order_key", F.posexplode("folds").alias("at", "f")).select("scan_id", "order_key", "at", "f.*")
        n = F.col("number")
        folded = rows.groupBy("scan_id", "key", "op").agg(F.sum(n.cast("decimal(19,0)")).alias("total"), F.min(n).alias("min"), F.max(n).alias("max"), F.count(F.lit(1)).alias("count"), F.max_by(F.to_json("value"), F.struct("order_key", "at")).alias("last"))
        folded = folded.withColumn("sum", F.col("total").try_cast("long"))
        beyond = (F.col("op") == "sum") & F.col("sum").isNull()
        number = F.coalesce(*[F.when(F.col("op") == k, F.col(k)) for k in ("sum", "min", "max", "count")])
        return folded.select("scan_id", "key", "op", number.alias("number"), F.when(F.col("op") == "set", F.parse_json("last")).when(beyond, F.col("total").cast("variant")).alias("value"))

    def findings(self) -> DataFrame:
        """scan_id, object_id, seq, finding, source, metadata, path, type."""
        return self._seen.select("scan_id", "object_id", "path", "type", F.posexplode("findings").alias("seq", "f")).select("scan_id", "object_id", "seq", "f.finding", "f.source", "f.metadata", "path", "type")

    def tree_lines(self) -> DataFrame:
        """scan_id, object_id, line: paths indented by depth, to be read in order of object_id."""
        return self._seen.select("scan_id", "object_id", F.concat(F.expr("repeat('  ', depth - 1)"), F.col("path")).alias("line"))

    def write(self, path: str) -> None:
        """Write objects, values, globals and findings as Parquet tables below ``path``."""
        for name, rows in (("objects", self.objects), ("values", self.values()), ("globals", self.globals()), ("findings", self.findings())):
            rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
