"""Registered queries over archives and images, whose bytes are made from the driver's tables."""

from __future__ import annotations

import io
import string
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .operators import plugins as P
from .operators.analyze import Analyzer, Output
from .operators.filters import FilterBuilder, Precedence
from .operators.identify import Identifier
from .plans.result import ScanResult
from .plans.scanner import ScannerBuilder
from .queries import _LINES, _SIZE, _TURN, Query, _Lines, _table, turns_pinned
from .queries import documents as texts

# --- bytes ------------------------------------------------------------------------------


def _be(n: Column | int, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(F.lit(n) if isinstance(n, int) else n), 2 * width, "0"))


def _le(n: Column | int, width: int) -> Column:
    b = _be(n, width)
    return F.concat(*[F.substring(b, k, 1) for k in range(width, 0, -1)])


def _bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def _zipped(members: dict[str, bytes]) -> bytes:
    """An archive of members at a fixed time, compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


@pandas_udf(T.BinaryType())
def _archive(name: pd.Series, text: pd.Series, image: pd.Series) -> pd.Series:
    """A folder, a text, a member that leads out, an image and an archive; NULL for a NULL text."""

    def made(name: str, text: bytes | None, image: bytes) -> bytes | None:
        if text is None:
            return None
        inner = _zipped({"deep.txt": f"deep-{name}".encode()})
        return _zipped({"text/": b"", f"text/{name}.txt": text, "../up.txt": name.encode(), "img.png": image, "inner.zip": inner})

    return pd.Series([made(*row) for row in zip(name, text, image, strict=True)], dtype=object)


def _png(width: Column, height: Column) -> Column:
    return F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), _be(13, 4), F.lit(b"IHDR"), _be(width, 4), _be(height, 4), _le(0, 9))


def _bmp(width: Column, height: Column) -> Column:
    return F.concat(F.lit(b"BM"), _le(30, 4), _le(0, 4), _le(54, 4), _le(40, 4), _le(width, 4), _le(height, 4), _le(1, 2), _le(24, 2))


def _jpeg(width: Column, height: Column) -> Column:
    return F.concat(F.lit(b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08"), _be(height, 2), _be(width, 2), _le(3, 1), _le(0, 9), F.lit(b"\xff\xd9"))


def _contents(df: DataFrame, path: Column, data: Column) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("long").alias("scan_id"), path.alias("path"), F.lit(None).cast("binary").alias("path_raw"), F.octet_length(data).cast("long").alias("size"),
        data.alias("content"), F.lit(None).cast("string").alias("pinned_type"), F.lit(False).alias("is_folder"),
    )


def _sides() -> tuple[Column, Column]:
    """Width and height of a document's image."""
    return F.col("doc_id") % 4000 + 1, F.col("doc_id") % 300 + 7


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the documents in archives; a quarter with an archive's first bytes alone; a quarter as they are."""
    name, text = F.col("doc_id").cast("string"), _bytes(F.col("text"))
    kind = F.col("doc_id") % 4
    data = F.when(kind < 2, _archive(name, F.when(kind < 2, text), _png(*_sides()))).when(kind == 2, F.concat(F.lit(b"PK\x03\x04"), text)).otherwise(text)
    return _contents(_table(spark, sf_dir, "documents"), F.concat(name, F.lit(".zip")), data)


# --- queries ----------------------------------------------------------------------------


def _zip() -> ScannerBuilder:
    return ScannerBuilder(["Zip", "Png"]).add_identifier(P.ZIP).add_identifier(P.PNG).add_extractor("Zip", P.ZipExtractor())


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each archive, with sizes of all but archives, whose size is the compressor's matter."""
    found = _zip().build().scan(archives(spark, sf_dir)).objects
    return found.select(F.col("scan_id").alias("doc_id"), "object_id", "parent_id", F.col("depth").cast("long").alias("depth"), "path", F.when(F.col("type").isNull() | (F.col("type") != "Zip"), F.col("size")).alias("size"), "type")


def zip_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 of what has no type, in archives and outside."""
    md5 = Analyzer("md5", lambda c: Output(values={"md5": F.when(c.type.isNull(), F.md5(c.content))}))
    result = _zip().add_generic_analyzer(0, md5).build().scan(archives(spark, sf_dir))
    return result.values().select(F.col("scan_id").alias("doc_id"), "object_id", F.col("value").cast("string").alias("md5"))


def find_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ScannerBuilder(["Zip"]).add_identifier(P.ZIP).max_depth(64).build().scan(archives(spark, sf_dir)).objects
    return found.where("type = 'Zip'").select(F.col("scan_id").alias("doc_id"), "path")


def _sizes(result: ScanResult) -> DataFrame:
    """Each object's file size, width and height."""
    of = lambda key, column: F.max(F.when(F.col("key") == key, column))
    side = lambda name: F.try_variant_get("value", f"$.{name}", "long")
    return result.values().groupBy(F.col("scan_id").alias("doc_id"), "object_id").agg(of("file_size", F.try_variant_get("value", "$", "long")).alias("file_size"), of("size", side("width")).alias("width"), of("size", side("height")).alias("height"))


def zip_png_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of PNG members; the filter passes no others, the root isn't asked."""
    rules = FilterBuilder().include_extensions(Precedence.HIGH, ["png"]).deny_the_rest()
    return _sizes(_zip().add_analyzer("Png", 0, P.PNG_SIZE).filter(rules).build().scan(archives(spark, sf_dir)))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of images of three formats among stubs and texts."""
    kind = F.col("doc_id") % 5
    data = F.when(kind == 0, _png(*_sides())).when(kind == 1, _bmp(*_sides())).when(kind == 2, _jpeg(*_sides())).when(kind == 3, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), _be(13, 4))).otherwise(F.concat(F.lit(b"text:"), _bytes(F.col("text"))))
    b = ScannerBuilder(["Png", "Bmp", "Jpeg"])
    for type, identifier, analyzer in (("Png", P.PNG, P.PNG_SIZE), ("Bmp", P.BMP, P.BMP_SIZE), ("Jpeg", P.JPEG, P.JPEG_SIZE)):
        b.add_identifier(identifier).add_analyzer(type, 0, analyzer)
    return _sizes(b.build().scan(_contents(_table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), data)))


def identify_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """52 patterns of one and two bytes; the longest that fits names the type."""
    b = ScannerBuilder([f"{a}{e}" for a in string.ascii_uppercase for e in ("", "e")])
    for type in b.types:
        b.add_identifier(Identifier(type, magic=[type.encode()]))
    return b.build().scan(texts(spark, sf_dir)).objects.select(F.col("scan_id").alias("doc_id"), "type", "type_source")


def analyzer_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of analyzers with one priority the later one's value stays; one for all types comes after them."""
    b = ScannerBuilder(["Text"]).add_generic_analyzer(0, Analyzer("all", lambda c: Output(values={"b": F.lit(3)}))).add_analyzer("Text", 5, Analyzer("first", lambda c: Output(values={"a": F.lit(1), "b": F.lit(1)})))
    result = b.add_analyzer("Text", 5, Analyzer("second", lambda c: Output(values={"a": F.lit(2), "b": F.lit(2)}))).build().scan(texts(spark, sf_dir, F.lit("Text")))
    return result.values().select(F.col("scan_id").alias("doc_id"), "key", F.col("value").cast("long").alias("value"))


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ScannerBuilder(["Text", "Line"]).add_extractor("Text", _Lines()).build().scan(turns_pinned(spark, sf_dir)).tree_lines()


def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ScannerBuilder(["Text", "Line"]).add_extractor("Text", _Lines()).build().scan(turns_pinned(spark, sf_dir)).roots().select("scan_id", "path", "size", "type")


QUERIES: tuple[Query, ...] = (zip_members, zip_md5, find_zip, zip_png_size, image_sizes, identify_many_patterns, analyzer_ties, tree_lines, tree_roots)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


# --- SQL --------------------------------------------------------------------------------

_DOCS = f"d as (select doc_id, doc_id::varchar as name, coalesce(text, '') as t, coalesce({_SIZE}, 0) as s, doc_id % 4 as kind from documents)"
#: Bytes of the PNG.
_PNG = 33


def oracle_sql() -> dict[str, str]:
    return {
        "zip_members": f"""
            with {_DOCS}, z as (select * from d where kind < 2)
            select doc_id, 0::bigint as object_id, null::bigint as parent_id, 1::bigint as depth, name || '.zip' as path, (case when kind = 2 then 4 + s when kind = 3 then s end)::bigint as size, case when kind < 2 then 'Zip' end as type from d
            union all select doc_id, 1, 0, 2, 'text/' || name || '.txt', s, null from z
            union all select doc_id, 2, 0, 2, '', length(name), null from z
            union all select doc_id, 3, 0, 2, 'img.png', {_PNG}, 'Png' from z
            union all select doc_id, 4, 0, 2, 'inner.zip', null, 'Zip' from z
            union all select doc_id, 5, 4, 3, 'deep.txt', 5 + length(name), null from z""",
        "zip_md5": f"""
            with {_DOCS}, z as (select * from d where kind < 2)
            select doc_id, 0 as object_id, case when kind = 2 then md5('\\x50\\x4B\\x03\\x04'::blob || encode(t)) else md5(t) end as md5 from d where kind >= 2
            union all select doc_id, 1, md5(t) from z union all select doc_id, 2, md5(name) from z union all select doc_id, 5, md5('deep-' || name) from z""",
        "find_zip": f"with {_DOCS} select doc_id, name || '.zip' as path from d where kind < 2",
        "zip_png_size": f"select doc_id, 1::bigint as object_id, {_PNG}::bigint as file_size, doc_id % 4000 + 1 as width, doc_id % 300 + 7 as height from documents where doc_id % 4 < 2",
        "image_sizes": f"select doc_id, 0::bigint as object_id, case doc_id % 5 when 0 then {_PNG} when 1 then 30 else 29 end::bigint as file_size, doc_id % 4000 + 1 as width, doc_id % 300 + 7 as height from documents where doc_id % 5 < 3",
        "identify_many_patterns": "select doc_id, nullif(regexp_extract(text, '^[A-Z]e?'), '') as type, case when regexp_matches(text, '^[A-Z]') then 'magic' end as type_source from documents",
        "analyzer_ties": "select doc_id, 'a' as key, 2 as value from documents union all select doc_id, 'b', 3 from documents",
        "tree_lines": f"with {_LINES} select scan_id, object_id, case when object_id > 0 then '  ' else '' end || path as line from objects",
        "tree_roots": f"select scan_id, path, size, 'Text' as type from (select {_TURN} from conversations)",
    }
