"""Registered queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import plugins as P
from .operators.analyze import EXIT, SKIP, Analyzer, Output, finding, request
from .operators.extract import content, entry
from .operators.filters import FilterBuilder, Precedence
from .operators.identify import Identifier
from .plans.scanner import ScannerBuilder
from .sources.contents import text_table

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, pinned: Column | None = None) -> DataFrame:
    return text_table(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), pinned)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(_table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"), F.col("html"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return text_table(_table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), F.concat(F.lit("conv-"), c[0], F.lit("/"), c[1], F.lit(".txt")), F.col("text"))


# --- paths and filters ------------------------------------------------------------------


def path_basename_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = paths.file_name(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", name.alias("file_name"), paths.extension(name).alias("extension"), paths.ascii_lower(name).alias("folded"))


def filter_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (
        FilterBuilder()
        .include_extensions(Precedence.LOW, ["html", "HTM"])
        .exclude(Precedence.HIGH, lambda path, size: path.contains("ref="))
        .include(Precedence.HIGHEST, lambda path, size: path.startswith("https://m."))
        .exclude_extensions(Precedence.LOW, ["html"])
        .deny_the_rest()
    )
    rows = pages(spark, sf_dir)
    return rows.select(F.col("scan_id").alias("page_id"), rules.passes(F.col("path"), F.col("size")).alias("passes"))


def filter_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = FilterBuilder().include_file_names(Precedence.MEDIUM, ["0.TXT", "1.txt"]).exclude_file_names(Precedence.HIGH, ["1.txt"]).deny_the_rest()
    rows = turns(spark, sf_dir)
    return rows.where(rules.passes(F.col("path"), F.col("size"))).select("scan_id", "path")


def filter_callback_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = FilterBuilder().exclude(Precedence.HIGH, lambda path, size: size > 4000).include(Precedence.LOW, lambda path, size: size >= 500).deny_the_rest()
    result = ScannerBuilder(["Text"]).filter(rules).build().scan(documents(spark, sf_dir), filter_root=True)
    return result.objects.select(F.col("scan_id").alias("doc_id"), "size")


# --- identification ---------------------------------------------------------------------

HTML = Identifier("Html", magic=[b"<!DOCTYPE html>", b"<!DOCTYPE"])


def _types(spark: SparkSession, sf_dir: str, rows: DataFrame, types: list[str], *identifiers: Identifier) -> DataFrame:
    builder = ScannerBuilder(types)
    for i in identifiers:
        builder.add_identifier(i)
    return builder.build().scan(rows).objects


def identify_magic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _types(spark, sf_dir, pages(spark, sf_dir), ["Html", "Markup"], HTML, Identifier("Markup", magic=[b"<!", b"<?xml"]))
    return found.select(F.col("scan_id").alias("page_id"), "type", "type_source")


def identify_extension_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _types(spark, sf_dir, pages(spark, sf_dir), ["Html", "Query"], Identifier("Html", extensions=["HTML", "htm"]), Identifier("Query", extensions=["com/en", "net/en"]))
    return found.select(F.col("scan_id").alias("page_id"), "type", "type_source")


def identify_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _types(
        spark, sf_dir, documents(spark, sf_dir), ["The", "Long", "Text", "First"],
        Identifier("The", magic=[b"The ", b"Th"], validate=lambda c: c.size > 1500),
        Identifier("First", names=["doc-1.TXT", "doc-2.txt"]),
        Identifier("Text", extensions=["TXT"], validate=lambda c: c.size < 3000),
        Identifier("Long", validate=lambda c: c.size >= 5000),
    )
    return found.select(F.col("scan_id").alias("doc_id"), "type", "type_source")


def identify_no_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _types(spark, sf_dir, turns(spark, sf_dir), ["Big", "Some"], Identifier("Big", validate=lambda c: c.size > 800), Identifier("Some", validate=lambda c: c.size > 200))
    return found.select("scan_id", "type")


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _types(spark, sf_dir, pages(spark, sf_dir), ["Html", "Page"], Identifier("Page", extensions=["html"], validate=lambda c: c.size % 2 == 0), Identifier("Html", validate=lambda c: c.size % 3 == 0))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


# --- analyzers --------------------------------------------------------------------------


def vowel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ScannerBuilder(["TextBuffer"]).add_analyzer("TextBuffer", 0, P.VOWELS).build().scan(documents(spark, sf_dir, F.lit("TextBuffer")))
    return result.globals().select(F.col("scan_id").alias("doc_id"), F.col("value").cast("long").alias("count_vowels"))


def md5_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ScannerBuilder(["Any"]).add_generic_analyzer(0, P.MD5).build().scan(pages(spark, sf_dir))
    return result.values().select(F.col("scan_id").alias("page_id"), F.col("value").cast("string").alias("md5"))


def _flags() -> ScannerBuilder:
    """Skips long texts after the first of three analyzers."""
    return (
        ScannerBuilder(["Text"])
        .add_analyzer("Text", 1, Analyzer("length", lambda c: Output(values={"length": c.size}, action=F.when(c.size > 3000, F.lit(SKIP)))))
        .add_analyzer("Text", 2, Analyzer("half", lambda c: Output(values={"half": F.floor(c.size / 2)})))
        .add_generic_analyzer(0, Analyzer("odd", lambda c: Output(values={"odd": F.when(c.size % 2 == 1, F.lit(1).cast("long")), "length": c.size + 1000000})))
    )


def analyzer_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _flags().build().scan(documents(spark, sf_dir, F.lit("Text")))
    return result.values().select(F.col("scan_id").alias("doc_id"), "key", F.col("value").cast("long").alias("value"))


def global_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-wide values over the digit runs of each text."""
    a = Analyzer("folds", lambda c: Output(folds={"longest": ("max", c.size), "shortest": ("min", c.size), "objects": ("count", c.size), "last": ("set", c.size)}))
    result = ScannerBuilder(["Text", "Number"]).add_analyzer("Number", 0, a).add_extractor("Text", P.NumberExtractor()).build().scan(documents(spark, sf_dir, F.lit("Text")))
    return result.globals().select(F.col("scan_id").alias("doc_id"), "key", F.coalesce("number", F.col("value").cast("long")).alias("value"))


def findings_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analyzer("urls", lambda c: Output(findings=F.transform(F.regexp_extract_all(F.decode(c.content, "UTF-8"), F.lit('href="([^"]*)"'), F.lit(1)), lambda u: finding(u, F.lit("href")))))
    result = ScannerBuilder(["Html"]).add_identifier(HTML).add_analyzer("Html", 0, a).build().scan(pages(spark, sf_dir))
    return result.findings().select(F.col("scan_id").alias("page_id"), F.col("seq").cast("long").alias("seq"), "finding", "source", "type")


# --- extraction -------------------------------------------------------------------------


def _numbers(spark: SparkSession, sf_dir: str):
    builder = ScannerBuilder(["Text", "Number"]).add_extractor("Text", P.NumberExtractor()).add_analyzer("Number", 0, P.NUMBER)
    return builder.build().scan(documents(spark, sf_dir, F.lit("Text")))


def number_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).objects.where("depth = 2").select(F.col("scan_id").alias("doc_id"), "object_id", "parent_id", "path", "size", "type")


def number_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).globals().select(F.col("scan_id").alias("doc_id"), F.col("number").alias("sum"))


def _base64(spark: SparkSession, sf_dir: str):
    builder = ScannerBuilder(["Text", "Base64", "Base64Decoded"]).add_analyzer("Text", 0, P.BASE64_FINDER).add_extractor("Base64", P.Base64Extractor())
    return builder.add_generic_analyzer(9, Analyzer("text", lambda c: Output(values={"text": F.when(c.type == "Base64Decoded", F.hex(c.content))}))).build().scan(documents(spark, sf_dir, F.lit("Text")))


def base64_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base64(spark, sf_dir).objects.where("depth = 2").groupBy(F.col("scan_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("hits"), F.sum("size").alias("bytes"))


def base64_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base64(spark, sf_dir).values().select(F.col("scan_id").alias("doc_id"), "object_id", F.col("value").cast("string").alias("decoded"))


class _Halves:
    """A content's first half, by bytes, as its only child."""

    def entries(self, c, x):
        return F.when(c.size >= 2, F.array(entry(F.concat(c.path, F.lit("h")), F.floor(c.size / 2))))

    def extract(self, c, x, e):
        return content(F.substring(c.content, F.lit(1), F.floor(c.size / 2).cast("int")), e["path"], "Text")


def depth_limited_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ScannerBuilder(["Text"]).add_extractor("Text", _Halves()).max_depth(5).build().scan(turns_pinned(spark, sf_dir))
    return result.objects.select("scan_id", "object_id", "parent_id", F.col("depth").cast("long").alias("depth"), "path", "size")


def turns_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).withColumn("pinned_type", F.lit("Text"))


class _Lines:
    """Each line of a text as a child."""

    def entries(self, c, x):
        return F.transform(F.split(F.decode(c.content, "ISO-8859-1"), "\n"), lambda s, i: entry(F.concat(F.lit("line-"), i.cast("string")), F.length(s), s))

    def extract(self, c, x, e):
        return content(F.encode(e["locator"], "ISO-8859-1"), e["path"], "Line")


def tree_sibling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ScannerBuilder(["Text", "Line"]).add_extractor("Text", _Lines()).build().scan(turns_pinned(spark, sf_dir))
    return result.links().select("scan_id", "object_id", "parent_id", "first_child", "next_sibling")


def exit_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = Analyzer("stop", lambda c: Output(action=F.when(c.size > 200, F.lit(EXIT))))
    result = ScannerBuilder(["Text", "Line"]).add_extractor("Text", _Lines()).add_analyzer("Line", 0, stop).build().scan(turns_pinned(spark, sf_dir))
    return result.objects.select("scan_id", "object_id", "path", "size")


def objects_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ScannerBuilder(["Text", "Line"]).add_extractor("Text", _Lines()).object_budget(3).build().scan(turns_pinned(spark, sf_dir))
    return result.objects.select("scan_id", "object_id", "path")


class _Slice:
    """The part that a request names."""

    def entries(self, c, x):
        return F.array(entry(F.concat(F.lit("slice@"), x.offset.cast("string")), x.length))

    def extract(self, c, x, e):
        return content(F.substring(c.content, (x.offset + 1).cast("int"), x.length.cast("int")), e["path"], "Part")


def request_offset_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = Analyzer("ask", lambda c: Output(requests=F.array(request("Slice", 2, 13), request("Slice", 0, 9), request("Nobody"))))
    show = Analyzer("show", lambda c: Output(values={"text": F.decode(c.content, "ISO-8859-1")}))
    builder = ScannerBuilder(["Html", "Slice", "Part", "Nobody"]).add_identifier(HTML).add_analyzer("Html", 0, ask).add_analyzer("Part", 0, show).add_extractor("Slice", _Slice())
    result = builder.build().scan(pages(spark, sf_dir))
    return result.values().select(F.col("scan_id").alias("page_id"), "object_id", F.col("value").cast("string").alias("part"))


def filtered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that the filter passes by size; the roots aren't asked."""
    rules = FilterBuilder().include(Precedence.LOW, lambda path, size: size > 100).deny_the_rest()
    result = ScannerBuilder(["Text", "Line"]).add_extractor("Text", _Lines()).filter(rules).build().scan(turns_pinned(spark, sf_dir))
    return result.objects_scanned()


QUERIES: tuple[Query, ...] = (
    path_basename_ext, filter_precedence, filter_name_rules, filter_callback_size, identify_magic_pages, identify_extension_pages, identify_precedence, identify_no_prefilter, type_histogram,
    vowel_count, md5_all, analyzer_skip, global_folds, findings_join, number_children, number_sum, base64_hits, base64_decoded, depth_limited_tree, tree_sibling_links, exit_truncation,
    objects_budget, request_offset_length, filtered_children,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


# --- SQL --------------------------------------------------------------------------------

_NAME = r"regexp_replace(url, '^.*[/\\]', '', 's')"
_EXT = "case when contains(n, '.') then list_last(string_split(n, '.')) else '' end"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TURN = "conv_id * 1000 + turn as scan_id, 'conv-' || conv_id || '/' || turn || '.txt' as path, octet_length(encode(text)) as size"
_LINES = f"""
    roots as (select {_TURN}, text from conversations),
    lines as (select scan_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from roots),
    objects as (
        select scan_id, 0 as object_id, null::bigint as parent_id, path, size from roots
        union all select scan_id, k + 1, 0, 'line-' || k, octet_length(encode(line)) from lines)"""
_RUNS = "runs as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as run, unnest(range(1, len(regexp_extract_all(text, '[0-9]+')) + 1)) as k from documents)"
_B64 = "hits as (select doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/]+={0,2}'), lambda r: length(r) >= 16 and length(r) % 4 = 0)) as run from documents)"
_SIZE = "octet_length(encode(text))"


def oracle_sql() -> dict[str, str]:
    return {
        "path_basename_ext": f"select page_id, n as file_name, {_EXT} as extension, {_FOLD.format('n')} as folded from (select page_id, {_NAME} as n from pages)",
        "filter_precedence": f"select page_id, case when starts_with(url, 'https://m.') then true when contains(url, 'ref=') then false when {_FOLD.format(_EXT)} in ('html', 'htm') then true else false end as passes from (select page_id, url, {_NAME} as n from pages)",
        "filter_name_rules": f"select scan_id, path from (select {_TURN}, turn from conversations) where turn = 0",
        "filter_callback_size": f"select doc_id, {_SIZE} as size from documents where {_SIZE} between 500 and 4000",
        "identify_magic_pages": "select page_id, case when starts_with(html, '<!DOCTYPE') then 'Html' when starts_with(html, '<!') or starts_with(html, '<?xml') then 'Markup' end as type, case when starts_with(html, '<!') or starts_with(html, '<?xml') then 'magic' end as type_source from pages",
        "identify_extension_pages": f"select page_id, case when e in ('html', 'htm') then 'Html' when e in ('com/en', 'net/en') then 'Query' end as type, case when e in ('html', 'htm', 'com/en', 'net/en') then 'extension' end as type_source from (select page_id, {_FOLD.format(_EXT)} as e from (select page_id, {_NAME} as n from pages))",
        "identify_precedence": f"""
            select doc_id, t[1] as type, t[2] as type_source from (select doc_id, case
                when starts_with(text, 'Th') and s > 1500 then ['The', 'magic']
                when doc_id in (1, 2) then ['First', 'name']
                when s < 3000 then ['Text', 'extension']
                when s >= 5000 then ['Long', 'validate'] end as t
            from (select doc_id, text, {_SIZE} as s from documents))""",
        "identify_no_prefilter": f"select scan_id, case when size > 800 then 'Big' when size > 200 then 'Some' end as type from (select {_TURN} from conversations)",
        "type_histogram": f"select type, count(*) as objects, sum(s)::bigint as bytes from (select s, case when e = 'html' and s % 2 = 0 then 'Page' when s % 3 = 0 then 'Html' end as type from (select octet_length(encode(html)) as s, {_FOLD.format(_EXT)} as e from (select html, {_NAME} as n from pages))) group by type",
        "vowel_count": "select doc_id, (length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) - len(list_filter([0, 2, 4, 6], lambda i: substr(hex(encode(text)), i + 1, 2) in ('41', '45', '49', '4F', '55', '61', '65', '69', '6F', '75'))))::bigint as count_vowels from documents",
        "md5_all": "select page_id, md5(html) as md5 from pages",
        "analyzer_skip": f"""
            with d as (select doc_id, {_SIZE} as s from documents)
            select doc_id, 'length' as key, case when s > 3000 then s else s + 1000000 end as value from d
            union all select doc_id, 'half', s // 2 from d where s <= 3000
            union all select doc_id, 'odd', 1 from d where s <= 3000 and s % 2 = 1""",
        "global_folds": f"""
            with {_RUNS}, g as (select doc_id, max(length(run)) as longest, min(length(run)) as shortest, count(*) as objects, arg_max(length(run), k) as last from runs group by doc_id)
            select doc_id, 'longest' as key, longest::bigint as value from g union all select doc_id, 'shortest', shortest from g
            union all select doc_id, 'objects', objects from g union all select doc_id, 'last', last from g""",
        "findings_join": """select page_id, unnest(range(len(h))) as seq, unnest(h) as finding, 'href' as source, 'Html' as type from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages where starts_with(html, '<!DOCTYPE'))""",
        "number_children": f"with {_RUNS} select doc_id, k as object_id, 0::bigint as parent_id, 'number' as path, length(run)::bigint as size, 'Number' as type from runs",
        "number_sum": f"with {_RUNS} select doc_id, sum(try_cast(run as bigint))::bigint as sum from runs where try_cast(run as bigint) is not null group by doc_id",
        "base64_hits": f"with {_B64} select doc_id, count(*) as hits, sum(octet_length(from_base64(run)))::bigint as bytes from hits group by doc_id",
        "base64_decoded": f"with {_B64} select doc_id, row_number() over (partition by doc_id order by k) as object_id, hex(from_base64(run)) as decoded from (select doc_id, run, row_number() over () as k from hits)",
        "depth_limited_tree": f"""
            with recursive t as (select scan_id, 0::bigint as object_id, null::bigint as parent_id, 1::bigint as depth, path, size from (select {_TURN} from conversations)
                union all select scan_id, object_id + 1, object_id, depth + 1, path || 'h', size // 2 from t where depth < 5 and size >= 2)
            select * from t""",
        "tree_sibling_links": f"""
            with {_LINES}, n as (select scan_id, max(object_id) as last from objects group by scan_id)
            select o.scan_id, object_id, parent_id, case when object_id = 0 and last > 0 then 1 end as first_child, case when object_id between 1 and last - 1 then object_id + 1 end as next_sibling from objects o join n on o.scan_id = n.scan_id""",
        "exit_truncation": f"""
            with {_LINES}, e as (select scan_id, min(object_id) as stop from objects where object_id > 0 and size > 200 group by scan_id)
            select o.scan_id, object_id, path, size from objects o left join e on o.scan_id = e.scan_id where stop is null or object_id <= stop""",
        "objects_budget": f"with {_LINES} select scan_id, object_id, path from objects where object_id < 3",
        "request_offset_length": "select page_id, 1 as object_id, html[3:15] as part from pages where starts_with(html, '<!DOCTYPE') union all select page_id, 2, html[1:9] from pages where starts_with(html, '<!DOCTYPE')",
        "filtered_children": f"with {_LINES} select scan_id, count(*) as objects from objects where object_id = 0 or size > 100 group by scan_id",
    }
