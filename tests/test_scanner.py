import io
import json
import random
import struct
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bytegrove import queries
from bytegrove.operators import plugins as P
from bytegrove.operators.analyze import EXIT, SKIP, Analyzer, AnalyzerList, Output, Registered, finding, request
from bytegrove.operators.extract import content, entry
from bytegrove.operators.filters import FilterBuilder, Precedence
from bytegrove.operators.identify import Identifier
from bytegrove.plans import ordered as O
from bytegrove.plans.scanner import ScannerBuilder
from bytegrove.sources.contents import buffers, files
from bytegrove.sources.folder import folder


def types_of(spark, identifiers, items, types=("Custom", "Tagged", "Fallback", "ByExt", "ByName")):
    b = ScannerBuilder(types)
    for i in identifiers:
        b.add_identifier(i)
    rows = b.build().scan(buffers(spark, items)).objects.orderBy("scan_id").collect()
    return [r["type"] for r in rows]


CUSTOM = Identifier("Custom", validate=lambda c: c.path.endswith(".custom"))


def test_identification(spark):
    no = Identifier("Tagged", magic=[b"TAG"], validate=lambda c: F.lit(False))
    yes = Identifier("Tagged", magic=[b"TAG"], validate=lambda c: F.lit(True))
    assert types_of(spark, [CUSTOM], [(b"hello", "blob.custom"), (b"hello", "blob.bin")]) == ["Custom", None]
    assert types_of(spark, [no, CUSTOM], [(b"TAG payload", "blob.custom")]) == ["Custom"]
    assert types_of(spark, [CUSTOM, yes], [(b"TAG payload", "blob.custom")]) == ["Tagged"]
    fallback = Identifier("Fallback", validate=lambda c: c.size > 0)
    assert types_of(spark, [CUSTOM, fallback], [(b"hello", "blob.custom"), (b"hello", "blob.bin"), (b"", "empty.bin")]) == ["Custom", "Fallback", None]
    mark = Identifier("Custom", validate=lambda c: F.substring(c.content, 17, 4) == F.lit(b"MARK"))
    assert types_of(spark, [mark], [(bytes(16) + b"MARK", "b"), (bytes(20), "b"), (b"short", "b")]) == ["Custom", None, None]
    assert types_of(spark, [Identifier("ByExt", extensions=["jpg", "Jpeg"])], [(b"x", "Photo.JPG"), (b"x", "shot.JPEG"), (b"x", "shot.png")]) == ["ByExt", "ByExt", None]
    assert types_of(spark, [Identifier("ByName", names=["Makefile"])], [(b"x", "C:\\src\\makefile"), (b"x", "makefile.txt")]) == ["ByName", None]
    assert types_of(spark, [Identifier("Tagged", magic=[b"0123456789ABCDEF"])], [(b"0123456789ABCDEF rest", "b"), (b"0123456789ABCDE?", "b")]) == ["Tagged", None]
    assert types_of(spark, [Identifier("Custom", validate=lambda c: F.lit(False))], [(b"x", "p", "Custom")]) == ["Custom"]
    short = [Identifier("Tagged", magic=[b"GI"]), Identifier("Custom", magic=[b"GIF"], validate=lambda c: F.lit(False))]
    assert types_of(spark, short, [(b"GIF89a", "x")]) == [None]  # a shorter magic is not tried again


def test_declarations_are_checked():
    with pytest.raises(ValueError, match="at most 16 bytes"):
        Identifier("A", magic=[b"x" * 17])
    with pytest.raises(ValueError, match="two identifiers"):
        ScannerBuilder(["A"]).add_identifier(Identifier("A")).add_identifier(Identifier("A")).build()
    for bad in ([], ["A", "A"], [""]):
        with pytest.raises(ValueError):
            ScannerBuilder(bad)
    with pytest.raises(ValueError, match="not a content type"):
        ScannerBuilder(["A"]).add_extractor("B", P.ZipExtractor())
    with pytest.raises(ValueError):
        Analyzer("", lambda c: Output())


def listed(*rows):
    nothing = lambda c: Output()
    return AnalyzerList([Registered(Analyzer(n, nothing, need), p, t, k) for k, (t, p, n, need) in enumerate(rows)], ["A", "B", "C"])


def test_analyzer_order():
    got = listed(("C", 1, "c1", ()), ("A", 1, "a1", ()), ("B", 1, "b1", ()), ("A", 2, "a2", ()), ("C", 0, "c0", ()))
    assert [got.names(t) for t in "ABC"] == [["a1", "a2"], ["b1"], ["c0", "c1"]]
    got = listed((None, 1, "g1", ()), ("B", 0, "b", ()), ("A", 0, "a0", ()), (None, 0, "g0", ()), ("A", 1, "a1", ()))
    assert [got.names(t) for t in ("A", "B", None)] == [["a0", "a1"], ["b"], ["g0", "g1"]]


def test_dependencies():
    listed(("A", 0, "base", ()), ("A", 1, "needs", ("base",)))
    with pytest.warns(UserWarning):
        listed((None, 0, "base", ()), ("A", 5, "needs", ("base",)))
    with pytest.raises(ValueError, match="Dependency gone not found for analyzer needs"):
        listed(("A", 0, "needs", ("gone",)))
    for a, b in ((5, 1), (3, 3)):
        with pytest.raises(ValueError, match="priority smaller"):
            listed(("A", a, "base", ()), ("A", b, "needs", ("base",)))


class Shrink:
    """One child, a byte shorter."""

    def entries(self, c, x):
        return F.when(c.size > 0, F.array(entry(c.path, c.size - 1)))

    def extract(self, c, x, e):
        return content(F.substring(c.content, F.lit(1), (c.size - 1).cast("int")), e["path"], "Nest")


@pytest.mark.parametrize("depth", [1, 3, 8])
def test_depth(spark, depth):
    result = ScannerBuilder(["Nest"]).add_extractor("Nest", Shrink()).max_depth(depth).build().scan(buffers(spark, [(bytes(16), "n", "Nest")]))
    assert result.objects_scanned().first()["objects"] == depth
    rows = result.objects.orderBy("object_id").collect()
    assert [r["parent_id"] for r in rows] == [None, *range(depth - 1)]


def test_values_folds_and_skip(spark):
    skip = Analyzer("skip", lambda c: Output(values={"tag": F.lit(99)}, action=F.when(c.size > 3, F.lit(SKIP))))
    late = Analyzer("late", lambda c: Output(values={"late": F.lit(1)}, folds={"n": ("count", c.size)}))
    b = ScannerBuilder(["Nest"]).add_analyzer("Nest", 0, skip).add_analyzer("Nest", 1, late).add_extractor("Nest", Shrink()).max_depth(3)
    result = b.build().scan(buffers(spark, [(b"12345", "a", "Nest"), (b"123", "b", "Nest"), (b"x", "c")]))
    values = {(r["scan_id"], r["object_id"], r["key"]) for r in result.values().collect()}
    assert values == {(0, 0, "tag"), *((1, k, n) for k in range(3) for n in ("tag", "late"))}
    assert {r["scan_id"]: r["objects"] for r in result.objects_scanned().collect()} == {0: 1, 1: 3, 2: 1}
    assert [(r["scan_id"], r["number"]) for r in result.globals().collect()] == [(1, 3)]


class Pick:
    """What a request names, under its tag."""

    def __init__(self, path, kind):
        self.path, self.kind = path, kind

    def entries(self, c, x):
        return F.array(entry(F.lit(self.path) if self.path else F.concat(F.lit("t"), F.variant_get(x.params, "$.tag", "string")), F.lit(0)))

    def extract(self, c, x, e):
        part = F.when(x.length.isNull(), F.expr("substring(content, 1)")).otherwise(F.substring(c.content, (x.offset + 1).cast("int"), x.length.cast("int")))
        return content(part, e["path"], self.kind)


def test_requests(spark):
    types = ["Root", "Mid", "MidKid", "Slice", "Left", "Right", "LeftKid", "Deep", "Missing"]
    ask = lambda *r: Analyzer("ask", lambda c: Output(requests=F.array(*r)))
    b = ScannerBuilder(types).add_analyzer("Root", 0, ask(request("Slice", 2, 3, {"tag": F.lit(9)}), request("Missing"))).add_extractor("Slice", Pick(None, "MidKid"))
    rows = b.build().scan(buffers(spark, [(b"XXABCYY", "root", "Root")])).objects.orderBy("object_id").collect()
    assert [(r["path"], r["size"], r["type"]) for r in rows] == [("root", 7, "Root"), ("t9", 3, "MidKid")]
    b = ScannerBuilder(types).add_analyzer("Root", 0, ask(request("Left"), request("Right"))).add_analyzer("LeftKid", 0, ask(request("Deep")))
    b.add_extractor("Left", Pick("left", "LeftKid")).add_extractor("Right", Pick("right", "MidKid")).add_extractor("Deep", Pick("deep", "MidKid"))
    result = b.build().scan(buffers(spark, [(b"root", "root", "Root")]))
    rows = {r["object_id"]: r for r in result.objects.collect()}
    assert [(rows[k]["path"], rows[k]["parent_id"]) for k in range(4)] == [("root", None), ("left", 0), ("deep", 1), ("right", 0)]
    links = {r["object_id"]: (r["first_child"], r["next_sibling"]) for r in result.links().collect()}
    assert links == {0: (1, None), 1: (2, 3), 2: (None, None), 3: (None, None)}
    lines = [r["line"] for r in result.tree_lines().orderBy("object_id").collect()]
    assert lines == ["root", "  left", "    deep", "  right"]


def test_findings_join_keeps_all_links(spark, tmp_path):
    html = "<!DOCTYPE html>" + "".join(f'<a href="/{k}">' for k in range(2500))
    spark.createDataFrame([(7, "http://a.com/x", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.findings_join(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["page_id"], r["seq"], r["finding"]) for r in rows] == [(7, k, f"/{k}") for k in range(2500)]


def test_findings(spark):
    a = Analyzer("a", lambda c: Output(findings=F.array(finding(F.lit("x"), metadata=F.struct(c.size.alias("n"))), finding(c.path, F.lit("src")))))
    rows = ScannerBuilder(["A"]).add_generic_analyzer(0, a).build().scan(buffers(spark, [(b"ab", "p", "A")])).findings().orderBy("seq").collect()
    assert [(r["seq"], r["finding"], r["source"], r["path"], r["type"]) for r in rows] == [(0, "x", None, "p", "A"), (1, "p", "src", "p", "A")]


def test_sums_beyond_64_bits(spark, tmp_path):
    most = 2**63 - 1
    texts = [(1, "card 4111111111111111\n" * 2500), (2, f"{most} and 1"), (3, f"{most} 0 99999999999999999999"), (4, "7 8"), (5, "99999999999999999999"), (6, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.number_sum(spark, str(tmp_path))
    assert found.schema["sum"].dataType.simpleString() == "bigint"
    assert {r["doc_id"]: r["sum"] for r in found.collect()} == {1: None, 2: None, 3: most, 4: 15}
    totals = queries._numbers(spark, str(tmp_path)).globals().where("number is null").select("scan_id", F.to_json("value"))
    assert {k: int(v) for k, v in totals.collect()} == {1: 4111111111111111 * 2500, 2: most + 1}


def test_filter_of_root_and_entries(spark):
    deny = FilterBuilder().include_extensions(Precedence.LOW, ["ok"]).deny_the_rest()
    scanner = ScannerBuilder(["Nest"]).filter(deny).add_extractor("Nest", Shrink()).build()
    rows = buffers(spark, [(b"12", "a.no", "Nest"), (b"12", "b.ok", "Nest")])
    assert {r["scan_id"]: r["objects"] for r in scanner.scan(rows, True).objects_scanned().collect()} == {1: 3}
    assert {r["scan_id"]: r["objects"] for r in scanner.scan(rows).objects_scanned().collect()} == {0: 1, 1: 3}


def test_examples(spark):
    result = ScannerBuilder(["TextBuffer"]).add_analyzer("TextBuffer", 0, P.VOWELS).build().scan(buffers(spark, [(b"TXBF   Hellow World !", "test.txt", "TextBuffer")]))
    assert result.globals().first()["value"].toPython() == 3
    b = ScannerBuilder(["Text", "Number"]).add_identifier(P.TEXT_NUMBERS).add_extractor("Text", P.NumberExtractor()).add_analyzer("Number", 0, P.NUMBER)
    result = b.build().scan(buffers(spark, [(b"TXT   10+20+30=", "test.txt")]))
    assert result.globals().first()["number"] == 60 and result.objects_scanned().first()["objects"] == 4
    note = b"Greeting: SGVsbG8sIHdvcmxkIQ==\nshort: QUJD\nVGhpcyBpcyBiYXNlNjQu and aGVsbG8gYWdhaW4h\n"
    b = ScannerBuilder(["Note", "Base64", "Base64Decoded"]).add_analyzer("Note", 0, P.BASE64_FINDER).add_extractor("Base64", P.Base64Extractor())
    show = Analyzer("show", lambda c: Output(values={"t": F.decode(c.content, "UTF-8")}))
    result = b.add_analyzer("Base64Decoded", 0, show).build().scan(buffers(spark, [(note, "sample.txt", "Note")]))
    assert [r["value"].toPython() for r in result.values().orderBy("object_id").collect()] == ["Hello, world!", "This is base64.", "hello again!"]
    assert result.objects.where("object_id = 1").first()["path"] == f"base64@{note.index(b'SGV')}"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + bytes(9)


def bmp(w, h):
    return b"BM" + bytes(16) + struct.pack("<II", w, h) + bytes(4)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\x00\xff\x01\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + bytes(12)


def archive(*members, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_images(spark):
    b = ScannerBuilder(["Png", "Bmp", "Jpeg"])
    for kind, i, a in (("Png", P.PNG, P.PNG_SIZE), ("Bmp", P.BMP, P.BMP_SIZE), ("Jpeg", P.JPEG, P.JPEG_SIZE)):
        b.add_identifier(i).add_analyzer(kind, 0, a)
    rows = b.build().scan(buffers(spark, [(png(640, 480), "a"), (bmp(3, 70000), "b"), (jpeg(17, 5), "c"), (b"BM", "d"), (b"\xff\xd8" + bytes(40), "e")])).values()
    got = {r["scan_id"]: r["value"].toPython() for r in rows.where("key = 'size'").collect()}
    assert got == {0: {"width": 640, "height": 480}, 1: {"width": 3, "height": 70000}, 2: {"width": 17, "height": 5}}


def test_zip(spark):
    z = archive(("a.png", png(9, 8)), ("folder/", b""), ("t.txt", b"hi"), ("../up.png", png(1, 1)), ("n.zip", archive(("x.png", png(2, 2)))), comment=b"note")
    rules = FilterBuilder().include_extensions(Precedence.LOW, ["png"]).deny_the_rest()
    b = ScannerBuilder(["Zip", "Png"]).add_identifier(P.ZIP).add_identifier(P.PNG).add_analyzer("Png", 0, P.PNG_SIZE).add_extractor("Zip", P.ZipExtractor()).filter(rules)
    rows = buffers(spark, [(z, "a.zip"), (z[:-1], "cut.zip"), (b"PK\x03\x04 not", "no.zip"), (b"PK\x05\x06" + bytes(18), "empty.zip")])
    got = b.build().scan(rows).objects.orderBy("scan_id", "object_id").collect()
    assert [(r["scan_id"], r["path"], r["type"]) for r in got] == [(0, "a.zip", "Zip"), (0, "a.png", "Png"), (1, "cut.zip", None), (2, "no.zip", None), (3, "empty.zip", None)]
    nested = ScannerBuilder(["Zip", "Png"]).add_identifier(P.ZIP).add_identifier(P.PNG).add_extractor("Zip", P.ZipExtractor()).build().scan(rows.where("scan_id = 0"))
    assert [r["path"] for r in nested.objects.orderBy("object_id").collect()] == ["a.zip", "a.png", "t.txt", "", "n.zip", "x.png"]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "real.txt").write_text("hello")
    (tmp_path / "sub/nested.txt").write_text("in")
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "_under").write_text("u")
    (tmp_path / "link_to_file").symlink_to(tmp_path / "real.txt")
    (tmp_path / "link_to_dir").symlink_to(tmp_path / "sub")
    (tmp_path / "dangling").symlink_to(tmp_path / "missing.txt")
    base = str(tmp_path) + "/"
    scanner = ScannerBuilder(["Folder"]).add_generic_analyzer(0, P.MD5).max_depth(64).build()
    for recursive, names in ((True, [".hidden", "_under", "link_to_file", "real.txt", "sub", "sub/nested.txt"]), (False, [".hidden", "_under", "link_to_file", "real.txt"])):
        result = scanner.scan(folder(spark, tmp_path, "Folder", recursive))
        rows = result.objects.orderBy("object_id").collect()
        assert [r["path"].removeprefix(base) for r in rows[1:]] == names
    result = scanner.scan(folder(spark, tmp_path, "Folder"))
    assert result.values().count() == 5 and result.objects.where("path like '%link_to_file'").first()["size"] == 5
    rules = FilterBuilder().include_extensions(Precedence.LOW, ["txt"]).deny_the_rest()
    kept = ScannerBuilder(["Folder"]).filter(rules).build().scan(folder(spark, tmp_path, "Folder"))
    assert {r["path"].removeprefix(base) for r in kept.objects.where("object_id > 0").collect()} == {"real.txt", "sub", "sub/nested.txt"}
    shallow = ScannerBuilder(["Folder"]).max_depth(2).build().scan(folder(spark, tmp_path, "Folder"))
    assert shallow.objects.where("path like '%nested%'").count() == 0
    skip = Analyzer("skip", lambda c: Output(action=F.when(c.path.endswith("sub"), F.lit(SKIP))))
    pruned = ScannerBuilder(["Folder"]).add_generic_analyzer(0, skip).build().scan(folder(spark, tmp_path, "Folder"))
    assert {r["path"].removeprefix(base) for r in pruned.objects.where("object_id > 0").collect()} == {".hidden", "_under", "link_to_file", "real.txt", "sub"}
    assert files(spark, tmp_path / "real.txt").select("size", "content").first() == (5, bytearray(b"hello"))


def test_streaming(spark, tmp_path):
    from bytegrove.streaming.landing import arriving, scan_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(png(1, 2))
    scanner = ScannerBuilder(["Png"]).add_identifier(P.PNG).add_analyzer("Png", 0, P.PNG_SIZE).build()
    for extra in (None, "b.bin"):
        if extra:
            (tmp_path / "in" / extra).write_bytes(b"other")
        scan_arriving(scanner, arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["type"] or "" for r in spark.read.parquet(f"{tmp_path}/out/batch=*/objects").collect()) == ["", "Png"]


# --- the set tier against the ordered tier ----------------------------------------------


class Split:
    """Children separated by commas; a child's type is its first letter, upper-cased."""

    def __init__(self, mark):
        self.mark = mark

    def entries(self, c, x):
        parts = F.filter(F.split(F.expr("substring(decode(content, 'ISO-8859-1'), 2)"), self.mark), lambda s: F.length(s) > 0)
        return F.transform(parts, lambda s: entry(F.concat(s, F.lit(".x")), F.length(s), s))

    def extract(self, c, x, e):
        return content(F.encode(e["locator"], "ISO-8859-1"), e["path"])


def plugins(stop):
    def split(mark):
        def extract(item, ask):
            for s in item.content.decode("latin-1")[1:].split(mark):
                if s:
                    yield O.Entry(s + ".x", len(s)), lambda s=s: O.Item(s + ".x", s.encode("latin-1"))

        return extract

    def length(item, ctx):
        ctx.set("n", len(item.content))
        ctx.globals["total"] = ctx.globals.get("total", 0) + len(item.content)
        return None

    def act(item, ctx):
        ctx.add_finding(item.path)
        if item.content.startswith(b"as"):
            return SKIP
        return EXIT if stop.encode() in item.content and len(item.content) < 6 else None

    def identify(item):
        return {b"a": "A", b"b": "B"}.get(item.content[:1])

    return O.Plugins(identify, [("A", 0, length), (None, 0, act)], [("A", split(";")), ("B", split(",")), ("A", split(","))], lambda p, n: n != 3, 4)


def test_set_tier_matches_ordered_tier(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aabbs,;;z") for _ in range(rng.randint(1, 40))) for _ in range(100)]
    rows = buffers(spark, [(t.encode(), "root") for t in texts])
    length = Analyzer("length", lambda c: Output(values={"n": c.size}, folds={"total": ("sum", c.size)}))
    text = lambda c: F.decode(c.content, "ISO-8859-1")
    act = Analyzer("act", lambda c: Output(findings=F.array(finding(c.path)), action=F.when(text(c).startswith("as"), F.lit(SKIP)).when(text(c).contains("z") & (c.size < 6), F.lit(EXIT))))
    b = ScannerBuilder(["A", "B"]).add_identifier(Identifier("A", magic=[b"a"])).add_identifier(Identifier("B", magic=[b"b"]))
    b.add_analyzer("A", 0, length).add_generic_analyzer(0, act).add_extractor("A", Split(";")).add_extractor("B", Split(",")).add_extractor("A", Split(",")).max_depth(4)
    result = b.filter(FilterBuilder().exclude(Precedence.LOW, lambda p, s: s == 3).allow_the_rest()).build().scan(rows)
    got = {(r["scan_id"], r["object_id"]): (r["parent_id"], r["depth"], r["path"], r["size"], r["type"], r["action"]) for r in result.objects.collect()}
    want = O.OrderedScanner(lambda: plugins("z")).scan(rows).collect()
    assert got == {(r["scan_id"], r["object_id"]): (r["parent_id"], r["depth"], r["path"], r["size"], r["type"], r["action"]) for r in want}
    assert len(got) > 150
    values = {(r["scan_id"], r["object_id"]): r["value"].toPython() for r in result.values().collect()}
    assert values == {(r["scan_id"], r["object_id"]): json.loads(r["values"])["n"] for r in want if r["values"]}
    totals = {r["scan_id"]: r["number"] for r in result.globals().collect()}
    assert totals == {r["scan_id"]: json.loads(r["globals"])["total"] for r in want if r["globals"] and json.loads(r["globals"])}
    assert result.findings().count() == sum(len(json.loads(r["findings"])) for r in want)


def test_ordered_tier_state_and_budget(spark):
    def factory():
        def budget(item, ctx):
            ctx.update("seen", lambda n: n + 1) or ctx.globals.update(seen=1)
            return EXIT if ctx.objects_scanned >= 3 else None

        def lines(item, ask):
            for k, s in enumerate(item.content.split(b"\n")):
                yield O.Entry(str(k), len(s)), lambda k=k, s=s: O.Item(str(k), s, "Line")

        return O.Plugins(lambda item: "Text", [(None, 0, budget)], [("Text", lines)])

    rows = O.OrderedScanner(factory).scan(buffers(spark, [(b"a\nb\nc\nd", "t"), (b"", "e")])).collect()
    assert [(r["scan_id"], r["path"]) for r in rows] == [(0, "t"), (0, "0"), (0, "1"), (1, "e"), (1, "0")]
    assert json.loads(rows[0]["globals"]) == {"seen": 3}
    item = O.Item("p", b"abc")
    assert (item.read(1, 9), item.read(3, 1), item.read(4, 1)) == (b"bc", b"", None)


def test_reader():
    from bytegrove.sources.reader import ItemReader

    r = ItemReader(O.Item("p", b"hello"))
    assert (r.read(2), r.seek(-1, io.SEEK_END), r.read(9), r.read(1), r.seek(99), r.read(1)) == (b"he", 4, b"o", b"", 99, b"")
    with pytest.raises(ValueError):
        r.seek(-1)
    with pytest.raises(EOFError):
        ItemReader(O.Item("p", None, size=4)).read(1)
    with zipfile.ZipFile(ItemReader(O.Item("z", archive(("a", b"data"))))) as z:
        assert z.read("a") == b"data"


def test_find_zips_in_a_folder(spark, tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "deep/er/a.dat").write_bytes(archive(("x", b"1")))
    (tmp_path / "deep/not.zip").write_bytes(b"PK\x03\x04")
    result = ScannerBuilder(["Folder", "Zip"]).add_identifier(P.ZIP).max_depth(64).build().scan(folder(spark, tmp_path, "Folder"))
    assert [r["path"] for r in result.objects.where("type = 'Zip'").collect()] == [f"{tmp_path}/deep/er/a.dat"]


def test_damaged_archives_leave_the_scan_alone(spark):
    good = archive(("t.txt", b"hi"))
    version = bytearray(good)
    version[good.rindex(b"PK\x01\x02") + 6] = 99  # a directory entry of an unknown version
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_LZMA) as z:
        z.writestr("l.txt", b"some text " * 50)
    broken = bytearray(out.getvalue())
    broken[45:60] = bytes(15)
    b = ScannerBuilder(["Zip"]).add_identifier(P.ZIP).add_extractor("Zip", P.ZipExtractor()).build()
    rows = buffers(spark, [(bytes(version), "v.zip"), (bytes(broken), "l.zip"), (good, "g.zip")])
    assert "t.txt" in [r["path"] for r in b.scan(rows).objects.collect()]
    assert P.zip_entries(bytes(version)) == [] and P.zip_member(bytes(broken), 0, None, 0) is None


def test_images_are_as_long_as_their_sizes_need(spark):
    b = ScannerBuilder(["Png", "Bmp"]).add_identifier(P.PNG).add_identifier(P.BMP).build()
    rows = b.scan(buffers(spark, [(png(1, 2)[:10], "a"), (png(1, 2), "b"), (b"BM" + bytes(23), "c"), (b"BM" + bytes(24), "d")])).objects
    assert [r["type"] for r in rows.orderBy("scan_id").collect()] == [None, "Png", None, "Bmp"]


def test_one_required_analyzer_may_be_a_string():
    assert Analyzer("n", lambda c: Output(), requires="base").requires == ("base",)


def test_zip_by_its_end_without_python(spark):
    end = lambda comment, said=None: b"PK\x05\x06" + bytes(16) + struct.pack("<H", len(comment) if said is None else said) + comment
    rng, head = random.Random(7), b"PK\x03\x04"
    data = [head, end(b""), head + end(b""), head + end(b"x", 2), head + end(b"PK\x05\x06"), head + end(end(b"no", 9)), head + end(end(b"in"), 5), head + end(b"a" * 65535), head + b"f" * 70000 + end(b"b" * 65535), head + end(b"c" * 65535) + b"d", head + end(b"")[:-1]]
    for _ in range(200):
        data.append(head + b"".join(rng.choice([b"PK", b"\x05", b"\x06", b"PK\x05\x06", bytes(17), b"\0", b"\xff\xe9", end(b""), end(bytes(rng.randint(0, 40)), rng.randint(0, 60))]) for _ in range(rng.randint(0, 8))))
    found = ScannerBuilder(["Zip"]).add_identifier(P.ZIP).build().scan(buffers(spark, [(b, "z") for b in data])).objects
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {k for k, b in enumerate(data) if b.startswith(head) and P.ends_like_zip(b[-P.TAIL :])}
    assert {r["scan_id"] for r in found.where("type = 'Zip'").collect()} == want and {2, 4, 7, 8} <= want and 10 < len(want) < 200


def test_python_gets_few_bytes_at_once(spark):
    held = pandas_udf(lambda s: pd.Series([int(s.map(len).sum())] * len(s)), "long")
    rows = spark.range(0, 48, 1, 1).select(F.col("id").alias("scan_id"), F.lit("p").alias("path"), F.expr("cast(repeat('x', 1000000) as binary)").alias("content"))
    values = ScannerBuilder(["Any"]).add_generic_analyzer(0, Analyzer("held", lambda c: Output(values={"held": held(c.content)}))).build().scan(rows).values()
    assert max(r["value"].toPython() for r in values.collect()) <= 6_000_000
    seen = O.OrderedScanner(lambda: O.Plugins(lambda item: "Text")).scan(rows.limit(3)).collect()
    assert [r["size"] for r in seen] == [1_000_000] * 3
