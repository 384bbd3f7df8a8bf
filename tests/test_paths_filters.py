import pytest
from pyspark.sql import functions as F

from bytegrove.functions import paths
from bytegrove.functions.matcher import Patterns
from bytegrove.operators.filters import FilterBuilder, Precedence

PATHS = [
    ("/home/user/file.txt", "file.txt", "txt"),
    ("C:\\Users\\me\\file.txt", "file.txt", "txt"),
    ("C:\\Users/me\\docs/file.txt", "file.txt", "txt"),
    ("/home\\user/file.txt", "file.txt", "txt"),
    ("README", "README", ""),
    ("/home/user/", "", ""),
    ("", "", ""),
    ("archive.tar.gz", "archive.tar.gz", "gz"),
    (".gitignore", ".gitignore", "gitignore"),
    (".tar.gz", ".tar.gz", "gz"),
    ("file.", "file.", ""),
    (".", ".", ""),
    ("C:\\docs\\report.PDF", "report.PDF", "PDF"),
    ("a/line\nfeed.x", "line\nfeed.x", "x"),
]


def test_names_and_extensions(spark):
    df = spark.createDataFrame([(p,) for p, *_ in PATHS], "path string")
    name = paths.file_name(paths.byte_view(F.col("path")))
    got = df.select("path", name.alias("n"), paths.extension(name).alias("e")).collect()
    assert [tuple(r) for r in got] == PATHS


def test_folding_is_ascii_only(spark):
    df = spark.createDataFrame([("K\u212aÄ",)], "x string")
    assert df.select(paths.ascii_lower("x")).first()[0] == "k\u212aÄ"


def test_paths_that_are_not_utf8():
    assert paths.path_columns(b"a\xff") == ("a\ufffd", b"a\xff")
    assert paths.path_columns("é") == ("é", None)


def verdicts(spark, rules, cases):
    df = spark.createDataFrame([(p, s) for p, s, _ in cases], "path string, size long")
    return [r[0] for r in df.select(rules.passes(F.col("path"), F.col("size"))).collect()]


L, M, H, HH = Precedence.LOW, Precedence.MEDIUM, Precedence.HIGH, Precedence.HIGHEST
B = FilterBuilder
FILTERS = [
    (lambda: B().include_extensions(L, ["txt"]).exclude_extensions(HH, ["txt"]).allow_the_rest(), {"notes.txt": False, "notes.rs": True}),
    (lambda: B().exclude_extensions(L, ["txt"]).include_extensions(H, ["txt"]).deny_the_rest(), {"notes.txt": True, "notes.rs": False}),
    (lambda: B().include_extensions(M, ["txt"]).exclude_extensions(M, ["txt"]).deny_the_rest(), {"notes.txt": True}),
    (lambda: B().exclude_extensions(M, ["txt"]).include_extensions(M, ["txt"]).allow_the_rest(), {"notes.txt": False}),
    (lambda: B().include_extensions(M, ["jpg"]).deny_the_rest(), {"Photo.JPG": True, "photo.Jpg": True, "C:\\Photos\\IMG.JPG": True, "/home/me/pic.JpG": True, "notes.txt": False}),
    (lambda: B().include_extensions(M, ["JPG", "Bmp"]).deny_the_rest(), {"photo.jpg": True, "x.BMP": True, "x.png": False}),
    (lambda: B().include_file_names(M, ["Makefile"]).deny_the_rest(), {"MAKEFILE": True, "/src/Makefile": True, "C:\\src\\makefile": True, "makefile.txt": False}),
    (lambda: B().exclude_file_names(H, ["Cargo.lock"]).allow_the_rest(), {"CARGO.LOCK": False, "Cargo.toml": True}),
    (lambda: B().include_extensions(M, ["gz"]).deny_the_rest(), {"archive.TAR.GZ": True, "archive.tar": False, "noext": False}),
    (lambda: B().include_extensions(M, ["k"]).deny_the_rest(), {"x.\u212a": False, "x.K": True}),
    (lambda: B().include_extensions(M, [""]).deny_the_rest(), {"noext": False}),
    (lambda: B().exclude(H, lambda p, s: F.lit(None).cast("boolean")).include(L, lambda p, s: s > 5).deny_the_rest(), {"a": True}),
    (lambda: B().exclude(H, lambda p, s: s > 5).allow_the_rest(), {"a": False}),
]


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_filters(spark, k):
    make, cases = FILTERS[k]
    assert verdicts(spark, make(), [(p, 10, v) for p, v in cases.items()]) == list(cases.values())


def match(spark, pairs, text, **options):
    df = spark.createDataFrame([(text,)], "x string")
    p = Patterns(pairs)
    return tuple(df.select(p.longest_prefix(F.col("x")), p.exact(F.col("x"), **options)).first())


def test_matchers(spark):
    abc = [("a", "1"), ("ab", "2"), ("abc", "3")]
    assert match(spark, abc, "abcd") == ("3", None)
    assert match(spark, abc, "ax") == ("1", None)
    assert match(spark, abc, "") == (None, None)
    words = [("app", "10"), ("apple", "20"), ("apply", "30")]
    assert match(spark, words, "application") == ("10", None)
    assert match(spark, words, "apple") == ("20", "20")
    assert match(spark, words, "appl") == ("10", None)
    assert match(spark, words, "appl", trie_prefix=True) == ("10", "10")
    assert match(spark, [("key", "1"), ("keyed", "0"), ("key", "2")], "key") == ("2", "2")
    assert match(spark, [("PK", "first"), ("PK", "second")], "PK") == ("first", "first")
    assert match(spark, [("PK", "A"), ("PK\x03\x04", "B")], "PK\x03\x04extra") == ("B", None)
    assert match(spark, [("PK", "A"), ("PK\x03\x04", "B")], "PKxxxx") == ("A", None)
    many = [(f"w{k}", str(k)) for k in range(40)]
    assert match(spark, many, "w7") == ("7", "7")
    assert match(spark, many, "w39x") == ("39", None)
