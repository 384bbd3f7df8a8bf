"""Ready-made identifiers, analyzers and extractors."""

from __future__ import annotations

import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.binary import starts_with, text_view, uint_be, uint_le
from .analyze import Analyzer, Output, request
from .extract import Extraction, content, entry
from .identify import Content, Identifier


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Types of Python functions are objects, as strings need a running session.
PLACES = T.ArrayType(_struct(offset=T.LongType(), length=T.LongType()))
SIZE = _struct(width=T.LongType(), height=T.LongType())
MEMBERS = T.ArrayType(_struct(path=T.StringType(), size=T.LongType(), skip_filter=T.BooleanType(), locator=T.StringType()))

# --- vowels -----------------------------------------------------------------------------


def count_vowels(c: Content) -> Column:
    """Vowels of a text buffer, whose first four bytes are its mark."""
    text = text_view(F.expr("substring(content, 5)"))
    return F.length(F.regexp_replace(text, "[^aeiouAEIOU]", "")).cast("long")


VOWELS = Analyzer("vowels", lambda c: Output(values={"vowels": count_vowels(c)}, folds={"count_vowels": ("set", count_vowels(c))}))

# --- numbers ----------------------------------------------------------------------------


class NumberExtractor:
    """Each run of digits is a child of type Number, its bytes the digits."""

    def entries(self, c: Content, x: Extraction) -> Column:
        runs = F.regexp_extract_all(text_view(c.content), F.lit("[0-9]+"), F.lit(0))
        return F.transform(runs, lambda r: entry(F.lit("number"), F.length(r), r))

    def extract(self, c: Content, x: Extraction, e: Column) -> Column:
        return content(F.encode(e["locator"], "ISO-8859-1"), e["path"], "Number")


def _number(c: Content) -> Column:
    return F.expr("try_cast(decode(content, 'ISO-8859-1') as bigint)")


NUMBER = Analyzer("number", lambda c: Output(values={"value": _number(c)}, folds={"sum": ("sum", _number(c))}))
TEXT_NUMBERS = Identifier("Text", magic=[b"TXT"])

# --- base64 -----------------------------------------------------------------------------

#: Runs of this length and more whose length is a multiple of four are taken for Base64.
BASE64_RUN = 16


@pandas_udf(PLACES)
def _base64_places(data: pd.Series) -> pd.Series:
    run = re.compile(rb"[A-Za-z0-9+/]+={0,2}")
    return data.map(lambda b: [(m.start(), len(m[0])) for m in run.finditer(b) if len(m[0]) >= BASE64_RUN and len(m[0]) % 4 == 0] if b is not None else None)


BASE64_FINDER = Analyzer("base64", lambda c: Output(requests=F.transform(_base64_places(c.content), lambda p: request("Base64", p["offset"], p["length"]))))


class Base64Extractor:
    """The decoded bytes of the part that a request names."""

    def entries(self, c: Content, x: Extraction) -> Column:
        return F.array(entry(F.concat(F.lit("base64@"), x.offset.cast("string")), F.floor(x.length / 4) * 3))

    def extract(self, c: Content, x: Extraction, e: Column) -> Column:
        part = F.decode(F.substring(c.content, (x.offset + 1).cast("int"), x.length.cast("int")), "ISO-8859-1")
        data = F.try_to_binary(part, F.lit("base64"))
        return F.when(data.isNotNull(), content(data, e["path"], "Base64Decoded"))


# --- images -----------------------------------------------------------------------------

#: Bytes that a PNG or BMP has at least for its size to be in it.
PNG_BYTES, BMP_BYTES = 24, 26
PNG = Identifier("Png", magic=[b"\x89PNG\r\n\x1a\n"], validate=lambda c: c.size >= PNG_BYTES)
BMP = Identifier("Bmp", magic=[b"BM"], validate=lambda c: c.size >= BMP_BYTES)
JPEG = Identifier("Jpeg", magic=[b"\xff\xd8"])


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.alias("width"), height.alias("height"))


def _png(c: Content) -> Column:
    return F.when(c.size >= PNG_BYTES, _size(uint_be(c.content, 16, 4), uint_be(c.content, 20, 4)))


def _bmp(c: Content) -> Column:
    return F.when(c.size >= BMP_BYTES, _size(uint_le(c.content, 18, 4), uint_le(c.content, 22, 4)))


#: Fixed values of the format: markers of frames, and markers without a body.
FRAMES = {*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}
BARE = {0x01, *range(0xD0, 0xDA)}


def jpeg_segments(data: bytes) -> Iterator[tuple[int, int]]:
    """Markers of a JPEG and where each one's body lies, length included; bytes between segments are passed over."""
    at = 2 if data.startswith(b"\xff\xd8") else len(data)
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 9:
        marker = data[at + 1]
        yield marker, at + 2
        at += 2 if marker in BARE else 2 + int.from_bytes(data[at + 2 : at + 4], "big")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header."""
    frame = next((body for marker, body in jpeg_segments(data) if marker in FRAMES), None)
    return None if frame is None else struct.unpack_from(">HH", data, frame + 3)[::-1]


@pandas_udf(SIZE)
def _jpeg(data: pd.Series) -> pd.DataFrame:
    found = [jpeg_size(b) if b is not None else None for b in data]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int64"), "height": pd.array([f and f[1] for f in found], "Int64")})


def _present(size: Column) -> Column:
    return F.when(size["width"].isNotNull(), size)


def _sized(name: str, measure) -> Analyzer:
    return Analyzer(name, lambda c: Output(values={"file_size": c.size, "size": (measure(c), True)}))


PNG_SIZE, BMP_SIZE = _sized("png", _png), _sized("bmp", _bmp)
JPEG_SIZE = _sized("jpeg", lambda c: _present(_jpeg(c.content)))

# --- digests ----------------------------------------------------------------------------

#: MD5 of everything but folders; what can't be read counts as empty.
MD5 = Analyzer("md5", lambda c: Output(values={"md5": F.when(~F.coalesce(c.is_folder, F.lit(False)), F.md5(F.coalesce(c.content, F.lit(b""))))}))

# --- ZIP --------------------------------------------------------------------------------

EOCD, TAIL = b"PK\x05\x06", 65557
#: What a damaged or unknown archive or member raises; it ends neither the task nor the scan.
DAMAGED = (zipfile.BadZipFile, OSError, ValueError, RuntimeError, EOFError, IndexError, struct.error, zlib.error, lzma.LZMAError)


def ends_like_zip(tail: bytes | None) -> bool:
    """Whether an end record lies so that its comment reaches exactly to the end."""
    at = -1 if tail is None else tail.rfind(EOCD)
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            return True
        at = tail.rfind(EOCD, 0, at)
    return False


def _ends_like_zip(data: Column) -> Column:
    """The same test as an expression: between the parts of the tail that end records separate."""
    size, tail = F.length(data), F.substr(data, F.lit(-TAIL))

    def step(acc: Column, part: Column) -> Column:
        at = acc["at"] + F.length(part)
        comment = F.conv(F.concat(F.hex(F.substring(data, at + 22, 1)), F.hex(F.substring(data, at + 21, 1))), 16, 10).cast("int")
        return F.struct((at + len(EOCD)).alias("at"), (acc["ends"] | ((at + 22 <= size) & (at + 22 + comment == size))).alias("ends"))

    start = F.struct((size - F.length(tail)).alias("at"), F.lit(False).alias("ends"))
    return F.aggregate(F.split(text_view(tail), EOCD.decode("ISO-8859-1"), -1), start, step)["ends"]


def _is_zip(c: Content) -> Column:
    return F.when(starts_with(c.content, b"PK\x03\x04"), _ends_like_zip(c.content))


ZIP = Identifier("Zip", magic=[b"PK\x03\x04"], validate=_is_zip)


def safe_name(name: str) -> str:
    """A member's name, empty if it is absolute or leads out of the archive."""
    if "\0" in name or name.startswith(("/", "\\")):
        return ""
    level = 0
    for part in re.split(r"[/\\]", name):
        level += -1 if part == ".." else 0 if part in ("", ".") else 1
        if level < 0:
            return ""
    return name


def _archive(data: bytes, offset: int, length) -> zipfile.ZipFile:
    end = len(data) if length is None or pd.isna(length) else offset + int(length)
    return zipfile.ZipFile(io.BytesIO(data[offset:end]))


def zip_entries(data: bytes | None, offset: int = 0, length=None) -> list[tuple[str, int, bool, str]]:
    """Members in the order of the directory, folders left out."""
    if data is None:
        return []
    try:
        with _archive(data, offset, length) as z:
            return [(safe_name(i.filename), i.file_size, False, str(k)) for k, i in enumerate(z.infolist()) if not i.is_dir()]
    except DAMAGED:
        return []


def zip_member(data: bytes | None, offset: int, length, number: int) -> bytes | None:
    try:
        with _archive(data, offset, length) as z:
            return z.read(z.infolist()[number])
    except DAMAGED:
        return None


@pandas_udf(MEMBERS)
def _zip_entries(data: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([zip_entries(d, int(o), n) for d, o, n in zip(data, offset, length, strict=True)])


@pandas_udf(T.BinaryType())
def _zip_member(data: pd.Series, offset: pd.Series, length: pd.Series, number: pd.Series) -> pd.Series:
    return pd.Series([zip_member(d, int(o), n, int(k)) for d, o, n, k in zip(data, offset, length, number, strict=True)])


class ZipExtractor:
    """Members of an archive; ``whole_parent`` ignores the part that a request names."""

    def __init__(self, whole_parent: bool = False):
        self.whole_parent = whole_parent

    def _part(self, c: Content, x: Extraction) -> tuple[Column, Column]:
        return (F.lit(0).cast("long"), c.size) if self.whole_parent else (x.offset, x.length)

    def entries(self, c: Content, x: Extraction) -> Column:
        return _zip_entries(c.content, *self._part(c, x))

    def extract(self, c: Content, x: Extraction, e: Column) -> Column:
        data = _zip_member(c.content, *self._part(c, x), e["locator"].cast("long"))
        return F.when(data.isNotNull(), content(data, e["path"]))
