"""Baseline JPEG media columns: lossless coefficient storage, a decoder, DC-only thumbnails.

Storage. A payload byte is one quantised DCT coefficient, the format's own unit: the byte is
the 8 magnitude bits of a category-8 coefficient (values -255..-128 and 128..255, exactly 256),
so no rounding ever happens. Payload bytes fill 8x8 blocks in zigzag order. The Huffman tables
have one code each, so a coefficient takes 9 bits and a block 72 whole bytes; a restart marker
after each block resets the DC prediction. Rows of blocks past the payload hold zero bytes. A
comment segment tells the number of bytes. The files are baseline sequential JPEG, grey scale.

Decoder. It parses markers, removes stuffing, and Huffman-decodes baseline scans of one or more
components with any tables, sampling and restart interval. All restart intervals of all images
of a batch with the same tables run side by side in numpy, one symbol a step.

Thumbnails take the luminance DC coefficients alone (mean of each block), and their hash has a
bit for each cell of an 8x8 grid brighter than the grid's mean.

Defined cases: a null, damaged, truncated or foreign medium, or one that isn't baseline or has separate
scans, has an error and no features; a baseline image without payload has features alone; a null text counts as empty (one padded unit of 576 bytes); equal texts give
equal values; an empty table gives no rows; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_slices

#: Payloads are padded with PAD_BYTE to a positive multiple of UNIT bytes (3 x 3 blocks).
UNIT, PAD_BYTE = 576, 255
#: Blocks in a column of an image at most: 8 * 8190 lines are under the format's 65535.
MAX_ROWS = 8190
#: Payload bytes coded or decoded at a time by one worker.
SLICE_BYTES = 1 << 20


# --- writing ----------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    return text + bytes([PAD_BYTE]) * (-len(text) % UNIT or (0 if text else UNIT))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(blocks: int, n_bytes: int, n_payload: int) -> tuple[bytes, int]:
    """All before the scan data, and the number of blocks of the image."""
    wide = 3 * max(1, -(-blocks // (3 * MAX_ROWS)))
    high = -(-blocks // wide)
    one_code = bytes([1] + [0] * 15 + [8])  # one code, of one bit, for category 8
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xFE, struct.pack(">8sQQ", b"payload\0", n_bytes, n_payload))
        + _segment(0xDB, bytes([0]) + bytes([1] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + one_code)
        + _segment(0xC4, b"\x10" + one_code)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        wide * high,
    )


def encode(texts: list[bytes]) -> list[bytes]:
    """For each text (UTF-8) a JPEG that holds its padded payload."""
    heads, sizes, parts = [], [], []
    for t in texts:
        p = padded(t)
        head, blocks = _head(len(p) // 64, len(t), len(p))
        heads.append(head)
        sizes.append(blocks)
        parts.append(p + bytes(64 * blocks - len(p)))
    b = np.frombuffer(b"".join(parts), "u1").reshape(-1, 8)
    # Eight coefficients of a zero bit and eight magnitude bits are nine bytes.
    nine = np.zeros((len(b), 9), "u1")
    for j in range(8):
        nine[:, j] |= b[:, j] >> (j + 1) if j < 7 else 0
        nine[:, j + 1] |= b[:, j] << (7 - j)
    n = len(nine) // 8
    scan = np.empty((n, 74), "u1")
    scan[:, :72] = nine.reshape(n, 72)
    first = np.cumsum([0, *sizes])
    scan[:, 72] = 0xFF
    scan[:, 73] = 0xD0 + (np.arange(n) - np.repeat(first[:-1], sizes)) % 8
    scan[first[1:] - 1, 73] = 0xD9  # the last block ends the image
    stuffed = scan[:, :72] == 0xFF
    step = np.ones((n, 74), "int64")
    step[:, :72] += stuffed
    end = np.cumsum(step.reshape(-1))
    out = np.zeros(int(end[-1]), "u1")
    out[end - step.reshape(-1)] = scan.reshape(-1)
    cuts = [0, *end.reshape(n, 74)[first[1:] - 1, 73].tolist()]
    raw = out.tobytes()
    return [h + raw[a:z] for h, a, z in zip(heads, cuts[:-1], cuts[1:], strict=True)]


# --- reading ----------------------------------------------------------------------------


@dataclass
class Image:
    """What the markers tell, and the scan data without stuffing."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id: counts and symbols
    chosen: dict[int, tuple[int, int]] = field(default_factory=dict)  # component: DC, AC table
    restart: int = 0
    comment: bytes = b""
    data: np.ndarray | None = None
    starts: np.ndarray | None = None  # of the restart intervals in data

    def mcu(self) -> tuple[int, int, int]:
        """Units across and down, and blocks of a unit."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8), 1
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), sum(c[1] * c[2] for c in self.components)

    def order(self) -> list[int]:
        """The component of each block of a unit."""
        if len(self.components) == 1:
            return [0]
        return [k for k, c in enumerate(self.components) for _ in range(c[1] * c[2])]


def parse(media: bytes) -> Image:
    """Read the markers of a baseline JPEG up to its scan, and unstuff the scan."""
    if bytes(media[:2]) != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at = Image(), 2
    while True:
        if media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype("int64")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out.tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xC0:
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.components = [(c, s >> 4, s & 15, q) for c, s, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline images are decoded")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            ids = {c[0]: k for k, c in enumerate(out.components)}
            if body[0] != len(out.components):
                raise ValueError("only one interleaved scan is decoded")
            out.chosen = {ids[c]: (t >> 4, 0x10 | t & 15) for c, t in struct.iter_unpack("BB", body[1 : 1 + 2 * body[0]])}
            break
    raw = np.frombuffer(media, "u1", offset=at)
    after = np.where(raw[:-1] == 0xFF)[0]
    kind = raw[after + 1]
    marks = after[(kind != 0) & (kind != 0xFF)]
    end = marks[(raw[marks + 1] & 0xF8) != 0xD0]
    if not len(end):
        raise ValueError("the image has no end")
    end = int(end[0])
    keep = np.ones(end, bool)
    stuffing = after[(kind == 0) & (after < end)] + 1
    rst = marks[marks < end]
    keep[stuffing[stuffing < end]] = False
    keep[rst] = keep[rst + 1] = False
    out.data = raw[:end][keep]
    gone = np.cumsum(~keep)
    out.starts = np.concatenate([[0], rst + 2 - gone[rst + 1]]).astype("int64")
    return out


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: the code's length (0: none) and symbol."""
    length, symbol = np.zeros(1 << 16, "int64"), np.zeros(1 << 16, "int64")
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            a = code << (16 - bits)
            length[a : a + (1 << (16 - bits))], symbol[a : a + (1 << (16 - bits))] = bits, table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length, symbol


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients of each image in scan order: blocks x 64, in zigzag order."""
    out: list[np.ndarray | None] = [None] * len(images)
    alike = defaultdict(list)
    for i, im in enumerate(images):
        alike[(tuple(im.order()), tuple(sorted(im.chosen.items())), tuple(sorted(im.tables.items())))].append(i)
    for (order, chosen, tables), members in alike.items():
        got = _decode([images[i] for i in members], list(order), dict(chosen), dict(tables))
        for i, c in zip(members, got, strict=True):
            out[i] = c
    return out


def _decode(images: list[Image], order: list[int], chosen: dict, tables: dict) -> list[np.ndarray]:
    per_unit = len(order)
    ids = sorted(tables)
    pairs = [_lookup(tables[t]) for t in ids]
    lengths, symbols = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    dc_of = np.array([ids.index(chosen[c][0]) << 16 for c in order])
    ac_of = np.array([ids.index(chosen[c][1]) << 16 for c in order])
    data = np.concatenate([*(im.data for im in images), np.zeros(8, "u1")]).astype("int64")
    window = (data[:-7] << 32) | (data[1:-6] << 24) | (data[2:-5] << 16) | (data[3:-4] << 8) | data[4:-3]
    base = np.cumsum([0, *(len(im.data) for im in images)])
    totals = [im.mcu()[0] * im.mcu()[1] * per_unit for im in images]
    first_block = np.cumsum([0, *totals])
    at, row, stop = [], [], []
    for im, b, f, total in zip(images, base, first_block, totals, strict=False):
        each = im.restart * per_unit if im.restart else total
        lane = np.arange(len(im.starts), dtype="int64")[: -(-total // each)]
        at.append(8 * (im.starts[: len(lane)] + b))
        row.append(f + lane * each)
        stop.append(f + np.minimum((lane + 1) * each, total))
    at, row, stop = map(np.concatenate, (at, row, stop))
    begun = row.copy()
    coef = np.zeros(int(first_block[-1]) * 64, "int16")
    last = len(window) - 1
    k = np.zeros(len(at), "int64")
    place = np.zeros(len(at), "int64")  # of the block in its unit
    single = per_unit == 1
    while len(at):
        w, s = window[np.minimum(at >> 3, last)], at & 7
        which = np.where(k == 0, dc_of[0] if single else dc_of[place], ac_of[0] if single else ac_of[place])
        code = which + ((w >> (24 - s)) & 0xFFFF)
        n, sym = lengths[code], symbols[code]
        if not n.all():
            raise ValueError("a code is in no table")
        size = np.where(k == 0, sym, sym & 15)
        value = (w >> (40 - s - n - size)) & ((1 << size) - 1)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        at = at + n + size
        run = np.where(k == 0, 0, sym >> 4)
        ends = (k > 0) & (size == 0) & (run < 15)
        k = k + run
        put = size > 0
        if put.all():
            coef[row * 64 + k] = value
        else:
            coef[(row * 64 + k)[put]] = value[put]
        k = np.where(ends, 64, k + 1)
        over = k >= 64
        if over.any():
            k = np.where(over, 0, k)
            row = row + over
            place = (place + over) % per_unit
            live = row < stop
            if not live.all():
                at, row, stop, k, place = at[live], row[live], stop[live], k[live], place[live]
    coef = coef.reshape(-1, 64)
    # DC values are differences within a restart interval, by component.
    kinds = np.array(order)
    out = []
    starts = set(begun.tolist())
    for im, a, z in zip(images, first_block[:-1], first_block[1:], strict=True):
        c = coef[a:z]
        if im.restart * per_unit != 1:  # else each block has its own prediction
            kind = kinds[np.arange(z - a) % per_unit]
            cut = np.array([a + i in starts for i in range(z - a)])
            lane = np.cumsum(cut)
            for comp in set(order):
                for one in np.unique(lane):
                    mine = (kind == comp) & (lane == one)
                    c[mine, 0] = np.cumsum(c[mine, 0])
        out.append(c)
    return out


def thumbnail(image: Image, coef: np.ndarray) -> np.ndarray:
    """Mean luminance of each 8x8 block, from DC coefficients alone."""
    wide, high, per_unit = image.mcu()
    _, h, v, q = image.components[0]
    dc = coef[:, 0].astype("int64").reshape(high, wide, per_unit)
    if len(image.components) == 1:
        h = v = 1
    grid = dc[:, :, : h * v].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip(grid * image.quantisers[q][0] / 8 + 128, 0, 255).astype("u1")


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: which cells of an 8x8 grid over the thumbnail are above their mean."""
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    sums = thumb.astype("int64").cumsum(0).cumsum(1)
    sums = np.pad(sums, ((1, 0), (1, 0)))
    top, low = rows, np.maximum(rows + 1, (np.arange(8) + 1) * thumb.shape[0] // 8)
    lft, rgt = cols, np.maximum(cols + 1, (np.arange(8) + 1) * thumb.shape[1] // 8)
    area = (low - top)[:, None] * (rgt - lft)[None, :]
    cell = (sums[np.ix_(low, rgt)] - sums[np.ix_(top, rgt)] - sums[np.ix_(low, lft)] + sums[np.ix_(top, lft)]) / area
    return np.packbits(cell.reshape(-1) > cell.mean()).tobytes().hex()


#: What damaged or foreign bytes raise on their way through the decoder.
DAMAGED = (ValueError, IndexError, KeyError, struct.error)


def decoded(media: list[bytes | None]) -> list[tuple[Image | None, np.ndarray | None, str | None]]:
    """Image, coefficients and no error of each medium; or the error. One damaged image leaves the others alone."""
    images: list[Image | None] = []
    errors: list[str | None] = []
    for m in media:
        try:
            images.append(parse(m) if m is not None else None)
            errors.append(None if m is not None else "null")
        except DAMAGED as e:
            images.append(None)
            errors.append(str(e) or type(e).__name__)
    good = [k for k, im in enumerate(images) if im]
    found: list[np.ndarray | None] = [None] * len(images)
    try:
        for k, c in zip(good, coefficients([images[k] for k in good]), strict=True):
            found[k] = c
    except DAMAGED:
        for k in good:
            try:
                found[k] = coefficients([images[k]])[0]
            except DAMAGED as e:
                errors[k] = str(e) or type(e).__name__
    return list(zip(images, found, errors, strict=True))


def payload(image: Image, coef: np.ndarray) -> tuple[bytes | None, int | None]:
    """The stored payload and the number of its bytes before padding; None in images that hold none."""
    if len(image.comment) != 24 or not image.comment.startswith(b"payload\0"):
        return None, None
    _, n_bytes, n_payload = struct.unpack(">8sQQ", image.comment)
    return np.where(coef < 0, coef + 255, coef).astype("u1").tobytes()[:n_payload], n_bytes


# --- columns ----------------------------------------------------------------------------


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media: each whole text as a JPEG."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch, SLICE_BYTES):
                part = batch.slice(i, j - i)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(texts), pa.binary())], ["doc_id", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_hash string, error string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode the stored images: payload digests, dimensions and thumbnail hashes; ``error`` says why there are none."""
    prepare(media.sparkSession)
    names = [c.strip().split(" ")[0] for c in FEATURES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch, SLICE_BYTES):
                part = batch.slice(i, j - i)
                stored = part.column(1).to_pylist()
                rows = []
                for doc, m, (im, c, error) in zip(part.column(0).to_pylist(), stored, decoded(stored), strict=True):
                    media = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                    if error:
                        rows.append((doc, None, None, None, None, *media, None, None, None, None, error))
                        continue
                    p, n = payload(im, c)
                    stated = (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) if p is not None else (None,) * 4
                    h = thumbnail_hash(thumbnail(im, c))
                    rows.append((doc, *stated, *media, f"{im.width}x{im.height}:{h}", im.width, im.height, h, None))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)
