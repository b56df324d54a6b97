"""Pictures: sizes by magic number, PNG decoding, and the form in which a PDF holds a picture."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def jpeg_info(data: bytes) -> tuple[int, int, int] | None:
    """Width, height and components from the frame header."""
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h, data[at + 9]
        at += 2 + size
    return None


def png_chunks(data: bytes) -> dict[bytes, bytes]:
    """Header, palette, transparency and joined data; empty unless header and data are there."""
    out: dict[bytes, bytes] = {}
    at = 8
    while data.startswith(PNG) and at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size:
            break
        if kind == b"IDAT":
            out[kind] = out.get(kind, b"") + body
        elif kind in (b"IHDR", b"PLTE", b"tRNS"):
            out.setdefault(kind, body)
        elif kind == b"IEND":
            break
        at += 12 + size
    return out if len(out.get(b"IHDR", b"")) >= 13 and out.get(b"IDAT") else {}


def probe(data: bytes | None) -> tuple[int, int]:
    """Pixel size by content, whatever the file is called; 0, 0 if unknown."""
    data = data or b""
    if data.startswith(PNG) and (chunks := png_chunks(data)):
        return struct.unpack_from(">II", chunks[b"IHDR"])
    if data.startswith(b"\xff\xd8") and (info := jpeg_info(data)):
        return info[:2]
    return 0, 0


def unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray | None:
    """Scan lines with PNG's five filters undone; None if they are cut short or a filter is unknown."""
    if len(raw) < rows * (stride + 1):
        return None
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).copy()
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            done, up = line.tolist(), above.tolist()
            for x in range(stride):
                a, b, c = (done[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                done[x] = (done[x] + guess) & 255
            line = np.array(done, np.uint8)
        elif kind:
            return None
        out[y] = above = line
    return out


@dataclass
class Encoded:
    """A picture as a PDF stream: its filter, colour space, size, data, and a mask of opacities if some pixel isn't opaque."""

    filter: str
    space: str
    width: int
    height: int
    data: bytes
    mask: bytes | None = None


def decode_png(data: bytes) -> Encoded | None:
    """Eight-bit PNGs without interlacing; None for others and for damaged ones."""
    chunks = png_chunks(data)
    if not chunks:
        return None
    width, height, depth, kind, _, _, interlace = struct.unpack_from(">IIBBBBB", chunks[b"IHDR"])
    if depth != 8 or interlace or kind not in CHANNELS or not width or not height:
        return None
    n = CHANNELS[kind]
    try:
        raw = zlib.decompressobj().decompress(chunks[b"IDAT"])
    except zlib.error:
        return None
    pixels = unfilter(raw, height, width * n, n)
    if pixels is None:
        return None
    pixels = pixels.reshape(height, width, n)
    alpha = None
    if kind == 3:
        palette = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8)
        palette = palette[: len(palette) // 3 * 3].reshape(-1, 3)
        index = pixels[..., 0]
        if not len(palette):
            return None
        opacity = np.full(256, 255, np.uint8)
        given = np.frombuffer(chunks.get(b"tRNS", b""), np.uint8)[:256]
        opacity[: len(given)] = given
        pixels, alpha = np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])[index], opacity[index]
    elif kind in (4, 6):
        pixels, alpha = pixels[..., :-1], pixels[..., -1]
    mask = zlib.compress(alpha.tobytes(), 9) if alpha is not None and (alpha != 255).any() else None
    return Encoded("FlateDecode", "DeviceGray" if pixels.shape[2] == 1 else "DeviceRGB", width, height, zlib.compress(np.ascontiguousarray(pixels).tobytes(), 9), mask)


def encode_for_pdf(data: bytes | None) -> Encoded | None:
    """JPEGs of one or three components as they are; PNGs decoded; None for what a PDF can't show this way."""
    data = data or b""
    if data.startswith(b"\xff\xd8"):
        info = jpeg_info(data)
        return Encoded("DCTDecode", "DeviceGray" if info[2] == 1 else "DeviceRGB", info[0], info[1], data) if info and info[2] in (1, 3) else None
    return decode_png(data) if data.startswith(PNG) else None


def probed(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Adds px_w and px_h of pictures in a binary column."""
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("px_w", T.IntegerType()), T.StructField("px_h", T.IntegerType())])

    def run(batches):
        for b in batches:
            sizes = [probe(x) for x in b.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1)]], names=[*keep, "px_w", "px_h"])

    return df.select(*dict.fromkeys([*keep, content])).mapInArrow(run, schema)


def decoded(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Adds space (DeviceGray or DeviceRGB), px_w, px_h and pixels (samples by row, 8 bits each) of PNG files; null for what isn't one."""
    made = [T.StructField("space", T.StringType()), T.StructField("px_w", T.IntegerType()), T.StructField("px_h", T.IntegerType()), T.StructField("pixels", T.BinaryType())]
    schema = T.StructType([*df.select(*keep).schema.fields, *made])
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())

    def run(batches):
        for b in batches:
            found = [decode_png(x) if x else None for x in b.column(content).to_pylist()]
            rows = [(f.space, f.width, f.height, zlib.decompress(f.data)) if f else (None,) * 4 for f in found]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=schema.names)

    return df.select(*dict.fromkeys([*keep, content])).mapInArrow(run, schema)
