"""TrueType fonts: the tables that layout and printing need, and subsets for embedding. Fonts are dimensions: read once, on the driver or in a worker."""

from __future__ import annotations

import math
import shutil
import struct
import subprocess
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np

# Where the usual faces lie, and what to ask fontconfig for otherwise.
FACES = {
    "Regular": ("/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf", "DejaVu Sans"),
    "Bold": ("/usr/share/fonts/truetype/dejavu/DejaVuSans-Bold.ttf", "DejaVu Sans:bold"),
    "Italic": ("/usr/share/fonts/truetype/dejavu/DejaVuSans-Oblique.ttf", "DejaVu Sans:italic"),
    "BoldItalic": ("/usr/share/fonts/truetype/dejavu/DejaVuSans-BoldOblique.ttf", "DejaVu Sans:bold:italic"),
}
MOST_DEPTH = 8


class Font:
    """A font with outlines of the TrueType kind; ValueError for others."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 12 or data[:4] not in (b"\0\1\0\0", b"true"):
            raise ValueError("no TrueType outlines")
        n = struct.unpack_from(">H", data, 4)[0]
        records = (struct.unpack_from(">4sIII", data, 12 + 16 * i) for i in range(n) if 28 + 16 * i <= len(data))
        self.tables = {tag.decode("latin1"): (at, size) for tag, _, at, size in records if at < len(data)}
        if missing := {"head", "hhea", "maxp", "hmtx", "loca", "glyf", "cmap"} - self.tables.keys():
            raise ValueError(f"tables are missing: {sorted(missing)}")
        self.units = self._at("head", 18, "H") or 1000
        self.bbox = struct.unpack_from(">4h", data, self.tables["head"][0] + 36)
        self.ascent, self.descent = self._at("hhea", 4, "h"), self._at("hhea", 6, "h")
        self.n_glyphs = self._at("maxp", 4, "H")
        self.cap_height = self._at("OS/2", 88, "h") if "OS/2" in self.tables and self._at("OS/2", 0, "H") >= 2 else 0
        self.cap_height = self.cap_height if self.cap_height > 0 else 700
        self.italic_angle = self._at("post", 4, "i") / 65536 if "post" in self.tables else 0.0
        if not self.n_glyphs or not self.cmap:
            raise ValueError("no glyphs")

    def _at(self, table: str, offset: int, kind: str) -> int:
        at = self.tables[table][0] + offset
        return struct.unpack_from(f">{kind}", self.data, at)[0] if at + struct.calcsize(kind) <= len(self.data) else 0

    @cached_property
    def advances(self) -> np.ndarray:
        """Advance of each glyph in units; the last one given repeats."""
        n = min(self._at("hhea", 34, "H"), self.n_glyphs)
        given = np.frombuffer(self.data, ">u2", 2 * n, self.tables["hmtx"][0])[::2].astype(np.int64)
        return np.concatenate([given, np.full(self.n_glyphs - n, given[-1] if n else 0)])

    @cached_property
    def loca(self) -> np.ndarray:
        wide = self._at("head", 50, "h") != 0
        raw = np.frombuffer(self.data, ">u4" if wide else ">u2", self.n_glyphs + 1, self.tables["loca"][0]).astype(np.int64)
        return raw if wide else raw * 2

    @cached_property
    def cmap(self) -> dict[int, int]:
        """Code point to glyph, from the best table: full Unicode for Windows, later Unicode, basic Windows, any Unicode."""
        base = self.tables["cmap"][0]
        found = [struct.unpack_from(">HHI", self.data, base + 4 + 8 * i) for i in range(self._at("cmap", 2, "H"))]

        def grade(platform: int, encoding: int) -> int:
            return 4 if (platform, encoding) == (3, 10) else 3 if platform == 0 and encoding >= 4 else 2 if (platform, encoding) == (3, 1) else 1 if platform == 0 else 0

        for platform, encoding, offset in sorted(found, key=lambda f: -grade(f[0], f[1])):
            if grade(platform, encoding):
                at = base + offset
                kind = struct.unpack_from(">H", self.data, at)[0]
                return self._ranges(at) if kind == 12 else self._segments(at) if kind == 4 else {}
        return {}

    def _segments(self, at: int) -> dict[int, int]:
        n = struct.unpack_from(">H", self.data, at + 6)[0] // 2
        read = lambda k: struct.unpack_from(f">{n}H", self.data, at + 14 + 2 * n * k + (2 if k else 0))
        ends, starts, deltas, offsets = (read(k) for k in range(4))
        out: dict[int, int] = {}
        for i in range(n):
            for c in range(starts[i], ends[i] + 1):
                glyph = c
                if offsets[i]:
                    place = at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - starts[i])
                    glyph = struct.unpack_from(">H", self.data, place)[0] if place + 2 <= len(self.data) else 0
                    if not glyph:
                        continue
                glyph = (glyph + deltas[i]) & 0xFFFF
                if glyph and c != 0xFFFF:
                    out.setdefault(c, glyph)
        return out

    def _ranges(self, at: int) -> dict[int, int]:
        out: dict[int, int] = {}
        there = max(0, len(self.data) - at - 16) // 12  # a damaged count may name more than the file holds
        for k in range(min(struct.unpack_from(">I", self.data, at + 12)[0], there)):
            first, last, glyph = struct.unpack_from(">III", self.data, at + 16 + 12 * k)
            if last >= first and last - first < 0x110000:
                for c in range(first, last + 1):
                    out.setdefault(c, glyph + c - first)
        return out

    @cached_property
    def name(self) -> str:
        """The PostScript name."""
        if "name" in self.tables:
            at, size = self.tables["name"]
            n, strings = struct.unpack_from(">HH", self.data, at + 2)
            for i in range(n):
                platform, _, _, kind, length, offset = struct.unpack_from(">6H", self.data, at + 6 + 12 * i)
                if kind == 6:
                    raw = self.data[at + strings + offset : at + strings + offset + length]
                    return "".join(c for c in raw.decode("utf-16-be" if platform in (0, 3) else "latin1", "ignore") if c.isascii() and (c.isalnum() or c in "-+")) or "Font"
        return "Font"

    def glyph(self, char: str) -> int:
        return self.cmap.get(ord(char), 0)

    def advance(self, glyph: int) -> float:
        """In ems; half an em for glyphs that aren't there."""
        return float(self.advances[glyph]) / self.units if glyph < self.n_glyphs else 0.5

    def components(self, glyph: int, depth: int = 0) -> set[int]:
        """Glyphs that a composite one is made of, itself left out."""
        if depth >= MOST_DEPTH or glyph + 1 >= len(self.loca) or self.loca[glyph + 1] - self.loca[glyph] < 10:
            return set()
        at = self.tables["glyf"][0] + int(self.loca[glyph])
        if struct.unpack_from(">h", self.data, at)[0] >= 0:
            return set()
        at += 10
        out: set[int] = set()
        while at + 4 <= len(self.data):
            flags, part = struct.unpack_from(">HH", self.data, at)
            out |= {part} | self.components(part, depth + 1)
            at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
            if not flags & 0x20:
                break
        return out

    def subset(self, glyphs: set[int]) -> bytes:
        """A font file with the outlines of these glyphs only; glyphs keep their numbers, so widths and codes stay valid."""
        keep = {0, *glyphs, *(c for g in glyphs for c in self.components(g))}
        start = self.tables["glyf"][0]
        outlines, places = bytearray(), np.zeros(self.n_glyphs + 1, ">u4")
        for g in range(self.n_glyphs):
            places[g] = len(outlines)
            if g in keep:
                outlines += self.data[start + int(self.loca[g]) : start + int(self.loca[g + 1])]
                outlines += bytes(-len(outlines) % 4)
        places[-1] = len(outlines)
        raw = lambda t: self.data[self.tables[t][0] : sum(self.tables[t])]
        head = bytearray(raw("head"))
        head[8:12], head[50:52] = bytes(4), b"\0\1"
        parts = {t: raw(t) for t in ("hhea", "maxp", "hmtx", "cvt ", "fpgm", "prep") if t in self.tables}
        parts |= {"head": bytes(head), "loca": places.tobytes(), "glyf": bytes(outlines)}
        n = len(parts)
        power = int(math.log2(n))
        out = struct.pack(">IHHHH", 0x00010000, n, 16 << power, power, 16 * n - (16 << power))
        at, body = 12 + 16 * n, b""
        for tag, data in sorted(parts.items()):
            padded = data + bytes(-len(data) % 4)
            out += struct.pack(">4sIII", tag.encode(), int(np.frombuffer(padded, ">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF, at + len(body), len(data))
            body += padded
        return out + body


@lru_cache(maxsize=16)
def load(path: str) -> Font:
    return Font(Path(path).read_bytes())


def find(face: str) -> str | None:
    """A file for a face: the usual place, else what fontconfig names, if it is a .ttf."""
    usual, wanted = FACES[face]
    if Path(usual).is_file():
        return usual
    if shutil.which("fc-match"):
        said = subprocess.run(["fc-match", "-f", "%{file}", wanted], capture_output=True, text=True, timeout=20, check=False)
        if said.returncode == 0 and said.stdout.endswith(".ttf") and Path(said.stdout).is_file():
            return said.stdout
    return None


@lru_cache(maxsize=1)
def faces() -> dict[str, Font]:
    """The faces there are; ValueError without a regular one."""
    out = {}
    for face in FACES:
        path = find(face)
        if path:
            try:
                out[face] = load(path)
            except ValueError:
                continue
    if "Regular" not in out:
        raise ValueError("no regular font")
    return out


def canonical(face: str) -> str:
    """The face that stands in: itself, bold without italic, regular."""
    have = faces()
    return next(f for f in (face, {"BoldItalic": "Bold"}.get(face, "Regular"), "Regular") if f in have)


def tables(spark, font: Font):
    """A font's dimension tables: (char, glyph) and (glyph, advance)."""
    cmap = spark.createDataFrame([(chr(c), g) for c, g in font.cmap.items() if not 0xD800 <= c < 0xE000], "char string, glyph int")
    widths = spark.createDataFrame([(g, font.advance(g)) for g in range(font.n_glyphs)], "glyph int, advance double")
    return cmap, widths
