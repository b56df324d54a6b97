"""Media columns: Ogg files as binary columns.

Writing lays a payload down as a logical stream of 8-bit samples with a stream of metadata between its pages; reading verifies
every page's checksum, splits the pages by serial number, puts packets together again from the lacing values (also over page
ends) and derives each packet's time from the granule positions of the pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BATCH_BYTES, session, utf8

FRAME = 576  # samples in a packet
RATE = 8000  # samples a second
DATA, META = 0x5350434D, 0x4D455441  # serial numbers of the two streams
PAGE = struct.Struct("<4sBBqIIIB")
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
MARK_EVERY = 16  # pages of samples after which the metadata say where they stand
MORE, FIRST, LAST = 1, 2, 4  # header type: begins inside a packet, begins a stream, ends it


def page_crc(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, most significant bit first, start 0: zlib's runs the other way round, so mirror it."""
    crc = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(MIRROR), "big")


def page(serial: int, number: int, kind: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def lace(size: int) -> bytes:
    """Lacing values of a packet; a last value under 255 ends it."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def pages_of(serial: int, packets: list[bytes], granules: list[int], first: int = 0) -> Iterator[bytes]:
    """Pages of one logical stream; a packet goes on over as many pages as it needs, and a page without a packet's end has granule -1."""
    values = b"".join(lace(len(p)) for p in packets)
    ends = np.cumsum([len(p) // 255 + 1 for p in packets])
    body = b"".join(packets)
    at = 0
    for number, k in enumerate(range(0, len(values), 255)):
        lacing = values[k : k + 255]
        size = sum(lacing)
        done = int(np.searchsorted(ends, k + len(lacing), side="right"))
        before = int(np.searchsorted(ends, k, side="right"))
        kind = (MORE if k and values[k - 1] == 255 else 0) | (FIRST if not first and not k else 0) | (LAST if k + 255 >= len(values) else 0)
        yield page(serial, first + number, kind, granules[done - 1] if done > before else -1, lacing, body[at : at + size])
        at += size


def encode(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """An Ogg file with the payload as frames of 8-bit samples and its unpadded size as metadata."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    header = struct.pack("<8sBIBH", b"FoliaPCM", 1, rate, 8, FRAME)
    about = b"n_bytes=%d" % n_bytes
    # the header pages of all streams come first; after them the streams' pages alternate
    out = [page(DATA, 0, FIRST, 0, lace(len(header)), header), page(META, 0, FIRST, 0, lace(8), b"FoliaTag"), page(META, 1, 0, 0, lace(len(about)), about)]
    number = 2
    for k, samples in enumerate(pages_of(DATA, frames, [min(len(payload), FRAME * (i + 1)) for i in range(len(frames))], 1), 1):
        out.append(samples)
        if k % MARK_EVERY == 0:
            note = b"pages=%d" % k
            out.append(page(META, number, 0, number, lace(len(note)), note))
            number += 1
    out.append(page(META, number, LAST, number, lace(3), b"end"))
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream: its whole packets, the granule position of each page that ends one and how many had ended with it, and the bytes of a packet that goes on."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    done: list[int] = field(default_factory=list)
    pages: int = 0
    open: list[bytes] = field(default_factory=list)
    ended: bool = False


def demultiplex(media: bytes) -> tuple[dict[int, Stream], list[str]]:
    """The logical streams by serial number, and what is wrong with the file ('' none): bad checksums, lost pages, cut ends."""
    streams: dict[int, Stream] = {}
    wrong: list[str] = []
    at, size = 0, len(media)
    while at < size:
        if size - at < 27 or media[at : at + 4] != b"OggS":
            wrong.append("capture")
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, kind, granule, serial, number, crc, n = PAGE.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > size:
            wrong.append("cut")
            at = at + 4
            continue
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            wrong.append("checksum")
            at = at + 4
            continue
        s = streams.setdefault(serial, Stream())
        if number != s.pages:
            wrong.append("gap")
            s.open, s.pages = [], number
        if s.open and not kind & MORE:
            wrong.append("packet")
            s.open = []
        skip = bool(kind & MORE) and not s.open
        p, run = at + 27 + n, 0
        for v in lacing:
            run += v
            if v < 255:
                if skip:
                    skip = False  # its beginning is lost
                elif s.open:
                    s.packets.append(b"".join([*s.open, media[p : p + run]]))
                    s.open = []
                else:
                    s.packets.append(media[p : p + run])
                p, run = p + run, 0
        if n and lacing[-1] == 255 and not skip:
            s.open.append(media[p : p + run])
        if granule >= 0:
            s.granules.append(granule)
            s.done.append(len(s.packets))
        s.pages, s.ended = number + 1, s.ended or bool(kind & LAST)
        at = end
    if any(not s.ended or s.open for s in streams.values()):
        wrong.append("unended")
    return streams, list(dict.fromkeys(wrong))


def starts(s: Stream, headers: int = 1) -> np.ndarray:
    """Where each packet after the headers begins, in samples: a page's granule position is the end of the last packet that ends in it, and those before end where the next begins."""
    sizes = np.array([0 if k < headers else len(p) for k, p in enumerate(s.packets)], np.int64)
    ends = np.cumsum(sizes)
    done, granules = np.array(s.done, np.int64), np.array(s.granules, np.int64)
    page = np.searchsorted(done, np.arange(len(sizes)), side="right")
    known = page < len(done)
    shift = np.where(known, granules[np.minimum(page, len(done) - 1)] - ends[np.maximum(done[np.minimum(page, len(done) - 1)] - 1, 0)], 0) if len(done) else np.zeros(len(sizes), np.int64)
    return (ends - sizes + shift)[headers:]


def decode(media: bytes | None) -> tuple[bytes, int, int, int, float, str]:
    """Payload, unpadded size, pages and packets of the data stream, seconds by the last granule position, faults ('' if none)."""
    return decoded(media)[:6]


def decoded(media: bytes | None) -> tuple[bytes, int, int, int, float, str, np.ndarray]:
    """As decode(), and when each packet begins, in seconds."""
    streams, wrong = demultiplex(media or b"")
    data, meta = streams.get(DATA, Stream()), streams.get(META, Stream())
    head = data.packets[0] if data.packets else b""
    rate = struct.unpack("<8sBIBH", head)[2] if len(head) == 16 and head[:8] == b"FoliaPCM" else 0
    if not rate:
        wrong.append("header")
    size = next((int(p[8:]) for p in meta.packets if p[:8] == b"n_bytes=" and p[8:].isdigit()), -1)
    payload = b"".join(data.packets[1:])
    if data.granules and data.granules[-1] != len(payload):
        wrong.append("granule")
    at = starts(data) if rate else np.zeros(0, np.int64)
    if len(at) and (at[0] or (np.diff(at) != [len(p) for p in data.packets[1:-1]]).any()):
        wrong.append("time")
    return payload, size, data.pages, max(0, len(data.packets) - 1), data.granules[-1] / rate if rate and data.granules else 0.0, ",".join(wrong), at / max(rate, 1)


def _by_bytes(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_BYTES each: one very long text doesn't widen its neighbours' batch."""
    ends = utf8(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_media(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """Adds an Ogg file as binary column: the text's UTF-8 bytes (null: none) and bytes 255 up to a positive multiple of 576.

    Row by row, without a shuffle; equal texts give equal bytes. Replaces a column of that name if there is one.
    """
    session(df)
    rest = [c for c in df.columns if c not in (to,)]
    kept = df.select(*rest)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches):
        for whole in batches:
            for b in _by_bytes(whole, text):
                data, ends = utf8(b.column(text))
                raw = data.tobytes()
                media = []
                for k in range(b.num_rows):
                    x = raw[ends[k] : ends[k + 1]]
                    media.append(encode(x + b"\xff" * ((-len(x)) % FRAME or (0 if x else FRAME)), len(x)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], names=[*b.schema.names, to])

    return kept.mapInArrow(run, schema)


def media_features(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Reads each Ogg file back and describes it.

    n_bytes is -1 where the file doesn't say; feature holds duration and the last packet's time in ms, pages, packets, mean, RMS and zero crossings of the
    samples around 128, and faults. Null or damaged files give what could be read and name the faults; nothing is dropped.
    """
    session(df)
    long, string = T.LongType(), T.StringType()
    made = (("n_bytes", long), ("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string))
    schema = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(*x) for x in made]])

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(media):
                raw = x.as_py() or b""
                payload, size, pages, packets, seconds, wrong, times = decoded(raw)
                if payload:
                    v = np.frombuffer(payload, np.uint8)
                    mean = float(v.mean(dtype=np.float64))
                    rms = float(np.sqrt(np.dot(w := v.astype(np.float32) - np.float32(128), w) / len(v)))
                    up = v >= 128
                    cross = int(np.count_nonzero(up[1:] != up[:-1]))
                else:
                    mean = rms = 0.0
                    cross = 0
                feature = f"ms={seconds * 1000:.0f};last={times[-1] * 1000 if len(times) else 0:.0f};pages={pages};packets={packets};mean={mean:.3f};rms={rms:.2f};zc={cross};faults={wrong}"
                rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=schema.names)

    return df.select(*keep, media).mapInArrow(run, schema)


def op2_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg file in a media column, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(text_media(docs.select("doc_id", "text")).select("doc_id", "media"))
