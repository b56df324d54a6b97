"""Token IDs in sorted-string-table shards.

A shard holds documents in ascending key order: blocks of entries whose keys are prefix-compressed with restart points, a
checksum after each block, then a Bloom filter, a sparse index (first key, offset and size of each block) and a footer of
fixed size. A lookup asks the filter, bisects the index, reads one block and bisects its restart points.

    block   entries, restart offsets (u32 each), number of restarts (u32); compressed as a whole; crc32 (u32)
    entry   varints: bytes shared with the last key, further key bytes, value bytes; then these bytes
    footer  filter offset, filter size, index offset, index size, entries, ids (u64 each), width of an id (u32), magic (8 bytes)
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, session, shared_dir
from .runs import RunCache

MAGIC = b"FOLIASST"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 64 << 20
RESTART = 16
BITS_A_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Keys whose byte order is the order of ids, null first."""
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_places(key: bytes, size: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return [(a + i * b) % size for i in range(PROBES)]


class ShardWriter:
    """Writes one shard to a binary stream; keys must ascend (equal keys may follow each other)."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.ids = 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.count, self.first, self.last, self.restarts = 0, 0, b"", b"", []

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.size)
        else:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        head = varint(shared) + varint(len(key) - shared) + varint(len(ids)) + key[shared:]
        self.parts += head, ids
        self.size += len(head) + len(ids)
        self.first = self.first if self.count else key
        self.last, self.count = key, self.count + 1
        self.keys.append(key)
        self.ids += len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            raw = b"".join(self.parts) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            packed = self.packer.compress(raw)
            self.index.append((self.first, self.at, len(packed)))
            self._write(packed + zlib.crc32(packed).to_bytes(4, "little"))
        self._start()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def finish(self) -> None:
        self._flush()
        size = max(64, len(self.keys) * BITS_A_KEY)
        bits = np.zeros(size, np.uint8)
        for key in self.keys:
            bits[_bloom_places(key, size)] = 1
        bloom = struct.pack("<Q", size) + np.packbits(bits).tobytes()
        bloom_at = self.at
        self._write(bloom)
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        index_at = self.at
        self._write(index)
        self._write(FOOTER.pack(bloom_at, len(bloom), index_at, len(index), len(self.keys), self.ids, self.width, MAGIC))


class Shard:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        size = file.size() if hasattr(file, "size") and callable(file.size) else file.seek(0, 2)
        bloom_at, bloom_n, index_at, index_n, self.entries, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        bloom = self._read(bloom_at, bloom_n)
        self.bloom_size, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        index, at = self._read(index_at, index_n), 0
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < index_n:
            n, at = read_varint(index, at)
            self.first.append(index[at : at + n])
            offset, at = read_varint(index, at + n)
            size, at = read_varint(index, at)
            self.blocks.append((offset, size))
        self.dtype = np.dtype(f"<u{self.width}")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        offset, size = self.blocks[i]
        packed = self._read(offset, size + 4)
        if zlib.crc32(packed[:-4]) != int.from_bytes(packed[-4:], "little"):
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(packed[:-4])
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        body = len(raw) - 4 - 4 * n
        return raw[:body], list(struct.unpack_from(f"<{n}I", raw, body))

    def _entries(self, body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = read_varint(body, at)
            more, at = read_varint(body, at)
            size, at = read_varint(body, at)
            key = key[:shared] + body[at : at + more]
            at += more
            yield key, body[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in key order: id and token ids."""
        for i in range(len(self.blocks)):
            for key, ids in self._entries(self._block(i)[0], 0):
                yield id_of(key), np.frombuffer(ids, self.dtype)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The token ids of one document, by binary search; the first of equal keys; None if it isn't there."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bloom_size)):
            return None
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        for i in range(i, min(i + 2, len(self.blocks))):
            body, restarts = self._block(i)
            at = bisect.bisect_left(restarts, key, key=lambda r: next(self._entries(body, r))[0]) - 1
            for k, ids in self._entries(body, restarts[max(0, at)]):
                if k == key:
                    return np.frombuffer(ids, self.dtype)
                if k > key:
                    return None
        return None


# The vocabulary's way to part a text, as its file states it. Runs between white space can be encoded one by one only where a
# file has just these steps; any other file encodes whole texts.
NORMALIZERS = {"NFC", "Replace", "Lowercase"}
SPACES = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Runs of these characters alone are in normal form C however they stand together, and lower case is the same everywhere.
PLAIN = "^[\\x00-\\x7fÀ-ÖØ-öø-ÿ¡¿«»–—‘’“”…]*$"
PART = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\t\\n\\x0b\\f\\ra-z0-9ß-öø-ÿ]+"
TOGETHER = 256  # parts encoded by one call


def parts_at_space(model: dict) -> bool:
    """Whether a tokenizer's file drops white space, never looks across it, and parts a run by PARTS in lower case."""
    normal = model.get("normalizer") or {}
    steps = normal.get("normalizers", []) if normal.get("type") == "Sequence" else []
    before = model.get("pre_tokenizer") or {}
    splits = before.get("pretokenizers", []) if before.get("type") == "Sequence" else []
    return (
        {s.get("type") for s in steps} == NORMALIZERS and all(s == SPACES for s in steps if s["type"] == "Replace") and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
        and (splits[0].get("pattern"), splits[0].get("behavior"), splits[0].get("invert")) == ({"Regex": PARTS}, "Removed", True)
        and (splits[1].get("add_prefix_space"), splits[1].get("use_regex")) == (False, False) and not model.get("post_processor") and model["model"].get("type") == "BPE"
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].split() == [t["content"]] for t in model.get("added_tokens", []))
    )


class TextEncoder:
    """The tokenizers library over whole texts.

    Where the file parts at white space, each distinct run is encoded once a batch. Runs of plain characters are lowered and parted by
    Arrow as the file says, so Python sees distinct parts only, and the library gets those that aren't kept, many in one call; other
    runs go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        self.parts, self.runs = (RunCache(self.dtype, self._parts), RunCache(self.dtype, self._whole)) if parts_at_space(model) else (None, None)

    @property
    def width(self) -> int:
        return self.dtype.itemsize

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for p in parts if not p]  # the shortest come first
        for i in range(len(out), len(parts), TOGETHER):
            group = parts[i : i + TOGETHER]
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ids, at = e.ids, np.searchsorted(np.asarray(e.word_ids), np.arange(len(group) + 1)).tolist()
            out += [ids[a:b] for a, b in pairwise(at)]
        return out

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct runs, and where each run's begin and how many they are."""
        plain = pc.match_substring_regex(runs, PLAIN)
        for a in self.added:
            plain = pc.and_not(plain, pc.match_substring(runs, a))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(runs.filter(plain)), PART, r"\0 "))
        parts = cut.flatten().dictionary_encode()
        ids, ends = self.parts.encode(parts.dictionary, np.asarray(parts.indices))
        at = np.asarray(cut.offsets).astype(np.int64)
        ends = ends[at - at[0]]
        rest = runs.filter(pc.invert(plain))
        more, stops = self.runs.encode(rest, np.arange(len(rest)))
        plain = plain.to_numpy(zero_copy_only=False)
        begin, size = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        begin[plain], size[plain] = ends[:-1], np.diff(ends)
        begin[~plain], size[~plain] = len(ids) + stops[:-1], np.diff(stops)
        return np.concatenate([ids, more]), begin, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the n + 1 offsets; null counts as empty."""
        if self.parts is not None and len(texts):
            words = pc.ascii_split_whitespace(texts.fill_null("") if texts.null_count else texts)
            at = np.asarray(words.offsets).astype(np.int64)
            runs = words.flatten().dictionary_encode()
            ids, begin, size = self._runs(runs.dictionary)
            index = np.asarray(runs.indices)
            n = size[index]
            ends = np.concatenate([[0], np.cumsum(n)])
            return ids[np.repeat(begin[index] - ends[:-1], n) + np.arange(ends[-1])], ends[at - at[0]]
        encoded = self._whole([t or "" for t in texts.to_pylist()])
        ends = np.concatenate([[0], np.cumsum([len(e) for e in encoded], dtype=np.int64)]).astype(np.int64)
        return np.concatenate([np.zeros(0, self.dtype), *[np.asarray(e, self.dtype) for e in encoded]]), ends


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """A worker's one encoder of a vocabulary; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", id_col: str = "doc_id", end_id: int = 1) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes shards in ascending id order under folder (one that driver and executors share).

    Returns the manifest: part and number of each shard in order, path, first and last id, documents, tokens, bytes. One range
    shuffle; a part goes on to a new shard at SHARD_BYTES. A task that runs again writes the same shards: each is written under
    a name of its own and renamed when whole. Null and empty texts are the end id alone; a null id comes first; rows that share an id all stay,
    in the order of their texts.
    """
    session(docs)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions(F.asc_nulls_first("id"), "text")

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        coder = encoder(tokenizer)
        part, number, writer, first, last = TaskContext.get().partitionId(), 0, None, None, None
        tail = np.array([end_id], coder.dtype).tobytes()

        def close():
            writer.finish()
            size = writer.at
            stream.close()
            name = f"{base}/part-{part:06d}-{number:04d}.sst"
            fs.move(partial, name)
            row = {"part": [part], "number": [number], "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "first_id": [first], "last_id": [last], "docs": [len(writer.keys)], "tokens": [writer.ids], "bytes": [size]}
            return pa.RecordBatch.from_pydict(row, schema=manifest)

        manifest = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
        for b in batches:
            doc_ids = b.column("id").to_pylist()
            ids, at = coder.encode(b.column("text"))
            for k, doc_id in enumerate(doc_ids):
                if writer is None:
                    partial, first = f"{base}/.part-{part:06d}-{number:04d}.{uuid.uuid4().hex}", doc_id
                    stream = fs.open_output_stream(partial)
                    writer = ShardWriter(stream, coder.width)
                writer.add(key_of(doc_id), ids[at[k] : at[k + 1]].tobytes() + tail)
                last = doc_id
                if writer.at >= SHARD_BYTES:
                    yield close()
                    writer, number = None, number + 1
        if writer is not None:
            yield close()

    written = ordered.mapInArrow(run, "part int, number int, path string, first_id long, last_id long, docs long, tokens long, bytes long")
    return materialize(written, "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents from the shards' files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the little-endian 32-bit ids.

    The driver sees one row of sums for each range partition that was written; each shard is read by a task of its own.
    """
    spark = session(manifest)
    before, start, shards = [], 0, 0
    for r in manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("shards")).orderBy("part").collect():
        before.append((r["part"], start))
        start, shards = start + r["tokens"], shards + r["shards"]
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    parts = spark.createDataFrame(before, "part int, before long")
    frame = manifest.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(parts), "part")
    frame = frame.select("path", (F.col("before") + F.col("own")).alias("start")).repartition(max(1, shards))

    def run(batches):
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as file:
                    out: list[tuple] = []
                    for doc_id, ids in Shard(file).scan():
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> np.ndarray | None:
    """One document's token ids: the manifest's key ranges choose the shards, a binary search in them finds it."""
    inside = F.expr("first_id IS NULL") if doc_id is None else F.expr(f"last_id >= {doc_id} AND (first_id IS NULL OR first_id <= {doc_id})")
    for row in manifest.where(inside).orderBy("part", "number").select("path").collect():
        fs, name = _open(row["path"])
        with fs.open_input_file(name) as file:
            found = Shard(file).get(doc_id)
        if found is not None:
            return found
    return None


def op4_sstable(spark, sf_dir: str) -> DataFrame:
    """Every text's token ids written to shards and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, str(public_tokenizers.path("word_bpe_49k.json")), shared_dir(spark, "sst")))
