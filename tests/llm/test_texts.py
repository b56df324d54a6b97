"""Brute force and hard cases for the operators on texts: licences, Ogg, MinHash, shards, PPM, lines, packing, SentencePiece."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folia.llm import licenses, minhash, ogg, packing, ppm, sstable, suffix, transducer
from folia.llm.common import shared_dir
from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, ids string, media string, row int, rank int, part int"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with names that the operators use inside."""
    texts = [None, "", "   ", "a", "A b", "the MIT License and the mit-license\n" * 3, "x" * 70_000, "é ü ▁▁ K İ 日本語 \U0001f600  two  spaces ", "\n\n", "a b c d e f\n" * 40, "w " * 5000]
    rows = [(i, t, "en", "x", "y", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(3, "a", None, None, None, None, None, None)] * 2 + [(None, "GNU General Public License, version 3", None, "", "", 0, 0, 0), (None, None, "", "", "", 0, 0, 0), (50, texts[5], "fr", "", "", 0, 0, 0), (-7, texts[9], "fr", "", "", 0, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def key(rows):
    return sorted(map(str, rows))


# licences
def test_licenses_hard(spark):
    out = licenses.scan_licenses(hard(spark)).collect()
    assert len(out) == hard(spark).count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[0].n_words == by[1].n_words == by[2].n_words == 0 and by[0].places == []
    assert by[6].n_words == 1
    assert [p.start for p in by[5].places if p.base and p.label == "mit"] == [1, 5, 8, 12, 15, 19]
    gpl = [r for r in out if r.doc_id is None and r.n_words][0]
    assert {p.label for p in gpl.places} >= {"gpl", "gpl-3.0"}
    assert licenses.scan_licenses(empty(spark)).count() == 0


# Ogg
@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 49_000, 200_000])
def test_ogg_round_trip(size):
    payload = random.Random(size).randbytes(size)
    padded = payload + b"\xff" * ((-size) % 576 or (0 if size else 576))
    got, n, pages, packets, seconds, wrong = ogg.decode(ogg.encode(padded, size))
    assert (got, n, packets, seconds, wrong) == (padded, size, len(padded) // 576, len(padded) / 8000, "")
    assert pages == 1 + -(-packets * 3 // 255)


def test_ogg_packets_go_on_over_pages():
    packets = [bytes([k]) * n for k, n in enumerate([0, 254, 255, 256, 70_000, 510, 3])]
    media = b"".join(ogg.pages_of(9, packets, list(range(1, 8))))
    streams, wrong = ogg.demultiplex(media)
    assert streams[9].packets == packets and wrong == []


def test_ogg_times_and_streams():
    """Each packet's time, and streams whose pages alternate."""
    media = ogg.encode(b"q" * 576 * 1500, 5)
    serials, at = [], 0
    while at < len(media):
        n = media[at + 26]
        serials.append(int.from_bytes(media[at + 14 : at + 18], "little"))
        at += 27 + n + sum(media[at + 27 : at + 27 + n])
    assert sum(a != b for a, b in zip(serials, serials[1:], strict=False)) > 3 and serials[-1] == ogg.META
    streams, wrong = ogg.demultiplex(media)
    assert wrong == [] and streams[ogg.META].packets[1:] == [b"n_bytes=5", b"pages=16", b"end"]
    assert ogg.decoded(media)[6].tolist() == [576 * k / ogg.RATE for k in range(1500)]


def test_ogg_damage_is_named():
    media = bytearray(ogg.encode(b"z" * 576 * 200, 5))
    media[-100] ^= 1
    assert "checksum" in ogg.decode(bytes(media))[-1]
    assert ogg.decode(b"")[-1] and ogg.decode(None)[-1] and ogg.decode(b"nothing")[-1]


def test_ogg_known_crc():
    crc = 0
    for byte in b"OggS page":  # bit by bit, as the format's description has it
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg.page_crc(b"OggS page") == crc


def test_ogg_hard(spark):
    media = ogg.text_media(hard(spark))
    rows = ogg.media_features(media, keep=("doc_id", "text")).collect()
    assert len(rows) == hard(spark).count()
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert r.n_bytes == len(raw) and r.payload_bytes == len(padded) and r.tail_crc32 == zlib.crc32(padded[-32:]) and r.feature.endswith("faults=")
    assert ogg.media_features(ogg.text_media(empty(spark))).count() == 0


# MinHash
def brute_components(texts, k, percent=80):
    sets = {}
    for d, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(LOW))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_brute(spark, k):
    texts = documents(spark)
    got = minhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_chains_and_families(spark):
    """A chain in which only neighbours are linked, and a family of near copies that are not all linked to one of them."""
    rng, words = random.Random(1), [f"w{i}" for i in range(4000)]
    base = rng.sample(words, 120)
    texts = {}
    for i in range(40):
        texts[i] = " ".join(base)
        for j in rng.sample(range(120), 4):
            base[j] = rng.choice(words)
    family = rng.sample(words, 100)
    for i in range(100, 160):
        copy = list(family)
        for j in rng.sample(range(100), 5):
            copy[j] = rng.choice(words)
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert got == brute_components(texts, 2)


def test_minhash_collisions_hide_no_link(spark):
    """Pairs at the threshold and below whose items share their upper halves by fours: all bits count."""
    item = lambda group, low: (group << 32) + low
    common = [item(g, k) for g in range(20) for k in range(4)]  # 80 items, 20 hashes
    own = {i: [item(100 * i + k, 0) for k in range(20)] for i in (1, 2, 3)}
    sets = {1: common, 2: common + own[2], 3: common[:72] + own[3]}  # similarities: 80 / 100 and below
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = frame([(7, i, 0, i) for i in sets], "key long, id long, band int, component long")
    nodes = frame([(i, [0] * 8, [7]) for i in sets], "id long, planes array<long>, bands array<long>")
    items = frame([(i, x, [-1] * 32) for i, x in sets.items()], "id long, items array<long>, map array<long>")
    search = minhash._Search(None, "text", "doc_id", 2, 80)
    assert [tuple(r) for r in search.rest(rows, nodes, items).collect()] == [(1, 2)]


def test_minhash_large_family(spark):
    """Two thousand copies around one text, of which hardly half are linked directly; few pairs may leave the last join."""
    rng, words = random.Random(5), [f"w{i}" for i in range(4000)]
    base, texts = rng.sample(words, 120), {}
    for i in range(2000):
        copy = list(base)
        for j in rng.sample(range(120), rng.choice([2, 4, 6, 8, 10])):
            copy[j] = rng.choice(words)
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=2).collect()}
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts.values()]
    often = {x: i for i, x in enumerate(x for x, n in Counter(x for s in sets for x in s).items() if n > 1)}
    held = np.zeros((len(sets), len(often)), np.float32)
    for i, s in enumerate(sets):
        held[i, [often[x] for x in s if x in often]] = 1
    both, sizes = held @ held.T, np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (sizes[:, None] + sizes - both)
    np.fill_diagonal(linked, True)
    component = np.arange(len(sets))
    while (least := np.where(linked, component, len(sets)).min(1)).tolist() != component.tolist():
        component = least
    assert got == {i: (int(sizes[i]), int(component[i])) for i in range(len(sets))}


def test_minhash_very_long_sets(spark):
    """Sets of over 300,000 shingles: one pair exactly at the threshold, one a shingle below."""
    whole = [f"a{i} b" for i in range(200_000)]  # 400,000 words, 399,999 shingles
    n = 2 * len(whole) - 1
    cut = next(k for k in range(n, 0, -1) if 100 * k >= 80 * n and 100 * (k - 1) < 80 * n)
    words = " ".join(whole).split()
    texts = {1: " ".join(words), 2: " ".join(words[: cut + 1]), 3: " ".join(words[: cut]).replace("a", "c"), 4: " ".join(words).replace("a", "c")}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert got == {1: (n, 1), 2: (cut, 1), 3: (cut - 1, 3), 4: (n, 4)}


def test_minhash_repeated_ids(spark):
    """Rows that share an id are one document, read from the same row in whatever order they come."""
    rows = [(5, "one two three four five six"), (5, "a b c"), (6, "a b c"), (7, "one two three four five six"), (5, None)]
    want = None
    for turn in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(turn, "doc_id long, text string"), shingle=2).collect())
        want = want or got
        assert got == want == [(5, 0, 5), (5, 2, 5), (5, 5, 5), (6, 2, 5), (7, 5, 7)]


def test_minhash_hard(spark):
    rows = minhash.near_duplicates(hard(spark), shingle=2).collect()
    assert len(rows) == hard(spark).count()
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[2].component_id == 2
    assert by[50].component_id == 5 and by[9].component_id == -7
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_estimate(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = x[:900], x[100:]
    p = minhash.planes(np.stack([minhash.minima(a), minhash.minima(b)]))
    differ = sum(bin(int((p[0, i] ^ p[1, i]) | (p[0, 4 + i] ^ p[1, 4 + i])) & (1 << 64) - 1).count("1") for i in range(4))
    assert abs((1 - differ / 256 - 0.25) / 0.75 - 0.8) < 0.12


# shards
def test_shards_round_trip(spark):
    docs = hard(spark)
    path = str(P.path("word_bpe_49k.json"))
    manifest = sstable.write_shards(docs, path, shared_dir(spark, "t"))
    rows = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    start = 0
    for r, (there, doc_id, text) in zip(rows, order, strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id if there else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sstable.lookup(manifest, 7).tolist() == t.encode(order[[o[1] for o in order].index(7)][2], add_special_tokens=False).ids + [1]
    assert sstable.lookup(manifest, 999) is None and sstable.lookup(manifest, None) is not None
    assert sstable.read_shards(sstable.write_shards(empty(spark), path, shared_dir(spark, "t"))).count() == 0


def test_shard_lookup_over_blocks(tmp_path):
    keys = sorted(random.Random(2).sample(range(-(10**9), 10**9), 3000))
    with open(tmp_path / "s", "wb") as f:
        w = sstable.ShardWriter(f, 2)
        for k in keys:
            w.add(sstable.key_of(k), np.full(abs(k) % 300, abs(k) % 65536, "<u2").tobytes())
        w.finish()
        with pytest.raises(ValueError):
            w.add(sstable.key_of(keys[0]), b"")
    with open(tmp_path / "s", "rb") as f:
        s = sstable.Shard(f)
        assert len(s.blocks) > 3 and [k for k, _ in s.scan()] == keys
        for k in keys[::17]:
            assert s.get(k).tolist() == [abs(k) % 65536] * (abs(k) % 300)
        assert all(s.get(k + 1) is None for k in keys[::17] if k + 1 not in set(keys))
    data = bytearray((tmp_path / "s").read_bytes())
    data[10] ^= 255
    (tmp_path / "s").write_bytes(data)
    with open(tmp_path / "s", "rb") as f, pytest.raises(ValueError):
        list(sstable.Shard(f).scan())


# PPM
def brute_ppm(texts, train, order):
    contexts = [{} for _ in range(order + 1)]

    def steps(t):
        b = [0xFE] * order + list(t.encode()) + [0xFF]
        for i in range(order, len(b)):
            yield tuple(b[i - order : i]), b[i]

    for d in train:
        for x, y in steps(texts[d]):
            for k in range(order + 1):
                c = contexts[k].setdefault(x[order - k :], Counter())
                c[y] += 1

    def lp(x, y):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            seen = contexts[k].get(x[order - k :])
            if seen:
                left = {s: n for s, n in seen.items() if s not in gone}
                n, d = sum(left.values()), len(left)
                if y in left:
                    return out + math.log10(left[y] / (n + d))
                out += math.log10(d / (n + d)) if d else 0.0
                gone |= set(seen)
        return out - math.log10(256 - len(gone))

    return {d: sum(lp(x, y) for x, y in steps(t)) for d, t in texts.items()}


@pytest.mark.parametrize("order", [2, 4])
def test_ppm_brute(spark, order):
    texts = {d: t[:400] for d, t in documents(spark).items() if d % 3 == 0} | {10_000: "", 10_001: "zzz ÿ 日本"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.ppm_scores(df, F.col("doc_id") % 2 == 1, order=order, bucket_bytes=9000).collect()}
    want = brute_ppm(texts, [d for d in texts if d % 2 == 0], order)
    assert got.keys() == want.keys()
    for d, r in got.items():
        assert r.score == pytest.approx(want[d], rel=1e-9)


def test_ppm_hard(spark):
    rows = ppm.ppm_scores(hard(spark), F.col("doc_id") % 2 == 1).collect()
    assert len(rows) == hard(spark).count() and all(r.held_out for r in rows if r.doc_id is None) and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert ppm.ppm_scores(empty(spark), F.lit(False)).count() == 0
    alone = ppm.ppm_scores(hard(spark).where("doc_id = 4"), F.lit(True)).first()
    assert alone.score == pytest.approx(-4 * math.log10(256)) and alone.n_known == 0 and alone.train_tokens == 0


# lines
def brute_lines(texts, min_words):
    """Deleted lines by comparing every pair of positions."""
    places = [(d, i, s) for d in sorted(texts) for i, s in enumerate(texts[d].split("\n"))]
    split = {d: t.split("\n") for d, t in texts.items()}
    where = {}
    for d, i, s in places:
        where.setdefault(s, []).append((d, i))
    dead = {d: set() for d in texts}
    for s, at in where.items():
        for x in range(len(at)):
            for y in range(x + 1, len(at)):
                (a, i), (b, j) = at[x], at[y]
                if i and j and split[a][i - 1] == split[b][j - 1]:
                    continue
                n = 0
                while i + n < len(split[a]) and j + n < len(split[b]) and split[a][i + n] == split[b][j + n]:
                    n += 1
                if sum(len(re.findall("[^\x20\x09-\x0d]+", t)) for t in split[b][j : j + n]) >= min_words:
                    dead[b].update(range(j, j + n))
    return dead


@pytest.mark.parametrize("min_words", [1, 7, 50])
def test_lines_brute(spark, min_words):
    rng = random.Random(5)
    lines = [" ".join(["w"] * rng.randrange(0, 6)) + str(i) for i in range(6)] + [""]
    texts = {d: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for d in range(40)}
    texts[41] = "\n".join(["again and"] * 60)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_lines(texts, min_words)
    for r in suffix.dedup_lines(df, min_words=min_words).collect():
        assert set(r.dead_lines) == want[r.doc_id], r
        assert r.text == "\n".join(s for i, s in enumerate(texts[r.doc_id].split("\n")) if i not in want[r.doc_id])


def test_lines_documents(spark):
    texts = documents(spark)
    got = {r.doc_id: set(r.dead_lines) for r in suffix.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == brute_lines(texts, suffix.MIN_WORDS) and any(got.values())


def test_lines_hard(spark):
    rows = suffix.dedup_lines(hard(spark), min_words=3).collect()
    assert len(rows) == hard(spark).count() and rows[0].asDict().keys() == {*hard(spark).columns, "dead_lines"}
    by = {r.doc_id: r for r in rows}
    assert by[0].text is None and by[1].text == "" and by[50].dead_lines == [0, 1, 2, 3] and by[-7].dead_lines == list(range(1, 40))
    assert suffix.dedup_lines(empty(spark)).count() == 0


# packing
def test_bounds_are_optimal():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.sort(rng.choice(60, rng.integers(1, 9), replace=False) + 1)
        counts = rng.integers(1, 30, len(lengths))
        k = int(rng.integers(1, 6))
        ends, waste = packing.bounds(lengths, counts, k)

        def padding(ends):
            return sum(int(c) * (min(e for e in ends if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))

        best = min(padding([*map(int, p), int(lengths[-1])]) for r in range(k) for p in itertools.combinations(lengths[:-1], r))
        assert padding(ends) == waste == best and len(ends) <= k


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, buckets=5, budget=3000).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.bucket, []).append(r)
        assert r.n_tokens <= r.padded
    for own in by.values():
        room = max(1, 3000 // own[0].padded)
        assert [(r.batch, r.slot) for r in sorted(own, key=lambda r: r.doc_id)] == [(i // room, i % room) for i in range(len(own))]
        assert len({r.padded for r in own}) == 1 and max(r.n_tokens for r in own) > own[0].padded - packing.GRAIN
    words = {d: len(t.split()) for d, t in documents(spark).items()}
    assert all(r.n_tokens == words[r.doc_id] + 1 for r in rows)


def test_packing_hard(spark):
    rows = packing.pack(hard(spark)).collect()
    assert len(rows) == hard(spark).count() and len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    assert packing.pack(empty(spark)).count() == 0


# SentencePiece
@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer.load(str(P.path("piece_bpe_32k.model")))


def test_transducer_is_the_library(spark, machine):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    rng = random.Random(8)
    texts = [*documents(spark).values(), *[r.text or "" for r in hard(spark).collect()], " ", "  a", "a  ", "x    y", "▁ ▁▁a", "\U0001f469‍\U0001f4bb zażółć gęślą jaźń", "0" * 90, " " * 40 + "def f():\n\treturn 1"]
    texts += ["".join(rng.choice("aebhint▁ .étion日") for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [p.replace("▁", " ") * 2 for p in machine.pieces[300:8000:9]]
    texts += ["".join(rng.choice(["the", "ing", "a", "日本", "é", "_", "0", "==", "\u0003", "ion"]) for _ in range(n)) for n in (100, 300, 1000, 5000)]  # no space at all
    texts += [" " * n + "x" for n in (17, 300, 5000)] + ["ab" * 3000, "a" * 3000]
    ids, at = transducer.encoder(machine).encode(pa.array(texts, pa.string()))
    want = sp.encode(texts, num_threads=1)
    bad = [(t, ids[at[k] : at[k + 1]].tolist(), w) for k, (t, w) in enumerate(zip(texts, want, strict=True)) if ids[at[k] : at[k + 1]].tolist() != w]
    assert not bad, bad[:3]
    for k, t in enumerate(texts):
        assert machine.decode(ids[at[k] : at[k + 1]].tolist()) == t.replace("▁", " ").encode()


def test_transducer_is_linear_in_a_run(machine):
    """A megabyte without a space, and one of spaces only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    rng = random.Random(4)
    text = "".join(rng.choice(["con", "tent", "ra", "日", "x9", "é", "-", "ware"]) for _ in range(330_000))
    began = time.process_time()
    ids, _ = transducer.encoder(machine).encode(pa.array([text, " " * 300_000], pa.string()))
    spent = time.process_time() - began
    assert spent < 60, spent
    assert ids.tolist() == [*sp.encode(text), *sp.encode(" " * 300_000)]


def test_normaliser_is_the_library():
    """The character map of a normaliser that the library carries, with and without its treatment of spaces."""
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf")
    spec = next(v for n, v in transducer._fields(lib.serialized_model_proto()) if n == 3)
    rules = transducer.character_map(next(v for n, v in transducer._fields(spec) if n == 2))
    assert len(rules) > 1000
    texts = ["Ｈｅｌｌｏ　ﬁ ½ ①", "e\u0301 ÉÀ ﷺ ｶﾞ", "  two   spaces ", "a\tb\nc\x00d", "ß ẞ İ Ω", "\U0001f469\u200d", ""]
    n = transducer.Normaliser(rules, shrink=True)  # the space before a text is put there when it is cut into runs
    assert [t and " " + t for t in n.spaces(pa.array(texts)).to_pylist()] == [lib.normalize(t).replace("▁", " ") for t in texts]


def test_unigram_shortest_path():
    """Against all segmentations of short words."""
    rng = random.Random(3)
    pieces = ["<unk>", *[c for c in "▁abc"], *{"".join(rng.choice("abc") for _ in range(rng.randrange(2, 4))) for _ in range(12)}]
    scores = [0.0] + [-rng.random() * 9 - 1 for _ in pieces[1:]]
    m = transducer.Transducer._compile(pieces, scores, [2] + [1] * (len(pieces) - 1), transducer.UNIGRAM, transducer.Normaliser())
    ids = {p: i for i, p in enumerate(pieces)}

    def best(w):
        if not w:
            return 0.0, []
        return min(((lambda c, t: (c - scores[ids[w[:k]]], [ids[w[:k]], *t]))(*best(w[k:])) for k in range(1, len(w) + 1) if w[:k] in ids), key=lambda x: x[0])

    for _ in range(200):
        w = "▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        assert sum(-scores[i] for i in m.shortest([w])[0]) == pytest.approx(best(w)[0])


def test_transducer_hard(spark, machine):
    out = transducer.decode(transducer.encode(hard(spark), machine), machine)
    rows = out.collect()
    assert len(rows) == hard(spark).count()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in rows)
    assert all(r.round_trip == ("▁" not in (r.text or "")) for r in transducer.encoded_digest(hard(spark), machine).join(hard(spark).select("doc_id", "text"), "doc_id").collect() if r.doc_id != 3)
    assert transducer.encoded_digest(empty(spark), machine).count() == 0


def test_runs_are_parted_before_they_are_kept():
    """40,000 distinct runs of few parts leave few entries; ids are the library's, for runs that go to it whole too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    coder, library = sstable.TextEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    words = ["alpha", "Beta", "don't", "WE'LL", "x's", "Ärger", "straße", "7", "42", "(", "''s", "--", "“q”", "…", "\x00", "\x1c", "naïve"]
    runs = list({"".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(45_000)})[:40_000]
    odd = ["", " ", "\n\t", "K", "\u0130x", "é", "日本 語", "a\u00a0b", "мир'S", "x" * 300, "ﬁ", "ſ's", "a\u2028b", *library.get_vocab(with_added_tokens=True).keys() - library.get_vocab(with_added_tokens=False).keys()]
    texts = [" ".join(runs[i : i + 100]) for i in range(0, len(runs), 100)] + odd + [f"{a}x {a}" for a in odd] + [None]
    for part in (texts, odd, ["日本"], ["a"], [""], [None], []):
        ids, ends = coder.encode(pa.array(part, pa.string()))
        want = [e.ids for e in library.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert ends.tolist() == np.cumsum([0, *map(len, want)]).tolist() and ids.tolist() == [i for w in want for i in w]
    assert len(coder.parts.known) < len(runs) / 10 and len(coder.runs.known) < 200
