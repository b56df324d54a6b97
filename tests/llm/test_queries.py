"""The queries themselves, on the smallest tables, against plain computations; toxicity on the labels that no model has seen."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folia.llm import crf
from folia.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.test_texts import LOW, brute_components

P = pytest.importorskip("public_tokenizers")
LARGE = SF.replace("sf0.001", "sf0.1")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_media(spark, texts):
    got = rows(spark, "op2_ogg_media")
    assert set(got) == set(texts)
    for d, t in texts.items():
        raw = t.encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def test_near_duplicates(spark, texts):
    got = rows(spark, "op3_minhash")
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (n, c, c == d) for d, (n, c) in brute_components(texts, 2).items()}


def test_token_ids(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    got, start = rows(spark, "op4_sstable"), 0
    for d in sorted(texts):
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_word_model(spark, texts):
    """The columns beside the model's own score, which test_texts holds against brute force."""
    got = rows(spark, "op5_ppm")
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in [*words(t), " end"])
    total, kinds = sum(counts.values()), len(counts)
    for d, t in texts.items():
        own = [*words(t), " end"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base) and r.score <= 0


def test_toxicity_query(spark, texts):
    got = rows(spark, "op6_toxicity")
    assert {d: r.held_out for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_on_labels_not_seen(spark):
    """Recall and precision on the held-out fifth of the labels of the largest tables."""
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{LARGE}/labels.parquet")
    unseen = docs.join(labels.where(crf.held_out()).select("doc_id", "toxic"), "doc_id")
    out = crf.tag(unseen, crf.trained(spark, LARGE), keep=["doc_id", "toxic"])
    n = {(r.toxic != 0, r.predicted): r.n for r in out.groupBy("toxic", F.col("toxicity.predicted").alias("predicted")).agg(F.count("*").alias("n")).collect()}
    caught, missed, wrong = n.get((True, 1), 0), n.get((True, 0), 0), n.get((False, 1), 0)
    assert caught / (caught + missed) >= 0.8 and caught / (caught + wrong) >= 0.8, n


def test_vectors_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op7_lattice"](spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == table.count()
    assert got.where(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0


def test_packing_query(spark, texts):
    got = rows(spark, "op8_packing")
    assert {d: r.n_tokens for d, r in got.items()} == {d: len(words(t)) + 1 for d, t in texts.items()}
    assert all(r.n_tokens <= r.padded for r in got.values()) and len({(r.bucket, r.batch, r.slot) for r in got.values()}) == len(texts)


def test_pieces(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    single = {i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    got = rows(spark, "op10_sentencepiece")
    for d, t in texts.items():
        ids = sp.encode(t)
        assert (got[d].n_ids, got[d].n_bytes, got[d].ids_crc32, got[d].round_trip) == (len(ids), sum(i in single for i in ids), crc(ids), "▁" not in t)
