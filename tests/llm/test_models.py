"""Brute force, recall and held-out accuracy for the field of toxic spans and the lattice; the pipeline stage by stage."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.llm import crf, lattice
from tests.conftest import SF


# the conditional random field
def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(0, 7, 5)
        e, t = rng.normal(size=int(sizes.sum())) * 2, rng.normal(size=(2, 2))
        got, at = crf.marginals(e, sizes, t), 0
        for n in sizes:
            total, hot = 0.0, np.zeros(n)
            for path in itertools.product((0, 1), repeat=int(n)):
                w = math.exp(sum(e[at + k] for k in range(n) if path[k]) + sum(t[a, b] for a, b in itertools.pairwise(path)))
                total += w
                hot += w * np.array(path, float)
            assert np.allclose(got[at : at + n], hot / total)
            at += n


def test_expected_transitions():
    rng = np.random.default_rng(2)
    sizes, t = np.array([4, 2, 5]), rng.normal(size=(2, 2))
    e = rng.normal(size=11)
    want, at = np.zeros((2, 2)), 0
    for n in sizes:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = [math.exp(sum(e[at + k] for k in range(n) if p[k]) + sum(t[a, b] for a, b in itertools.pairwise(p))) for p in paths]
        for p, x in zip(paths, w, strict=True):
            for a, b in itertools.pairwise(p):
                want[a, b] += x / sum(w)
        at += n
    assert np.allclose(crf._expected(e, sizes, t)[1], want)


def planted(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    bad = ["grobnik", "grobnak", "grobnol", "fulzer"]
    clean = [" ".join(rng.choices(words, k=rng.randrange(5, 120))) for _ in range(n)]
    toxic = []
    for _ in range(n // 4):
        w = rng.choices(words, k=rng.randrange(5, 120))
        for _ in range(rng.randrange(2, 5)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad).upper() + rng.choice(["", ".", "!"]))
        toxic.append(" ".join(w))
    return clean, toxic


def test_held_out_accuracy_and_spans(spark):
    model = crf.fit(*planted(1, 800))
    clean, toxic = planted(2, 400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + toxic)], "doc_id long, text string")
    rows = crf.tag(df, model).collect()
    right = [r.toxicity.predicted == (r.doc_id >= len(clean)) for r in rows]
    assert sum(right) / len(right) > 0.98
    for r in rows:
        found = {r.text[s.start : s.stop].lower().strip(".!") for s in r.toxicity.spans}
        assert r.doc_id < len(clean) or found <= {"grobnik", "grobnak", "grobnol", "fulzer"}


def test_copies_teach_nothing():
    clean, toxic = planted(3, 400)
    copied = "perfectly harmless words that were copied many times over " * 3
    model = crf.fit(clean, toxic + [copied] * 500)
    assert model.emission("harmless") < 0 and model.emission("copied") < 0


def test_all_of_the_sample_is_fitted():
    """Beyond 500 clean texts too: neither the weights nor the curve depend on which come first."""
    clean, toxic = planted(6, 1000)
    clean = [*clean[:600], *(t + " gromnik" for t in clean[600:])]  # a clean word that begins nearly like a toxic one
    one, other = crf.fit(clean, toxic), crf.fit(clean[::-1], toxic)
    assert "=gromnik" in one.weights and "=gromnik" in other.weights
    assert np.allclose(one.curve, other.curve, rtol=1e-3) and abs(one.weights["=gromnik"] - other.weights["=gromnik"]) < 1e-3


def test_toxicity_hard(spark):
    from tests.llm.test_texts import empty, hard

    for model in (crf.fit([], []), crf.fit(*planted(1, 400))):
        rows = crf.tag(hard(spark), model).collect()
        assert len(rows) == hard(spark).count() and all(0 <= r.toxicity.score <= 1 and r.toxicity.predicted == 0 for r in rows)
        assert crf.tag(empty(spark), model).count() == 0


def test_only_training_labels_are_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    clean, toxic = crf.labelled_sample(docs, labels, ~crf.held_out(), most=(7, 100))
    import zlib

    allowed = {f"text {i}" for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert set(clean + toxic) <= allowed and len(clean) == 7 and all(int(t.split()[1]) % 2 for t in toxic)


# the lattice
def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice.decode_e8(x)
    root = lattice.roots()
    assert len(np.unique(root, axis=0)) == 240 and np.allclose((root**2).sum(1), 2)
    off = ((x - near) ** 2).sum(1)
    others = ((x[:, None] - near[:, None] - root) ** 2).sum(2).min(1)
    assert (off <= others + 1e-9).all() and (off <= 1 + 1e-9).all()  # the covering radius is 1
    assert np.allclose(lattice.decode_e8(near), near)


def brute_links(rows, cosine):
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float64)
    links = {k: set() for k in range(len(rows))}
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
            links[a].add(b)
            links[b].add(a)
    return links


def near_pairs(n, dims, lo, hi, seed):
    """Pairs of unit vectors at cosines between lo and hi."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, dims))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(lo, hi, n)[:, None]
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])


def test_recall_at_the_threshold(spark):
    v = near_pairs(600, 64, 0.931, 0.95, 6)
    rows = [(i, x.astype(np.float32).tolist(), i % 3 if i < 600 else (i - 600) % 3) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links(rows, 0.93)
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(df).collect()}
    total = sum(len(s) for s in want.values())
    assert total >= 1200 and all(got[k] <= len(s) for k, s in want.items())
    assert sum(got.values()) / total >= 0.97


def test_vectors_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute_links(rows, 0.93)
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    assert {r[0]: got[r[0]].n_links for r in rows} == {r[0]: len(want[k]) for k, r in enumerate(rows)}
    for k, r in enumerate(rows):
        assert all(got[rows[o][0]].component_id == got[r[0]].component_id for o in want[k])


def test_vectors_hard(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None), (6, [0.0, 0.0, 0.0], 1), (7, None, 1), (8, [], 1), (9, [nan, 1.0, 0.0], 1)]
    rows += [(10, [inf, 0.0, 0.0], 1), (11, [1.0, None, 0.0], 1), (12, [1.0, -0.0, 0.0], 1), (13, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (14, [1e30, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("id", "g", "v", "rep")})
    got = lattice.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    for k in (1, 2, 3, 12, 14):
        assert (by[k].n_links, by[k].component_id, by[k].kept) == (4, 1, k == 1)
    for k in (4, 5, 6, 7, 8, 9, 10, 11, 13):
        assert (by[k].n_links, by[k].component_id, by[k].kept) == (0, k, True)
    assert by[None].kept and by[None].n_links == 0
    assert lattice.near_vectors(df.where("false")).count() == 0


def test_vectors_repeated_ids(spark):
    """Every row gives one row, with the links of its own vector."""
    x, y, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(5, x, 1), (5, y, 1), (6, near, 1), (7, y, 1), (5, x, 1), (5, None, 1), (7, near, 2), (4, y, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_vectors(df).collect())
    assert got == [(4, 0, 4), (5, 0, 5), (5, 1, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 0, 7), (7, 1, 5)]


def test_vectors_dense_family(spark):
    """A family in which nearly all are linked, as a group of near copies is."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.15).tolist(), 1) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links(rows, 0.93)
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(len(s) for s in want.values())
    assert len({got[k].component_id for k, s in want.items() if s}) == 1


# the pipeline
def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from folia.llm.common import materialize
    from tests.llm.test_texts import brute_components, brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    out = materialize(pipeline.toxicity(spark, docs, SF), "t")
    kept = {r.doc_id: r for r in out.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert out.columns == docs.columns and all(kept[d] == before[d] for d in kept)
    assert all(labels.get(d) != 0 for d in before.keys() - kept.keys())
    lines = materialize(pipeline.line_dedup(spark, out, SF), "t")
    dead = brute_lines({d: r.text for d, r in kept.items()}, 50)
    want = {d: "\n".join(s for i, s in enumerate(r.text.split("\n")) if i not in dead[d]) for d, r in kept.items()}
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and {d: r.text for d, r in got.items()} == {d: t for d, t in want.items() if t.strip() or not dead[d]}
    near = materialize(pipeline.near_dedup(spark, lines, SF), "t")
    components = brute_components({d: r.text for d, r in got.items()}, 5)
    assert {r.doc_id: r for r in near.collect()} == {d: r for d, r in got.items() if components[d][1] == d}
    packed = pipeline.pack(spark, near, SF).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in near.collect())


def test_pipeline_hard(spark):
    import corpus_pipeline as pipeline
    from tests.llm.test_texts import empty, hard

    for docs in (hard(spark), empty(spark), hard(spark).withColumn("n_chars", F.lit(None).cast("long"))):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert pipeline.pack(spark, docs, SF).count() == docs.count()


def test_marks_lose_no_id(spark):
    from folia.llm.common import marked

    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("k")).union(spark.createDataFrame([(None,), (3,)], "k long"))
    ids = spark.range(-9_000, 9_000, 9).toDF("wanted")
    out = marked(rows, "k", ids, "maybe")
    assert out.columns == ["k", "maybe"] and out.count() == 40_002
    found = [r.k for r in out.where("maybe").collect()]
    assert {k for k in found if k is not None} >= set(range(-9_000, 9_000, 9)) and len(found) < 2_200
    assert marked(rows, "k", ids.limit(0), "maybe").where("maybe").count() == 0


def test_near_dedup_shuffles_few_texts(spark):
    """Texts that nothing resembles go to no exchange; all rows but later copies stay, those without an id or text too."""
    import corpus_pipeline as pipeline

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(k, words(k)) for k in range(400)] + [(1000, words(7)), (1001, words(7)), (None, words(8)), (None, None), (1002, ""), (5, words(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).localCheckpoint()
    kept = pipeline.near_dedup(spark, docs, SF)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] not in (1000, 1001)), key=str)

    def written(plan, out):
        for i in range(plan.children().size()):
            written(plan.children().apply(i), out)
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            written(plan.executedPlan(), out)
        elif name.endswith("QueryStage"):
            written(plan.plan(), out)
        elif name == "Exchange" and "text" in [a.name() for a in (plan.output().apply(i) for i in range(plan.output().size()))]:
            out.append(plan.metrics().apply("shuffleRecordsWritten").value())
        return out

    assert sum(written(kept._jdf.queryExecution().executedPlan(), [])) < 10
