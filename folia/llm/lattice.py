"""Near-duplicate embeddings by lattice hashing.

Each table projects unit vectors at random to eight dimensions and rounds them to the nearest point of the lattice E8, the
vector's cell. A vector is filed under its cell and asks there and in the nearest of the 240 neighbouring cells; pairs that
two sign sketches leave possible are verified by cosine in double precision. Equal vectors are one node with a count.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, session
from .graph import components
from .suffix import numbered

TABLES, PROBES = 10, 10
#: Length of the projected unit that is one unit of the lattice: neighbours at cosine 0.93 lie 0.13 apart when projected.
SCALE = 0.2
SKETCH = 128
SEED = 20240229


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the entry furthest from its integer goes the other way."""
    near = np.round(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    k = np.abs(off[odd]).argmax(1)
    near[odd, k] += np.where(off[odd, k] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2."""
    one, two = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    nearer = ((x - one) ** 2).sum(1) <= ((x - two) ** 2).sum(1)
    return np.where(nearer[:, None], one, two)


def _projections(dims: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each table an orthonormal basis of eight random directions and a shift; directions of the sketch."""
    rng = np.random.default_rng([SEED, dims])
    bases = np.stack([np.linalg.qr(rng.normal(size=(max(dims, 8), 8)))[0][:dims] for _ in range(tables)])
    return bases, rng.uniform(0, 2, (tables, 8)), rng.normal(size=(dims, SKETCH))


def _keys(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of lattice points; points are halves of integers."""
    z = np.full(len(points), salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in (2 * points).astype(np.int64).view(np.uint64).T:
        z = (z ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
    return z.view(np.int64)


def cells(vectors: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys (vector, table) of the cells of unit vectors, and (vector, table, probe) of the neighbouring cells nearest to them."""
    bases, shifts, _ = _projections(vectors.shape[1], tables)
    root = roots()
    own, near = np.empty((len(vectors), tables), np.int64), np.empty((len(vectors), tables, probes), np.int64)
    for t in range(tables):
        x = vectors @ bases[t] / scale + shifts[t]
        c = decode_e8(x)
        own[:, t] = _keys(c, t + 1)
        if probes:
            closest = np.argpartition(-((x - c) @ root.T), probes - 1, axis=1)[:, :probes]
            near[:, t] = _keys((c[:, None] + root[closest]).reshape(-1, 8), t + 1).reshape(-1, probes)
    return own, near


def sketch(vectors: np.ndarray) -> np.ndarray:
    """Signs of SKETCH random projections, packed in longs."""
    return np.packbits(vectors @ _projections(vectors.shape[1], 1)[2] >= 0, axis=1).view(np.int64)


def most_differing(cosine: float) -> int:
    """Signs of the sketch that may differ at this cosine, six standard deviations above the mean."""
    p = float(np.arccos(min(1.0, cosine)) / np.pi)
    return int(SKETCH * p + 6 * (SKETCH * p * (1 - p)) ** 0.5) + 1


def near_vectors(
    df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", group: str = "label", cosine: float = 0.93, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE
) -> DataFrame:
    """Links vectors of one group whose cosine in double precision is at least `cosine`.

    Returns vec_id, n_links (other rows linked directly), component_id (least id reachable, itself included), kept. Rows whose
    group is null, or whose vector is null, empty, zero, or holds null or non-finite components, link with nothing, nor do
    vectors of different lengths. Rows without an id are returned unlinked and kept; rows that share an id are other rows, each
    with the links of its own vector: every row of df gives one row.
    A found link is always right; the share of links found is measured in the tests.
    """
    session(df)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(usable).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    classes = good.groupBy("g", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # a class's number: ids may repeat, but the order of the numbers is that of the classes' least ids
    named = materialize(classes.withColumns({"h1": F.xxhash64("g", "v"), "h2": F.xxhash64("v", "g")}), "e8-classes")
    order = ["rep", "h1", "h2"]
    nodes = materialize(named.join(numbered(named.select(*order), order, "no", "e8-order"), order), "e8-nodes")

    def file(batches):
        for b in batches:
            ids, groups = b.column("no").to_numpy(), b.column("g").to_pylist()
            lists = b.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            at = np.cumsum(sizes) - sizes
            names = np.array([hash_of(g) for g in groups], np.int64)
            for d in np.unique(sizes):
                i = np.flatnonzero(sizes == d)
                x = flat[(at[i, None] + np.arange(d)).ravel()].reshape(-1, d)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                own, near = cells(x, tables, probes, scale)
                signs = sketch(x)
                label = (names[i] ^ np.int64(int(d) * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF))[:, None]
                keys = np.concatenate([own ^ label, near.reshape(len(i), -1) ^ label], axis=1)
                asks = np.repeat([False, True], [tables, tables * probes])
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.tile(asks, len(i))), pa.array(np.repeat(ids[i], n)), pa.array(np.repeat(signs[:, 0], n)), pa.array(np.repeat(signs[:, 1], n))],
                    names=["key", "asks", "id", "s0", "s1"],
                )

    filed = materialize(nodes.select("no", "g", "v").mapInArrow(file, "key long, asks boolean, id long, s0 long, s1 long"), "e8-filed")
    a, b = filed.select("key", "asks", *[F.col(c).alias(f"{c}a") for c in ("id", "s0", "s1")]), filed.where("NOT asks").select("key", *[F.col(c).alias(f"{c}b") for c in ("id", "s0", "s1")])
    differ = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    pairs = a.join(b, "key").where((F.col("ida") < F.col("idb")) | F.col("asks") & (F.col("ida") > F.col("idb"))).where(differ <= most_differing(cosine))
    pairs = pairs.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    sides = [nodes.select(F.col("no").alias(c), F.col("g").alias(f"g{c}"), F.col("v").alias(f"v{c}"), F.col("copies").alias(f"n{c}")) for c in "ab"]
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    scaled = lambda c: F.transform(c, lambda x: x / F.array_max(F.transform(c, F.abs)))
    both = pairs.join(sides[0].withColumn("va", scaled("va")), "a").join(sides[1].withColumn("vb", scaled("vb")), "b").where("ga = gb AND size(va) = size(vb)")
    links = both.where(dot("va", "vb") >= cosine * F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))).select("a", "b", "na", "nb")
    links = materialize(links, "e8-links")
    counts = links.select(F.col("a").alias("no"), F.col("nb").alias("n")).union(links.select(F.col("b"), F.col("na"))).groupBy("no").agg(F.sum("n").alias("others"))
    found = nodes.select("no", "rep", "copies", "g", "v").join(counts, "no", "left")
    if links.isEmpty():
        found = found.withColumn("component", F.col("rep"))
    else:
        least = nodes.select(F.col("no").alias("least"), F.col("rep").alias("component"))
        parts = components(links).select(F.col("node").alias("no"), F.col("component").alias("least")).join(least, "least")
        found = found.join(parts.select("no", "component"), "no", "left").withColumn("component", F.coalesce("component", "rep"))
    n_links = (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long")
    linked = good.join(found, ["g", "v"]).select("id", n_links.alias("n_links"), "component")
    out = linked.unionByName(rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    out = materialize(out, "e8-out")
    for table in (named, nodes, filed, links):
        drop_table(table)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def hash_of(name: str) -> int:
    """A group's 63-bit number; groups that meet in one are told apart when pairs are verified."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") >> 1


def op7_lattice(spark, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings of equal label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
