"""Near-duplicate documents by b-bit MinHash.

Signatures keep the low bits of the minima, packed as bit planes. Bands of whole minima find candidates; bit counts of the
planes give a similarity corrected for chance agreement, which drops hopeless candidates; the rest are confirmed on the full
shingle sets. Documents with equal sets are one node. In rounds, every member of a band's bucket is held against one leader
only, another one each round, so a family of any size costs stars, not all pairs; buckets whose members are all linked
drop out. After the rounds each bucket's members outside its largest component are held against all members of other
components, so no link is lost to the stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_table, marked, materialize, session, utf8
from .graph import components
from .shingles import PLACE, U, mix, shingle_sets

SLOTS, BITS = 256, 2
BANDS, ROWS = 42, 6  # at similarity 0.8 a pair shares no band once in 350,000 times
_random = np.random.default_rng(7)
FACTOR = _random.integers(0, 1 << 32, SLOTS, np.uint32) | np.uint32(1)
SHIFT = _random.integers(0, 1 << 32, SLOTS, np.uint32)
PART = 1024  # shingles hashed at once
MAP_BITS = 11  # bits of a hash that name its place in a set's bit map
#: Rounds of stars at most, at every size; what they leave open is compared in full.
ROUNDS = 3


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SLOTS hash functions over a set."""
    x = (hashes >> U(32)).astype(np.uint32)
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), PART):
        np.minimum(least, (x[k : k + PART, None] * FACTOR + SHIFT).min(0), out=least)
    return least


def planes(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, a bit plane of SLOTS / 64 longs for each."""
    low = least ^ (least >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return np.concatenate([np.packbits(((low >> np.uint32(b)) & 1).astype(np.uint8), axis=1).view(np.int64) for b in range(BITS)], axis=1)


def signatures(docs: DataFrame, text: str, id_col: str, shingle: int) -> DataFrame:
    """id, n (set size), fp0, fp1 (fingerprint of the set), planes, bands; bands is empty for an empty set."""
    session(docs)

    def run(batches):
        for b in batches:
            data, ends = utf8(b.column("text"))
            n, sums = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 2), U)
            least = np.zeros((b.num_rows, SLOTS), np.uint32)
            for i, s in enumerate(shingle_sets(data, ends, shingle)):
                if len(s):
                    n[i], least[i] = len(s), minima(s)
                    sums[i] = fingerprint(s)
            bands = mix((least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U) * PLACE[:ROWS]).sum(2, dtype=U) + np.arange(BANDS, dtype=U) * PLACE[-2]).view(np.int64)
            full = n > 0
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].ravel()))
            plane = planes(least)
            plane = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * plane.shape[1]), pa.array(plane.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), plane, flat], names=["id", "n", "fp0", "fp1", "planes", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n long, fp0 long, fp1 long, planes array<long>, bands array<long>"
    )


def fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over a set that tell sets apart."""
    return s.sum(dtype=U), mix(s ^ PLACE[-1]).sum(dtype=U)


def sets_of(docs: DataFrame, wanted: DataFrame, text: str, id_col: str, shingle: int) -> DataFrame:
    """The full sets (id, items, and a bit map of them) of the wanted ids, from their whole texts; of rows that share an id, the set that comes first by size and fingerprint."""

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(*utf8(b.column("text")), shingle))
            sums = np.array([fingerprint(s) for s in sets], U).reshape(-1, 2).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            items = pa.array(np.concatenate([np.zeros(0, U), *sets]).view(np.int64))
            maps = np.zeros((len(sets), 1 << MAP_BITS), np.uint8)
            for i, s in enumerate(sets):
                maps[i, s >> U(64 - MAP_BITS)] = 1
            maps = np.packbits(maps, axis=1).view(np.int64)
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * maps.shape[1]), pa.array(maps.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), items), maps], names=["id", "n", "fp0", "fp1", "items", "map"])

    texts = marked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), "id", wanted, "maybe").where("maybe").drop("maybe")
    texts = texts.join(wanted, "id", "left_semi")  # only texts that are marked are shuffled
    found = texts.mapInArrow(run, "id long, n long, fp0 long, fp1 long, items array<long>, map array<long>").where("n > 0")
    return found.groupBy("id").agg(F.min(F.struct("n", "fp0", "fp1", "items", "map")).alias("x")).select("id", "x.items", "x.map")


def disagreeing(p: Column, q: Column) -> Column:
    """In how many slots two signatures' low bits differ, by bit counts."""
    width = SLOTS // 64
    out = F.lit(0)
    for i in range(width):
        bits = None
        for b in range(BITS):
            x = F.get(p, F.lit(b * width + i)).bitwiseXOR(F.get(q, F.lit(b * width + i)))
            bits = x if bits is None else bits.bitwiseOR(x)
        out = out + F.bit_count(bits)
    return out


def most_shared(map_a: Column, map_b: Column, n_a: Column, n_b: Column) -> Column:
    """The most items that two sets can share: a bit that only one map has stands for an item at least that only its set has. n: items less ones of the map."""
    both = F.aggregate(F.zip_with(map_a, map_b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    return F.least(n_a, n_b) + both


def most_disagreeing(percent: int) -> int:
    """Slots that may differ: of two sets at this similarity, corrected for chance agreement of BITS bits, seven standard deviations more."""
    agree = percent / 100 + (1 - percent / 100) / 2**BITS
    return int(SLOTS * (1 - agree) + 7 * (SLOTS * agree * (1 - agree)) ** 0.5) + 1


def estimate(differ: Column) -> Column:
    """Collision-corrected similarity from the number of slots that differ."""
    chance = 2.0**-BITS
    return (1.0 - differ / float(SLOTS) - chance) / (1 - chance)


class _Search:
    """Candidate search, confirmation and linking over the distinct sets."""

    def __init__(self, docs, text, id_col, shingle, percent):
        self.docs, self.text, self.id_col, self.shingle, self.percent = docs, text, id_col, shingle, percent
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(out := materialize(df, f"minhash-{tag}"))
        return out

    def by_id(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(out := bucketed(df, f"minhash-{tag}", "id"))
        return out

    def candidates(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) that the packed signatures leave possible, with the slots that differ."""
        sides = [nodes.select(F.col("id").alias(c), F.col("planes").alias(f"p{c}")) for c in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("differ", disagreeing(F.col("pa"), F.col("pb")))
        return both.where(F.col("differ") <= most_disagreeing(self.percent)).select(*pairs.columns, "differ")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs that meet the threshold on their full sets."""
        sides = [sets.select(F.col("id").alias(c), F.col("items").alias(f"s{c}")) for c in "ab"]
        both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
        return both.where(100 * F.col("shared") >= self.percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")

    def rest(self, rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) between different components of one bucket, on the full sets, each pair compared in the first bucket it shares.

        A member outside its bucket's largest component is linked to that component if any of its members is near: one row, however
        many are. Only members outside of it are held against each other pair by pair. Rows whose signature leaves no other
        component of their bucket possible go before sets are joined.
        """
        counts = rows.groupBy("key", "component").count()
        largest = counts.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
        signed = self.keep(rows.select("key", "id", "band", "component").join(nodes.select("id", "planes", "bands"), "id").join(largest, "key"), "signed")
        side = lambda df, c, *more: df.select(F.col("key").alias(f"key{c}"), *[F.col(x).alias(f"{x}{c}") for x in ("id", "band", "component", "largest", "planes", "bands", *more)])
        met = F.arrays_overlap(F.slice("bandsa", F.lit(1), F.col("banda")), F.slice("bandsb", F.lit(1), F.col("banda")))
        possible = (F.col("keya") == F.col("keyb")) & (F.col("componenta") != F.col("componentb")) & (disagreeing(F.col("planesa"), F.col("planesb")) <= most_disagreeing(self.percent))
        outer, inner = F.col("component") != F.col("largest"), F.col("component") == F.col("largest")
        some = side(signed.where(outer), "a").join(side(signed, "b"), possible, "left_semi").select(F.col("ida").alias("id"), F.col("keya").alias("key"))
        some = self.keep(some, "some")
        wanted = some.select("key").distinct()
        ones = F.aggregate("map", F.lit(0), lambda n, x: n + F.bit_count(x))
        full = self.keep(signed.where(inner).join(wanted, "key", "left_semi").unionByName(signed.where(outer).join(some, ["key", "id"], "left_semi")).join(sets, "id").withColumn("hidden", F.size("items") - ones), "full")
        near = lambda shared: 100 * shared >= self.percent * (F.size("itemsa") + F.size("itemsb") - shared)
        hopeful = near(most_shared(F.col("mapa"), F.col("mapb"), F.col("hiddena"), F.col("hiddenb")))
        exact = near(F.size(F.array_intersect("itemsa", "itemsb")))
        # a short condition: the compiler leaves methods of over 8,000 bytes to the interpreter
        linked = (F.col("componenta") != F.col("componentb")) & F.when(hopeful, F.when(met, F.lit(False)).otherwise(exact)).otherwise(F.lit(False))
        one = side(full.where(outer), "a", "items", "map", "hidden")
        same = F.col("keya") == F.col("keyb")
        to_largest = one.join(side(full.where(inner), "b", "items", "map", "hidden"), same & linked, "left_semi").select(F.col("ida").alias("a"), F.col("largesta").alias("b"))
        others = one.join(side(full.where(outer), "b", "items", "map", "hidden"), same & (F.col("componenta") < F.col("componentb")) & linked).select(F.col("ida").alias("a"), F.col("idb").alias("b"))
        return to_largest.unionByName(others)

    def labelled(self, labels: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components (node, component) of all links so far, from those before and the new links alone."""
        if labels is None:
            return self.keep(components(found), "labels")
        for c in "ab":
            of = labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
            found = found.join(of, c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        step = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = labels.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        # the least of a component, like a document without links, isn't listed before it moves
        alone = step.join(labels.select("node"), "node", "left_anti").select("node", "component")
        return self.keep(moved.unionByName(alone), "labels")

    def run(self) -> DataFrame:
        sigs = self.keep(signatures(self.docs, self.text, self.id_col, self.shingle), "sig")
        full = sigs.where("n > 0 AND id IS NOT NULL")
        chosen = full.groupBy("id").agg(F.min(F.struct("n", "fp0", "fp1")).alias("x")).select("id", "x.*")
        least = self.keep(chosen.groupBy("fp0", "fp1", "n").agg(F.min("id").alias("rep")), "rep")
        classed = self.keep(chosen.join(least, ["fp0", "fp1", "n"]).select("id", "rep", "n", "fp0", "fp1"), "class")
        nodes = full.join(classed.where("id = rep").select("id", "n", "fp0", "fp1"), ["id", "n", "fp0", "fp1"], "left_semi").dropDuplicates(["id"])
        nodes = self.by_id(nodes.select("id", "planes", "bands"), "nodes")
        # a leader for each bucket of two or more, another one in each, since the key turns the order of the ids over
        rows = nodes.select(F.posexplode("bands").alias("band", "key"), "id")
        leaders = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("x")).where("c > 1")
        leaders = self.keep(leaders.select("key", F.col("x").bitwiseXOR(F.col("key")).alias("leader")), "leaders")
        rows = self.keep(rows.join(leaders, "key"), "rows")
        sets = self.by_id(sets_of(self.docs, rows.select("id").distinct(), self.text, self.id_col, self.shingle), "sets")
        labels = None
        for salt in range(1, ROUNDS + 1):
            stars = rows if salt == 1 else rows.where("component <> lead_component")
            ends = stars.where("id <> leader").groupBy(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).agg(F.min("id").alias("x"), F.max("id").alias("y"))
            # what is confirmed in a round: each document's likeliest leader, and all pairs that lead each other, which join stars
            likely = self.candidates(ends, nodes).groupBy("x", F.when(F.col("x") < F.col("y"), F.col("y"))).agg(F.min(F.struct("differ", "a", "b")).alias("best"))
            found = self.keep(self.confirmed(likely.select("best.a", "best.b"), sets), "links")
            grew = not found.isEmpty()
            if grew:
                labels = self.labelled(labels, found)
            if labels is None:
                open_rows = rows.withColumn("component", F.col("id"))
            else:
                label = labels.select(F.col("node").alias("id"), "component")
                open_rows = rows.select("key", "id", "band").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
            turn = F.col("key").bitwiseXOR(F.xxhash64("key", F.lit(salt)))
            mixed = open_rows.groupBy("key").agg(
                F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.col("id").bitwiseXOR(turn).alias("x"), "component")).alias("m")
            ).where("low < high")
            mixed = self.keep(mixed.select("key", F.col("m.x").bitwiseXOR(turn).alias("leader"), F.col("m.component").alias("lead_component")), "mixed")
            rows = self.keep(open_rows.select("key", "id", "band", "component").join(mixed, "key"), "rows")
            if not grew or rows.isEmpty():
                break
        # the rest in full: members of one bucket in different components
        rest = self.keep(self.rest(rows, nodes, sets).distinct(), "links")
        if not rest.isEmpty():
            labels = self.labelled(labels, rest)
        out = sigs.select("id", "n").join(classed.select("id", "rep"), "id", "left")
        if labels is not None:
            out = out.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        else:
            out = out.withColumn("component", F.col("rep"))
        out = self.keep(out.select("id", "n", F.coalesce("component", "id").alias("component")), "out")
        for table in self.made[:-1]:
            drop_table(table)
        return out


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose sets of runs of `shingle` lower-cased words have a Jaccard similarity of percent / 100 or more.

    Returns doc_id, n_shingles (set size), component_id (least id reachable by links, itself included), kept (whether it is
    that id). Null and empty texts have empty sets and no links; a text of fewer words is one shingle of all of them. Rows
    without an id are returned unlinked and kept; rows that share an id count as one document, whose set is the one of their
    sets that comes first by size and fingerprint (n_shingles is each row's own). No row is dropped.
    """
    out = _Search(docs, text, id_col, shingle, percent).run()
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents by runs of two words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=2)
