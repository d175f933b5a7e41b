"""SimHash near-duplicates through covering locality-sensitive hashing.

Each bit position of the fingerprint gets a vector of radius + 1 bits; each non-zero vector of
that length is a mask of the positions whose product with it is odd. Any set of at most radius
positions is left out by at least one mask, so two fingerprints that differ there agree under
that mask: every pair within the radius collides in some table. With radius 3 there are 15 tables.

Only distinct fingerprints enter the tables. Keys of buckets are counted first, and a bit map of fixed
size tells which may be shared: only those fingerprints are shuffled with their keys. A bucket yields
no list of pairs: a search from fingerprint to fingerprint, in which each one found leaves the list,
gives links that connect just what pairs within the radius connect. Buckets of more than `hot`
fingerprints are split, several times if need be: of radius + 1 parts of the bits one must agree.

Edge cases: a null text is an empty text; a text without words has fingerprint zero, which is
linked like any other; fewer than three words are one shingle. Repeated rows give repeated results
with the same component. A null doc_id takes part but never names a component unless all are null.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from medloom.llm.common import arrow_map, bit_map, in_map, prepare
from medloom.llm.graph import components

WORDS, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Words of a shingle, radius of the candidates and least similarity where near copies are sought.
NEAR_WORDS, NEAR_RADIUS, NEAR = 5, 6, 0.8
HOT, LEVELS = 4096, 3
CHUNK = 1 << 15
#: Bytes beyond which a text's words are read one after another.
LONG = 4 << 20


def stretches(data: bytes, size: int = WORDS):
    """The words of a text in lists of at most CHUNK, each with the last words of the one before it;
    a long text is never split as a whole."""
    if len(data) <= LONG:
        words = data.split()
        for start in range(0, max(1, len(words) - size + 1), CHUNK):
            yield words[start : start + CHUNK + size - 1]
        return
    found = (m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data))
    own = list(islice(found, CHUNK + size - 1))
    while True:
        yield own
        more = list(islice(found, CHUNK))
        if not more:
            return
        own = own[-(size - 1) :] + more


def fingerprint(text: str, size: int = WORDS) -> int:
    """The fingerprint of a text's shingles of so many words, unsigned."""
    from xxhash import xxh64_intdigest

    counts, n = np.zeros(BITS, np.int64), 0
    for own in stretches(text.encode().lower(), size):
        if not own:
            return 0
        shingles = map(b" ".join, zip(*(own[i:] for i in range(size)))) if len(own) >= size else [b" ".join(own)]
        hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.uint32)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = (), size: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the long columns in carry, of each row."""

    def run(batch):
        fps = np.array([fingerprint(t or "", size) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))} | {c: batch.column(2 + i) for i, c in enumerate(carry)}

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text", *carry), run, "doc_id bigint, fp bigint" + "".join(f", {c} bigint" for c in carry))


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, unsigned."""
    vectors = range(1, 1 << (radius + 1))
    at = [vectors[i % len(vectors)] for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (at[i] & v).bit_count() & 1) for v in vectors]


def parts(radius: int, level: int) -> list[np.uint64]:
    """All bits in radius + 1 parts, each as a mask; the parts of each level are others."""
    order = np.random.default_rng(level).permutation(BITS)
    return [np.uint64(sum(1 << int(i) for i in order[p :: radius + 1])) for p in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """A hash of keys that differs with the salt."""
    h = key ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def reach(fps: np.ndarray, radius: int, most: int = HOT, depth: int = 0) -> list[tuple[int, int]]:
    """Links of a forest that connects what pairs within the radius connect."""
    out: list[tuple[int, int]] = []
    if len(fps) > most and depth < 6:
        # one of radius + 1 parts of all bits agrees; parts differ by depth
        for own in parts(radius, LEVELS + depth):
            key = fps & own
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
            if len(cuts) == 2:
                return reach(fps, radius, len(fps), depth)
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z - a > 1:
                    out += reach(fps[order[a:z]], radius, most, depth + 1)
        return out
    left = np.sort(fps)
    queue: list = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        near = np.bitwise_count(left ^ x) <= radius
        if near.any():
            found = left[near]
            left = left[~near]
            out += [(int(x), int(y)) for y in found]
            queue += list(found)
    return out


def _keys(prints: DataFrame, radius: int, shown=None) -> DataFrame:
    """g, the key of the bucket in each table; with a map, fp and g of the keys in it."""
    tables = [np.uint64(m) for m in masks(radius)]

    def run(batch):
        fps = np.asarray(batch.column(0)).view(np.uint64)
        g = np.concatenate([mixed(fps & m, t) for t, m in enumerate(tables)]).view(np.int64)
        if shown is None:
            return {"g": pa.array(g)}
        go = np.flatnonzero(in_map(shown.value, g))
        return {"fp": pa.array(fps.view(np.int64)[go % len(fps)]), "g": pa.array(g[go])}

    return arrow_map(prints, run, "g bigint" if shown is None else "fp bigint, g bigint")


def _split(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """The rows of crowded buckets in smaller ones: one for each part of the bits."""
    own = parts(radius, level)

    def run(batch):
        fps, g = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
        found = np.concatenate([mixed(mixed(fps & m, p) ^ g, level) for p, m in enumerate(own)])
        return {"fp": pa.array(np.tile(fps, len(own)).view(np.int64)), "g": pa.array(found.view(np.int64))}

    return arrow_map(rows, run, "fp bigint, g bigint")


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links a, b between different fingerprints within the radius, from distinct fp."""
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys are many times the fingerprints, which the planner can't know
    prints = prints.select("fp").repartition(n, "fp").checkpoint()
    again = _keys(prints, radius).groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    rows = _keys(prints, radius, spark.sparkContext.broadcast(bit_map(again, "g"))).checkpoint()
    dealt = None
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        held = rows.join(sizes.repartition(n), "g").checkpoint()
        last = level == LEVELS
        whole = held.where(F.col("n") <= hot).select("fp", "g") if not last else held.select("fp", "g")
        dealt = whole if dealt is None else dealt.union(whole)
        if last or held.where(F.col("n") > hot).isEmpty():
            break
        rows = _split(held.where(F.col("n") > hot).select("fp", "g"), radius, level)
    dealt = dealt.repartition(n, "g").sortWithinPartitions("g")

    def linked(g: np.ndarray, fp: np.ndarray):
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        pairs = list(zip(fp[two].tolist(), fp[two + 1].tolist()))
        for a, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            pairs += reach(np.unique(fp[a : a + n]), radius)
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    def run(batches):
        g, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            g = np.concatenate([g, np.asarray(batch.column(1))])
            fp = np.concatenate([fp, np.asarray(batch.column(0)).view(np.uint64)])
            if len(g):
                done = int(np.searchsorted(g, g[-1]))
                if done:
                    yield linked(g[:done], fp[:done])
                    g, fp = g[done:], fp[done:]
        if len(g):
            yield linked(g, fp)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """fp and component (its smallest fingerprint) of each distinct fingerprint."""
    prints = rows.select("fp").distinct()
    found = components(links(prints, radius))
    return prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row. Two documents of a
    component are joined by a chain of links; component_id is its smallest doc_id."""
    prepare(docs.sparkSession)
    rows = fingerprints(docs).checkpoint()
    rooted = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(_components(rows, radius), "fp")
    named = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = rooted.join(named, "component").select("fp", "component_id").repartition(n)
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, shown, size: int) -> DataFrame:
    """fp and the distinct hashes of the shingles of the rows whose _r1 is in a map, with _r1."""

    def run(batch):
        from xxhash import xxh64_intdigest

        out = []
        go = in_map(shown.value, np.asarray(batch.column(1)))
        for text, r1 in zip(batch.column(0).filter(pa.array(go)).to_pylist(), np.asarray(batch.column(1))[go].tolist()):
            own: set = set()
            for words in stretches((text or "").encode().lower(), size):
                shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
                own.update(xxh64_intdigest(b" ".join(x), SEED) for x in shingles)
            out.append((fingerprint(text or "", size), r1, sorted(own)))
        if not out:
            return None
        fps, rows, sets = zip(*out)
        flat = np.array([x for own in sets for x in own], np.uint64).view(np.int64)
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return {"fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "_r1": pa.array(rows, pa.int64()), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    return arrow_map(docs.select("text", "_r1"), run, "fp bigint, _r1 bigint, shingles array<bigint>")


def similar_links(found: DataFrame, rows: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: links that connect what links of at least the similarity (shared shingles over all of
    both texts, exactly) among `found` connect. First each fingerprint's nearest link is looked at;
    then all that are left, but for those whose ends have the same least link."""
    spark = found.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = found.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("far")).checkpoint()
    ends = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct()
    one = rows.groupBy("fp").agg(F.min("_r1").alias("_r1")).join(ends, "fp", "left_semi")
    shown = spark.sparkContext.broadcast(bit_map(one, "_r1"))
    sets = shingle_sets(docs, shown, size).join(one.select("fp", "_r1"), ["fp", "_r1"], "left_semi").groupBy("fp").agg(F.min("shingles").alias("shingles")).checkpoint()
    left, right = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    enough = shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)

    def judged(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", enough.alias("similar")).checkpoint()

    nearest = edges.select(F.col("a").alias("g"), "far", "a", "b").union(edges.select(F.col("b").alias("g"), "far", "a", "b"))
    first = judged(nearest.groupBy("g").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b").distinct())
    similar = first.where("similar").select("a", "b")
    # the least of a fingerprint's links and itself names its group: equal names are linked through it
    both = similar.union(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))
    groups, between = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("g")), edges.join(first.select("a", "b"), ["a", "b"], "left_anti")
    for c in ("a", "b"):
        between = between.join(groups.select(F.col("a").alias(c), F.col("g").alias(f"g{c}")).repartition(n), c, "left").withColumn(f"g{c}", F.coalesce(f"g{c}", c))
    return similar.union(judged(between.where("ga <> gb")).where("similar").select("a", "b"))


def first_of_each(docs: DataFrame, columns: tuple[str, ...], radius: int = NEAR_RADIUS, size: int = NEAR_WORDS, similarity: float = NEAR) -> DataFrame:
    """One row of docs from each group of near copies: that of the smallest doc_id, a null one only
    where there is no other. Fingerprints within the radius give the candidates; those whose texts
    share at least `similarity` of their shingles are linked. Rows are told apart by all of the
    columns, so rows with one doc_id and different texts are judged each by itself, and of equal rows
    one stays. Texts with equal fingerprints are one group."""
    prepare(docs.sparkSession)
    own = docs.select(*columns)
    every = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    keyed = own.withColumn("_r1", F.xxhash64(*every)).withColumn("_r2", F.xxhash64(F.lit("row"), *every))
    rows = fingerprints(keyed, ("_r1", "_r2"), size).checkpoint()
    prints = rows.select("fp").distinct()
    found = components(similar_links(links(prints, radius), rows, keyed, size, similarity))
    of = prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_r1", "_r2")
    best = rows.groupBy("fp").agg(F.min(order).alias("o")).join(of, "fp").groupBy("component").agg(F.min("o").alias("o")).select("o._r1", "o._r2")
    times = rows.groupBy("_r1", "_r2").agg(F.count("*").alias("_times"))
    kept = keyed.join(best.join(times, ["_r1", "_r2"]).hint("shuffle_hash"), ["_r1", "_r2"])
    return kept.where("_times = 1").select(*columns).union(kept.where("_times > 1").dropDuplicates(["_r1", "_r2"]).select(*columns))
