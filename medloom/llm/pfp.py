"""Removal of repeated byte strings by prefix-free parsing, exact for strings of `length` bytes, and
passages of `words` words that several documents share.

A rolling hash of every few symbols triggers the cuts of the parse: each window of `length` symbols
is led by the position of its least hash, so the cuts depend on content only and equal windows are
led alike. The windows with one leader are a phrase of the dictionary: the leader and the symbols
that all of its windows cover (the core), and the phrase with its continuation in the parse (the
context, up to the end of its last window). Symbols are bytes, or words by their hashes; both kinds
of phrases go through the same steps.

1. Phrases whose core occurs once hold no repeat. Cores are counted; a bit map of fixed size tells
   which may be shared, and other phrases never enter a shuffle.
2. The parse: phrases whose whole context occurs again are repeats in all of their windows.
3. The dictionary: what is left are phrases at the rim of repeats, with known cores in new contexts.
   Distinct contexts are cut out of the texts and dealt by core. The suffix array of the contexts of
   some cores is made by prefix doubling; neighbours in it that agree in `length` symbols are repeats.
4. A core with more than CROWD contexts isn't gathered: its windows are counted by their hashes,
   in blocks of BLOCK windows and then one by one. Nothing is dropped there.
5. Texts and what is to go meet by document, and the kept bytes are joined. Texts that lose nothing
   stay where they are read.

Everything that can be hot (a core, a context or a window in very many documents) is counted with
map-side combining and joined, never gathered. Hashes of 128 bits stand for contexts and windows.

A string of bytes repeats if it starts anywhere else, in the same document too. A passage of words
(between ASCII white space) repeats if another document holds it: rows with equal doc_id and text
are one document here.

Edge cases: a null text is an empty text; texts under `length` bytes stay as they are; equal rows,
repeated ones too, are separate documents with equal texts, so each loses what it shares with the
other; overlaps of a string with itself count. A null doc_id is a value like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from medloom.llm.common import arrow_map, bit_map, in_map, prepare
from medloom.runtime import Scratch

LENGTH, WORDS = 400, 51
BYTE, WORD = 0, 1
#: Symbols of a hash and bytes of a symbol, by kind; bits of a place in what is parsed at a time, and
#: its positions (a window of less than 2^12 symbols more fits too).
GRAM, WIDE = (8, 2), (1, 8)
PLACES = 20
PARSED = (1 << PLACES) - (1 << 12)
#: Contexts of a core that are sorted together at most, and bytes of contexts sorted at a time.
CROWD, SORTED = 512, 1 << 19
#: Windows of a crowded core's phrase that are ranked together before they are ranked one by one.
BLOCK = 16
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_words bigint"
PHRASE = "k bigint, e1 bigint, e2 bigint, d bigint, h bigint, lo int, hi int, lead int"


def span(length: int, kind: int = BYTE) -> int:
    """Positions among which a window's least hash is sought: about half of the bytes, more of the words."""
    return max(1, min(length - GRAM[kind] + 1, length * 12 // 25 if kind == BYTE else length * 5 // 8))


def symbols(data: bytes, kind: int) -> bytes:
    """The text as symbols: its bytes, or eight bytes for each word."""
    if kind == BYTE:
        return data
    from xxhash import xxh3_64_intdigest

    out, start = [], 0
    while start < len(data):
        end = start + PARSED
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        out.append(np.fromiter(map(xxh3_64_intdigest, data[start:end].split()), np.uint64).tobytes())
        start = end
    return b"".join(out)


def _triggers(part: bytes, kind: int) -> np.ndarray:
    """The rolling hash at each position: high bits are the hash, low bits the position."""
    if kind == BYTE:
        h = np.ndarray((len(part) - GRAM[BYTE] + 1,), "<u8", part, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    else:
        own = np.frombuffer(part, np.uint64)
        h = (own[:-1] ^ (own[1:] << np.uint64(1)) ^ (own[1:] >> np.uint64(63))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    out = (h >> np.uint64(32)).astype(np.uint32)
    out &= np.uint32((1 << 32) - (1 << PLACES))
    out |= np.arange(len(h), dtype=np.uint32)
    return out


def least_of(h: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours, by doubling."""
    have = 1
    while have * 2 <= wide:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: -(wide - have)], h[wide - have :]) if have < wide else h


def leaders(data: bytes, length: int = LENGTH, kind: int = BYTE):
    """First and last window and leading position of each phrase of the parse of symbols, as arrays."""
    size, wide = WIDE[kind], span(length, kind)
    n = len(data) // size
    found = [[], [], []]
    for base in range(0, n - length + 1, PARSED):
        part = data[base * size : (base + PARSED + length - 1) * size] if n > PARSED else data
        windows = len(part) // size - length + 1
        least = least_of(_triggers(part, kind), wide)[:windows]
        cut = np.flatnonzero(least[1:] != least[:-1])
        lead = (least[np.r_[0, cut + 1]] & np.uint32((1 << PLACES) - 1)).astype(np.int64)
        found[0].append(np.r_[0, cut + 1] + base)
        found[1].append(np.r_[cut, windows - 1] + base)
        found[2].append(lead + base)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, the document's key (d, h) and its text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))


def _wide_hashes(view, ranges, kind: int) -> np.ndarray:
    """128-bit hashes of ranges of symbols, two numbers each."""
    from xxhash import xxh3_128_digest

    u = WIDE[kind]
    return np.frombuffer(b"".join([xxh3_128_digest(view[a * u : z * u], kind) for a, z in ranges]), np.int64).reshape(-1, 2)


def _hashes(view, ranges, kind: int) -> np.ndarray:
    """64-bit hashes of ranges of symbols; the lowest bit is the kind."""
    from xxhash import xxh3_64_intdigest

    u = WIDE[kind]
    return np.array([xxh3_64_intdigest(view[a * u : z * u], kind) for a, z in ranges], np.uint64).view(np.int64) & -2 | kind


def is_words() -> Column:
    return F.col("k").bitwiseAND(F.lit(1)) == WORD


def _cores(named: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """k, the hash of the core of each phrase."""

    def run(batch):
        out = []
        for text in batch.column(0):
            data = text.as_buffer().to_pybytes()
            for kind, length in enumerate(lengths):
                own, core = symbols(data, kind), length - span(length, kind) + 1
                if len(own) >= length * WIDE[kind]:
                    out.append(_hashes(memoryview(own), ((x, x + core) for x in leaders(own, length, kind)[2].tolist()), kind))
        return {"k": pa.array(np.concatenate(out))} if out else None

    return arrow_map(named.select("text"), run, "k bigint")


def _phrases(named: DataFrame, shared, lengths: tuple[int, int]) -> DataFrame:
    """A row for each phrase that may have a shared core: hashes of core and context, its document,
    its first and last window and its leader."""

    def run(batch):
        shown, out = shared.value, [[] for _ in range(7)]
        d, h = (np.asarray(batch.column(i)) for i in (0, 1))
        for i, text in enumerate(batch.column(2)):
            data = text.as_buffer().to_pybytes()
            for kind, length in enumerate(lengths):
                own, core = symbols(data, kind), length - span(length, kind) + 1
                if len(own) < length * WIDE[kind]:
                    continue
                view = memoryview(own)
                lo, hi, lead = leaders(own, length, kind)
                k = _hashes(view, ((x, x + core) for x in lead.tolist()), kind)
                go = np.flatnonzero(in_map(shown, k))
                if len(go):
                    lo, hi, lead, k = lo[go], hi[go], lead[go], k[go]
                    e = _wide_hashes(view, zip(lo.tolist(), (hi + length).tolist()), kind)
                    n = len(go)
                    for mine, x in zip(out, (k, e, np.full(n, d[i]), np.full(n, h[i]), lo, hi, lead)):
                        mine.append(x)
        if not out[0]:
            return None
        k, e, d, h, lo, hi, lead = map(np.concatenate, out)
        return {"k": pa.array(k), "e1": pa.array(e[:, 0]), "e2": pa.array(e[:, 1]), "d": pa.array(d), "h": pa.array(h)} | {c: pa.array(x.astype(np.int32)) for c, x in (("lo", lo), ("hi", hi), ("lead", lead))}

    return arrow_map(named.select("d", "h", "text"), run, PHRASE)


def _again(n: Column, first: Column, last: Column) -> Column:
    """Whether what was counted repeats: bytes anywhere, words in two documents."""
    return F.when(is_words(), first != last).otherwise(n > 1)


def _judged(rows: DataFrame, n: int, ia: Column, ib: Column) -> DataFrame:
    """The rows whose core occurs again: `whole` if the context repeats, `rim` if the core has other
    contexts (of a context that repeats, one row, with the first and last of its documents). A
    context's hash tells its core too."""
    own = F.xxhash64("d", "h", "lo", "lead")
    contexts = rows.groupBy("e1", "e2").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.min(own).alias("one"), F.min(F.when(is_words(), ia)).alias("ia"), F.max(F.when(is_words(), ib)).alias("ib"))
    contexts = contexts.withColumn("whole", _again(F.col("n"), F.col("ia"), F.col("ib"))).drop("n")
    rivals = contexts.groupBy("k").agg(F.count("*").alias("kinds"))
    known = contexts.join(rivals.repartition(n), "k").where("whole or kinds > 1").drop("k").repartition(n)
    rim = (F.col("kinds") > 1) & (~F.col("whole") | (own == F.col("one")))
    return rows.select("k", "e1", "e2", "d", "h", "lo", "hi", "lead").join(known, ["e1", "e2"]).select("k", "d", "h", "lo", "hi", "lead", "ia", "ib", "kinds", "whole", rim.alias("rim"))


def _packed(docs: DataFrame, columns: tuple[str, ...], shown, wanted: bool = True) -> DataFrame:
    """Compressed texts of the documents in (or not in) a bit map, for the way through a shuffle."""

    def run(batch):
        import zstandard

        batch = batch.filter(pa.array(in_map(shown.value, np.asarray(batch.column(columns.index("h")))) == wanted))
        if not batch.num_rows:
            return None
        pack = zstandard.ZstdCompressor(level=3).compress
        return {c: batch.column(i) for i, c in enumerate(columns)} | {"z": pa.array([pack(t.as_buffer().to_pybytes()) for t in batch.column(len(columns))], pa.binary())}

    return arrow_map(docs.select(*columns, "text"), run, ", ".join(f"{c} bigint" for c in columns) + ", z binary")


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix of a string of symbols, up to `length` symbols, by prefix doubling:
    equal ranks are suffixes that neighbour each other in the suffix array and agree so far. Places
    less than `length` before the end have none."""
    if text.dtype == np.uint8 and length >= 8 and len(text) >= 8:
        depth, keys = 8, np.ndarray((len(text) - 7,), ">u8", np.ascontiguousarray(text), strides=(1,)).astype(np.uint64)
    else:
        depth, keys = 1, text
    rank = np.unique(keys, return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        pair = rank[:-step] * np.int64(len(text) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        depth += step
    return rank


def _may_repeat(k, lo, hi, lead, texts: list[bytes], length: int, kind: int) -> np.ndarray:
    """Which contexts have a block of windows whose common part is in another context of the core."""
    size = min(BLOCK, length // 2)
    first, last = (lead - hi) // size, (lead - lo) // size
    counts = last - first + 1
    of = np.repeat(np.arange(len(texts)), counts)
    block = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + first[of]
    start = lead[of] - lo[of] - block * size
    ranges = zip(of.tolist(), start.tolist(), (start - size + 1 + length).tolist())
    from xxhash import xxh3_64_intdigest

    u = WIDE[kind]
    common = np.array([xxh3_64_intdigest(texts[i][max(0, a) * u : z * u]) for i, a, z in ranges], np.uint64)
    common ^= (k[of].view(np.uint64) + block.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(common, return_inverse=True, return_counts=True)
    out = np.zeros(len(texts), bool)
    out[of[times[back] > 1]] = True
    return out


def _sorted_repeats(rows: DataFrame, lengths: tuple[int, int], n: int) -> DataFrame:
    """k, d, h, a, z: ranges of symbols of the contexts' repeats, from the suffix arrays of the
    contexts of whole cores, some at a time."""
    dealt = rows.select("k", "d", "h", "lo", "hi", "ia", "ib", "context", "lead").repartition(n, "k").sortWithinPartitions("k")

    def ranges(batch):
        k, d, h, lo, hi, ia, ib, lead = (np.asarray(batch.column(i).fill_null(0)) for i in (0, 1, 2, 3, 4, 5, 6, 8))
        found: list[list] = [[], [], [], [], []]
        for kind, length in enumerate(lengths):
            own, u = np.flatnonzero(k & 1 == kind), WIDE[kind]
            if not len(own):
                continue
            texts = [batch.column(7)[int(i)].as_buffer().to_pybytes() for i in own]
            # a window can only repeat if what its block of windows has in common does
            go = _may_repeat(k[own], lo[own], hi[own], lead[own], texts, length, kind)
            if not go.any():
                continue
            own, texts = own[go], [t for t, g in zip(texts, go.tolist()) if g]
            starts = np.cumsum([0, *(len(t) // u for t in texts)])[:-1]
            sizes = (hi[own] - lo[own] + 1).astype(np.int64)
            of = np.repeat(np.arange(len(own)), sizes)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rank = suffix_ranks(np.frombuffer(b"".join(texts), np.uint64 if kind == WORD else np.uint8), length)[starts[of] + offset]
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0])
            if kind == WORD:
                again = np.minimum.reduceat(ia[own][of][order], cuts) != np.maximum.reduceat(ib[own][of][order], cuts)
            else:
                again = np.diff(np.r_[cuts, len(order)]) > 1
            repeated = np.zeros(len(order), bool)
            repeated[order] = np.repeat(again, np.diff(np.r_[cuts, len(order)]))
            # neighbouring windows of one context are one range
            at = np.flatnonzero(repeated)
            if len(at):
                new = np.r_[True, (np.diff(at) > 1) | (np.diff(of[at]) > 0)]
                first, last = at[new], at[np.r_[new[1:], True]]
                i = own[of[first]]
                for mine, x in zip(found, (k[i], d[i], h[i], lo[i] + offset[first], lo[i] + offset[last] + length)):
                    mine.append(x)
        if not found[0]:
            return None
        return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(x).astype(np.int32 if c in "az" else np.int64)) for c, x in zip("kdhaz", found)})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(7).nbytes
            if size < SORTED:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            k = np.asarray(whole.column(0))
            done = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
            if done:
                out = ranges(whole.slice(0, done))
                if out is not None:
                    yield out
            held = [whole.slice(done)]
            size = sum(len(x.as_buffer()) for x in held[0].column(7))
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            out = ranges(whole[0]) if whole else None
            if out is not None:
                yield out

    return dealt.mapInArrow(run, "k bigint, d bigint, h bigint, a int, z int")


def _crowded_repeats(rows: DataFrame, lengths: tuple[int, int], n: int, scratch: Scratch) -> DataFrame:
    """k, d, h, a, z of the repeats in contexts of crowded cores, counted by hashes."""

    def blocks(batch):
        out = [[] for _ in range(10)]
        for k, d, h, lo, hi, lead, ia, ib, data in zip(*(batch.column(i).to_pylist() for i in range(9))):
            length, size = lengths[k & 1], min(BLOCK, lengths[k & 1] // 2)
            # windows by their distance to the leader, in blocks of BLOCK
            ends = [(max(lo, lead - j * size - size + 1), min(hi, lead - j * size), lead - j * size) for j in range((lead - hi) // size, (lead - lo) // size + 1)]
            view = memoryview(data)
            own = _hashes(view, ((t - lo, t - size + 1 - lo + length) for _, _, t in ends), k & 1)
            e = _wide_hashes(view, ((a - lo, z - lo + length) for a, z, _ in ends), k & 1)
            m = len(ends)
            for mine, x in zip(out, (own, e[:, 0], e[:, 1], [d] * m, [h] * m, [a for a, _, _ in ends], [z for _, z, _ in ends], [lo] * m, [ia or 0] * m, [ib or 0] * m)):
                mine.extend(x)
        names = ("k", "e1", "e2", "d", "h", "lo", "hi", "lead", "ia", "ib")
        return {c: pa.array(np.array(x, np.int32 if c in ("lo", "hi", "lead") else np.int64)) for c, x in zip(names, out)}

    columns = ("k", "d", "h", "lo", "hi", "lead", "ia", "ib", "context")
    pieces = scratch.keep(arrow_map(rows.select(*columns), blocks, PHRASE + ", ia bigint, ib bigint"))
    parts = scratch.keep(_judged(pieces, n, F.col("ia"), F.col("ib")))
    block = F.struct(F.col("lo").alias("a"), F.col("hi").alias("z"), F.coalesce("ia", F.lit(0)).alias("ia"), F.coalesce("ib", F.lit(0)).alias("ib"))
    last = parts.where("rim").groupBy("d", "h", F.col("lead").alias("lo"), F.col("k").bitwiseAND(F.lit(1)).alias("kind")).agg(F.collect_set(block).alias("blocks"))

    def windows(batch):
        out: list[list] = [[] for _ in range(7)]
        for kind, d, h, lo, data, own in zip(*(batch.column(i).to_pylist() for i in range(6))):
            places = np.concatenate([np.arange(b["a"], b["z"] + 1) for b in own])
            sizes, m = [b["z"] - b["a"] + 1 for b in own], len(places)
            digests = _wide_hashes(memoryview(data), ((p - lo, p - lo + lengths[kind]) for p in places.tolist()), kind)
            first, final = (np.repeat(np.array([b[c] for b in own], np.int64), sizes) for c in ("ia", "ib"))
            for mine, x in zip(out, (digests, np.full(m, kind), np.full(m, d), np.full(m, h), places, first, final)):
                mine.append(x)
        both, *rest = map(np.concatenate, out)
        names = ("k", "d", "h", "p", "ia", "ib")
        return {"w1": pa.array(both[:, 0]), "w2": pa.array(both[:, 1])} | {c: pa.array(x.astype(np.int32 if c == "p" else np.int64)) for c, x in zip(names, rest)}

    each = rows.select(F.col("k").bitwiseAND(F.lit(1)).alias("kind"), "d", "h", "lo", "context").join(last.hint("shuffle_hash"), ["kind", "d", "h", "lo"])
    ranked = scratch.keep(arrow_map(each, windows, "w1 bigint, w2 bigint, k bigint, d bigint, h bigint, p int, ia bigint, ib bigint"))
    counted = ranked.groupBy("w1", "w2", "k").agg(F.count("*").alias("n"), F.min("ia").alias("ia"), F.max("ib").alias("ib"))
    again = counted.where(_again(F.col("n"), F.col("ia"), F.col("ib"))).select("w1", "w2").repartition(n)
    width = F.when(is_words(), lengths[WORD]).otherwise(lengths[BYTE])
    single = ranked.join(again, ["w1", "w2"]).select("k", "d", "h", F.col("p").alias("a"), (F.col("p") + width).alias("z"))
    return single.union(parts.where("whole").select("k", "d", "h", F.col("lo").alias("a"), (F.col("hi") + width).alias("z")))


def repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """kind, d, h, a, z: ranges of bytes (kind 0) and of words (kind 1) that repeated strings cover,
    several a document, as a checkpoint."""
    prepare(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        found = _repeats(docs, (length, words), crowd, scratch)
        return found.select(F.col("k").bitwiseAND(F.lit(1)).cast("int").alias("kind"), "d", "h", "a", "z").checkpoint()


def _repeats(docs: DataFrame, lengths: tuple[int, int], crowd: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = _named(docs)
    counts = _cores(named, lengths).groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    shared = spark.sparkContext.broadcast(bit_map(counts, "k"))
    document = F.xxhash64("d", "h")
    phrases = scratch.keep(_judged(scratch.keep(_phrases(named, shared, lengths)), n, document, document))
    scratch.drop(1)
    rims = phrases.where("rim")
    width = F.when(is_words(), lengths[WORD]).otherwise(lengths[BYTE])

    def cut_out(batch):
        rows = []
        for d, h, z, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
            data = _unpack(z)
            texts = {kind: symbols(data, kind) for kind in {r["k"] & 1 for r in own}}
            for r in own:
                kind = r["k"] & 1
                u = WIDE[kind]
                rows.append((r["k"], d, h, r["lo"], r["hi"], r["lead"], r["ia"], r["ib"], r["kinds"], texts[kind][r["lo"] * u : (r["hi"] + lengths[kind]) * u]))
        names = ("k", "d", "h", "lo", "hi", "lead", "ia", "ib", "kinds", "context")
        types = {"context": pa.binary()} | dict.fromkeys(("lo", "hi", "lead"), pa.int32())
        return {c: pa.array(x, types.get(c, pa.int64())) for c, x in zip(names, zip(*rows))}

    by_document = rims.groupBy("d", "h").agg(F.collect_set(F.struct("k", "lo", "hi", "lead", "ia", "ib", "kinds")).alias("rims"))
    some = _packed(named, ("d", "h"), spark.sparkContext.broadcast(bit_map(rims, "h")))
    texts = some.join(by_document.hint("shuffle_hash"), ["d", "h"]).select("d", "h", "z", "rims")
    context = scratch.keep(arrow_map(texts, cut_out, "k bigint, d bigint, h bigint, lo int, hi int, lead int, ia bigint, ib bigint, kinds bigint, context binary"))
    whole = phrases.where("whole").select("k", "d", "h", F.col("lo").alias("a"), (F.col("hi") + width).alias("z"))
    return whole.union(_sorted_repeats(context.where(F.col("kinds") <= crowd), lengths, n)).union(_crowded_repeats(context.where(F.col("kinds") > crowd), lengths, n, scratch))


def _runs(a: np.ndarray, z: np.ndarray):
    """First and last places of the maximal runs that ranges cover; those that touch are one run."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(z[order])
    new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return a[new], reach[np.r_[new[1:] - 1, len(a) - 1]]


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, crowd: int = CROWD, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the number of passages of at least
    `words` words that other documents hold with the words they cover, of each row; the kept bytes
    themselves as `kept` if keep_bytes."""
    prepare(docs.sparkSession)
    named = _named(docs)
    found = repeats(docs, length, words, crowd)
    gone = found.groupBy("d", "h").agg(F.collect_set(F.struct("kind", "a", "z")).alias("gone"))
    shown = docs.sparkSession.sparkContext.broadcast(bit_map(found, "h"))
    hit = _packed(named, ("doc_id", "d", "h"), shown).join(gone.hint("shuffle_hash"), ["d", "h"], "left").select("doc_id", "z", "gone")
    schema = SCHEMA + ", kept binary" * keep_bytes

    def shown_row(size, data, spans, passages, covered):
        return (size, size - len(data), spans, hashlib.sha256(data).hexdigest(), passages, covered, *([data] if keep_bytes else []))

    def columns(ids, rows):
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", "kept")
        return {"doc_id": ids} | {c: pa.array(x, pa.binary() if c == "kept" else pa.string() if c == "kept_sha256" else pa.int64()) for c, x in zip(names, zip(*rows))}

    def untouched(batch):
        batch = batch.filter(pa.array(~in_map(shown.value, np.asarray(batch.column(1)))))
        rows = [shown_row(len(data), data, 0, 0, 0) for t in batch.column(2) for data in [t.as_buffer().to_pybytes()]]
        return columns(batch.column(0), rows) if rows else None

    def run(batch):
        rows, gone = [], batch.column(2)
        at = np.asarray(gone.offsets)
        kind, first, last = (np.asarray(gone.values.field(i)) for i in range(3))
        for i, packed in enumerate(batch.column(1).to_pylist()):
            data = _unpack(packed)
            size = len(data)
            own, a, z = (x[at[i] : at[i + 1]] for x in (kind, first, last))
            spans = passages = covered = 0
            if (own == BYTE).any():
                starts, ends = _runs(a[own == BYTE], z[own == BYTE])
                spans, view = len(starts), memoryview(data)
                data = b"".join(view[x:y] for x, y in zip([0, *ends.tolist()], [*starts.tolist(), size]))
            if (own == WORD).any():
                starts, ends = _runs(a[own == WORD], z[own == WORD])
                passages, covered = len(starts), int((ends - starts).sum())
            rows.append(shown_row(size, data, spans, passages, covered))
        return columns(batch.column(0), rows)

    return arrow_map(hit, run, schema).union(arrow_map(named.select("doc_id", "h", "text"), untouched, schema))
