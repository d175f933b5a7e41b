"""Benchmark decontamination by latent semantic retrieval.

Terms are words, hashed to at most FEATURES features. Document frequencies are counted over all
documents. A distributed randomised SVD of TF-IDF passages gives a latent space: a random sketch of
the terms is carried through the passages and back, and its own product with that (Nystrom's
approximation, in one pass) tells the leading directions. It is fitted once, on all passages of all documents and items:
passages of 2 x HALF words, each starting HALF words after the one before. So sums over blocks of
HALF words serve two passages each, and every word is in one at least.

Each passage of each document is then searched: windows of a few widths that can hold an item are
projected, and items with a cosine of at least `cosine` are candidates. Item vectors lie in cells of
near ones; a window is compared with the items of the PROBES cells nearest to it. A candidate is a
leak if the longest common subsequence of words takes in at least `sure` of the item, or at least
`likely` of it while the item's answer (the column `answer`, else its heaviest words) is there too,
as in a paraphrase.

A window can hold an item only if enough of the item's rare words are in it: where at most
1 - `likely` of the words may be missing, of any K different ones all but so many are there. Windows
without that are left out before the projection, which loses nothing.

The benchmark goes to the executors in blocks of at most BLOCK_ITEMS items, whatever its size; the
documents are read once for each block and never shuffled. No term weighs nothing, so items of
common words are searched like others.

Items of fewer than SHORTEST words are looked for word by word, with their answer if they have one;
of fewer than LEAST words and without an answer, they must be a whole line. Chinese, Japanese, Thai,
Lao, Khmer and Burmese are split into characters, as they have no spaces.

Edge cases: null or empty texts and items match nothing; repeated rows give one result each document
and item in `find`, and are all kept or all dropped by `clean`, where each row is judged by its own
text, whatever its doc_id; two items with equal texts are both reported; empty tables give no leaks;
other columns are ignored.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from medloom.llm.common import arrow_map, prepare, totals

WIDTHS = (8, 12, 16, 24, 32, 48, 64)
SHORTEST, LEAST = 8, 3
DIMENSIONS, EXTRA = 128, 16
FEATURES = 1 << 16
BLOCK_ITEMS = 20_000
#: Items of one cell on average, and the cells that are searched.
CELL, PROBES = 256, 8
#: Words of a text that are searched at a time, and windows projected at a time.
STRETCH, PROJECTED = 100_000, 256
#: Words of a block, half a passage, and blocks and words whose vectors are gathered at a time.
HALF, GATHERED = 16, 4096
#: Bytes whose words are hashed at a time.
HASHED = 1 << 18
#: Share of the documents from which a term weighs little; least share of an item's weight that a
#: window needs, and its least cosine.
COMMON, GATE, COSINE = 0.1, 0.5, 0.4
SURE, LIKELY, ANSWER_SHARE, ANSWER_WORDS = 0.8, 0.6, 0.8, 5

_WHITE = re.compile(rb"\s")
_IS_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Of XXH3: parts of its secret, by length of the word, and its factors.
_SECRET = np.array([0x87275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A], np.uint64)
_PRIMES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25, 0x165667919E3779F9], np.uint64)
_TABLE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Scripts without spaces between words.
_UNSPACED = re.compile("([฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff])")
SCHEMA = "doc_id bigint, item_id bigint, cosine double, common_share double, answer_share double"


def spaced(text: str) -> bytes:
    """The text's words with white space between them."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", text)
    return text.lower().encode().translate(_TABLE).strip()


def words_of(text: str) -> list[bytes]:
    return spaced(text).split()


def hashed(texts) -> tuple[np.ndarray, np.ndarray]:
    """The XXH3 hash of each word of each text, and the number of words of each text. The joined texts
    are gone through in pieces of some HASHED bytes that end between words."""
    own = [spaced(t) if t else b"" for t in texts]
    data, found, starts = b" ".join(own), [], []
    a = 0
    while a < len(data):
        cut = _WHITE.search(data, a + HASHED)
        b = cut.start() if cut else len(data)
        piece, places = _hashed(data[a:b])
        found.append(piece)
        starts.append(places + a)
        a = b
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(own), np.int64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 of the words between white space, by its rules for up to 3, 8 and 16 bytes on all words of
    such a length at once, and their starts; longer ones are left to the library."""
    from xxhash import xxh3_64_intdigest

    padded = b" " * 8 + data + b" " * 8
    text = np.frombuffer(padded, np.uint8)
    eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    white = _IS_WHITE[text]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    size = end - start
    out = np.empty(len(start), np.uint64)
    at = np.flatnonzero(size <= 3)
    if len(at):
        a, n = start[at], size[at]
        first, middle, last = (text[x].astype(np.uint64) for x in (a, a + (n >> 1), a + n - 1))
        h = (first << 16 | middle << 24 | last | n.astype(np.uint64) << 8) ^ _SECRET[0]
        h = (h ^ h >> 33) * _PRIMES[0]
        h = (h ^ h >> 29) * _PRIMES[1]
        out[at] = h ^ h >> 32
    at = np.flatnonzero((size > 3) & (size <= 8))
    if len(at):
        h = ((eight[end[at] - 8] >> 32) + (eight[start[at]] << 32)) ^ _SECRET[1]
        h = (h ^ (h << 49 | h >> 15) ^ (h << 24 | h >> 40)) * _PRIMES[2]
        h = (h ^ (h >> 35) + size[at].astype(np.uint64)) * _PRIMES[2]
        out[at] = h ^ h >> 28
    at = np.flatnonzero((size > 8) & (size <= 16))
    if len(at):
        a, b = eight[start[at]] ^ _SECRET[2], eight[end[at] - 8] ^ _SECRET[3]
        h = size[at].astype(np.uint64) + a.byteswap() + b + _folded(a, b)
        h = (h ^ h >> 37) * _PRIMES[3]
        out[at] = h ^ h >> 32
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxh3_64_intdigest(padded[start[k] : end[k]])
    return out, start - 8


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The halves of the 128-bit products, one xor the other."""
    low = np.uint64(0xFFFFFFFF)
    x, y = a & low, b & low
    p, q = x * y, (a >> 32) * y
    cross = (p >> 32) + (q & low) + x * (b >> 32)
    return (q >> 32) + (cross >> 32) + (a >> 32) * (b >> 32) ^ (cross << 32 | p & low)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return _hashed(b" ".join(words))[0]


def features_of(words: list[bytes], size: int) -> np.ndarray:
    """The feature of each word."""
    return hashes_of(words).astype(np.int64) & (size - 1)


def places_of(item: list) -> dict:
    """The item's positions of each word, as bits of a number."""
    out: dict = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common(places: dict, size: int, region: list) -> int:
    """Length of the longest common subsequence of an item of that size and a region."""
    full = s = (1 << size) - 1
    for m in filter(None, map(places.get, region)):
        u = s & m
        s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


class Space:
    """Weights and latent vectors of the features; the last row is that of an unknown word."""

    def __init__(self, size: int, known: np.ndarray):
        self.size, self.known, self.terms = size, known, int(known.sum())
        self.term = np.where(known, np.cumsum(known) - 1, self.terms).astype(np.int32)
        self.weight = np.zeros(self.terms + 1, np.float32)
        self.idf = np.zeros(size + 1, np.float32)
        self.vectors = np.zeros((size + 1, 1), np.float32)

    def weigh(self, frequency: np.ndarray, documents: int) -> None:
        self.idf[: self.size] = np.where(self.known, np.log(1 + COMMON * (documents + 1) / (np.minimum(frequency, documents) + 1)), 0)
        self.weight[:-1] = self.idf[: self.size][self.known]

    def passages(self, texts):
        """Terms (places among the known features) of the texts' words in blocks of HALF, a row each,
        and the blocks that the next one of the same text follows: each is the first half of a
        passage. Some STRETCH words come at a time, long texts in stretches that share a block."""
        hashes, sizes = hashed(texts)
        terms, sizes = self.term[hashes & np.uint64(self.size - 1)], sizes[sizes > 0]
        held, size = [], 0
        for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            for a in range(end - n, max(end - n + 1, end - HALF), STRETCH):
                held.append(terms[a : min(end, a + STRETCH + HALF)])
                size += len(held[-1])
                if size >= STRETCH:
                    yield self._blocks(held)
                    held, size = [], 0
        if held:
            yield self._blocks(held)

    def _blocks(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        blocks = np.maximum(2, -(-sizes // HALF))
        first = np.cumsum(blocks) - blocks
        out = np.full(int(blocks.sum()) * HALF, self.terms, np.int32)
        out[np.arange(int(sizes.sum())) + np.repeat(first * HALF - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(pieces)
        follows = np.ones(int(blocks.sum()), bool)
        follows[first + blocks - 1] = False
        return out.reshape(-1, HALF), np.flatnonzero(follows)

    def weighted(self, basis: np.ndarray) -> np.ndarray:
        """A basis of the terms times their weights, with a row of zeros for what is unknown."""
        return np.vstack([basis * self.weight[:-1, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)

    def carried(self, rows: np.ndarray, first: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages, as TF-IDF rows scaled by the root of their weight, times a weighted basis,
        and their scales."""
        step = GATHERED // HALF
        sums = np.concatenate([weighted.take(rows[a : a + step], axis=0).sum(1) for a in range(0, len(rows), step)])
        mass = self.weight[rows].sum(1)
        mass = mass[first] + mass[first + 1]
        scale = np.where(mass > 0, 1 / np.sqrt(np.where(mass > 0, mass, 1)), 0).astype(np.float32)
        return (sums[first] + sums[first + 1]) * scale[:, None], scale

    def back(self, rows: np.ndarray, first: np.ndarray, values: np.ndarray, scale: np.ndarray, out: np.ndarray) -> None:
        """Adds the transposed product, what the passages' values give for each term, but for its weight."""
        of_block = np.zeros((len(rows), values.shape[1]), np.float32)
        own = values * scale[:, None]
        of_block[first] += own
        of_block[first + 1] += own
        terms = rows.ravel()
        order = np.argsort(terms.astype(np.uint16) if self.terms < 1 << 16 else terms, kind="stable")
        order = order[: np.searchsorted(terms[order], self.terms)]
        for a in range(0, len(order), GATHERED):
            at = order[a : a + GATHERED]
            part = terms[at]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out[part[starts]] += np.add.reduceat(of_block.take(at // HALF, axis=0), starts, axis=0)

    def start(self, width: int, seed: int) -> np.ndarray:
        """The random sketch, of orthonormal columns, the same wherever it is made; of so few terms, each."""
        if self.terms <= width:
            return np.eye(self.terms)
        return np.linalg.qr(np.random.default_rng(seed).standard_normal((self.terms, width)))[0]


class Cells:
    """Unit vectors of items in cells of near ones, with their owners and weights."""

    def __init__(self, owners: np.ndarray, vectors: np.ndarray, masses: np.ndarray):
        n = len(vectors)
        centers = vectors[np.random.default_rng(5).permutation(n)[: -(-n // CELL)]]
        for _ in range(4 if len(centers) > 1 else 0):
            of = (vectors @ centers.T).argmax(1)
            sums = np.zeros_like(centers)
            np.add.at(sums, of, vectors)
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-6)[:, None]
        of = (vectors @ centers.T).argmax(1)
        self.centers = centers
        self.members = [(owners[m], np.ascontiguousarray(vectors[m].T), masses[m]) for c in range(len(centers)) for m in [np.flatnonzero(of == c)]]
        self.lightest = float(masses.min())

    def near(self, own: np.ndarray, mass: np.ndarray, cosine: float):
        """Window, item and cosine of each pair of at least that cosine in the cells probed."""
        if len(self.centers) <= PROBES:
            probes = [(c, np.arange(len(own))) for c in range(len(self.centers))]
        else:
            best = np.argpartition(-(own @ self.centers.T), PROBES, axis=1)[:, :PROBES]
            order = np.argsort(best.ravel(), kind="stable")
            cells, first = np.unique(best.ravel()[order], return_index=True)
            probes = [(int(c), rows // PROBES) for c, rows in zip(cells, np.split(order, first[1:]))]
        for c, rows in probes:
            owners, vectors, masses = self.members[c]
            close = own[rows] @ vectors
            for r, k in zip(*np.nonzero((close >= cosine) & (mass[rows][:, None] >= GATE * masses))):
                yield int(rows[r]), int(owners[k]), float(close[r, k])


class Index:
    """Items of one block with their latent vectors."""

    def __init__(self, items: list[tuple[int, str, str | None]], space: Space, cosine: float, sure: float, likely: float):
        every = [(i, w, words_of(a) if a else None) for i, t, a in items if (w := words_of(t or ""))]
        self.items = [x for x in every if len(x[1]) >= SHORTEST]
        self.short: dict[int, dict[tuple, list]] = {}
        for i, own, answer in every:
            if len(own) < SHORTEST:
                self.short.setdefault(len(own), {}).setdefault(tuple(own), []).append((i, answer))
        self.space, self.cosine, self.sure, self.likely = space, cosine, sure, likely
        # words are numbered in the order in which they come, by their hashes: words of equal hash, if
        # ever, have one number, which leaves nothing out
        vocabulary = hashes_of(list(dict.fromkeys(w for _, own, _ in self.items for w in own)))
        self.n = len(vocabulary)
        self.feature = np.r_[(vocabulary & np.uint64(space.size - 1)).astype(np.int64), space.size]
        self.number = np.argsort(vocabulary, kind="stable").astype(np.int32)
        self.hashes = vocabulary[self.number]
        self.longest = max((len(w) for _, w, _ in self.items), default=0)
        self.first_words = frozenset(own[0] for of in self.short.values() for own in of)
        self.first_hashes = hashes_of(list(self.first_words))
        self._places: dict[int, dict] = {}
        self._project()

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word of each hash, n if no item has it."""
        if not self.n:
            return np.zeros(len(hashes), np.int32)
        place = np.searchsorted(self.hashes, hashes)
        place[place == self.n] = 0
        return np.where(self.hashes[place] == hashes, self.number[place], np.int32(self.n))

    def _project(self) -> None:
        """Set the items' vectors, widths and weights, and which rare words of theirs must be there."""
        by_width: dict[int, list] = {}
        weight = self.space.idf[self.feature]
        size, self.answers, postings = len(self.items), [], []
        self.width, self.need, self.reach = (np.zeros(size, np.int64) for _ in range(3))
        for k, (_, own, answer) in enumerate(self.items):
            ids = self.ids(hashes_of(own))
            rare = sorted(dict.fromkeys(ids.tolist()), key=lambda t: (-float(weight[t]), t))
            words = dict(zip(ids.tolist(), own))
            self.answers.append(answer or [words[t] for t in rare[:ANSWER_WORDS]])
            self.width[k] = width = next((w for w in WIDTHS if w >= len(own)), WIDTHS[-1])
            self.reach[k] = max(width // 4, len(own) // 4, len(own) - width)
            missing = int(len(own) * (1 - self.likely) + 1e-9)
            rare = rare[: missing + -(-len(own) // 4)]
            # an item of few different words may miss them all: each of its words is enough then
            self.need[k] = max(1, len(rare) - missing)
            postings += [(t, k) for t in rare]
            # items longer than the widest window are looked for by each of their windows
            for a in range(0, max(1, len(own) - width + 1), width // 2):
                rows = self.feature[ids[a : a + width]]
                vector = (self.space.vectors[rows] * self.space.idf[rows][:, None]).sum(0)
                norm = float(np.linalg.norm(vector))
                if norm > 0:
                    by_width.setdefault(width, []).append((k, vector / norm, float(self.space.idf[rows].sum())))
        self.cells = {w: Cells(np.array([k for k, _, _ in own]), np.array([v for _, v, _ in own], np.float32), np.array([m for _, _, m in own], np.float32)) for w, own in by_width.items()}
        postings.sort()
        self.posted = np.array([k for _, k in postings], np.int64)
        self.first_post = np.searchsorted(np.array([t for t, _ in postings], np.int64), np.arange(self.n + 2))
        self.posts = np.diff(self.first_post)
        self.within = self.width + 2 * self.reach

    def places(self, k: int) -> dict:
        if k not in self._places:
            self._places[k] = places_of(self.items[k][1])
        return self._places[k]

    def leaks(self, texts: list):
        """The text's place, item id, cosine, common share and answer share of each item that leaks
        into one of the texts."""
        hashes, sizes = hashed(texts)
        ends = np.cumsum(sizes)
        for k, own in self._long(texts, hashes, ends.tolist(), sizes.tolist()) if self.items else ():
            for i, found in sorted(own.items()):
                yield k, self.items[i][0], *found
        if self.short:
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(hashes, self.first_hashes)), "right")).tolist():
                for found in self._short(texts[k], words_of(texts[k])):
                    yield k, *found

    def _long(self, texts: list, hashes: np.ndarray, ends: list[int], sizes: list[int]):
        """The best find of each item that leaks into a text, for each text with such items."""
        at, words, best = -1, [], {}
        for k, start, ids, found in self._candidates(hashes, ends, sizes):
            if k != at:
                if best:
                    yield at, best
                at, words, best = k, words_of(texts[k]), {}
            for i, *own in self._stretch(words[start : start + len(ids)], ids, found):
                if i not in best or best[i][1] < own[1]:
                    best[i] = own
        if best:
            yield at, best

    def _candidates(self, hashes: np.ndarray, ends: list[int], sizes: list[int]):
        """Text, start, word numbers and windows of each stretch of a text that may hold an item.
        Stretches overlap by more than a window with its surroundings; short texts are looked
        through together."""
        held, total = [], 0
        for k, (end, n) in enumerate(zip(ends, sizes)):
            for start in range(0, n, STRETCH):
                size = min(n - start, STRETCH + 4 * max(WIDTHS) + 2 * self.longest)
                held.append((k, start, end - n + start, size))
                total += size
                if total >= STRETCH:
                    yield from self._together(hashes, held)
                    held, total = [], 0
        yield from self._together(hashes, held)

    def _together(self, hashes: np.ndarray, held: list[tuple]):
        sizes = np.array([x[3] for x in held], np.int64)
        if not sizes.sum():
            return
        ids = self.ids(np.concatenate([hashes[a : a + n] for _, _, a, n in held]))
        ends = np.cumsum(sizes)
        for j, found in self.windows(ids, sizes):
            yield held[j][0], held[j][1], ids[ends[j] - sizes[j] : ends[j]], found

    def _short(self, text: str, words: list[bytes]):
        there, lines = None, None
        for size, of in self.short.items():
            for own in {tuple(words[i : i + size]) for i, w in enumerate(words) if w in self.first_words} & of.keys():
                for item, answer in of[own]:
                    if answer:
                        there = there or set(words)
                        share = sum(w in there for w in answer) / len(answer)
                        if share >= ANSWER_SHARE:
                            yield item, 1.0, 1.0, share
                    else:
                        if size < LEAST and lines is None:
                            lines = {tuple(words_of(x)) for x in text.split("\n")}
                        if size >= LEAST or own in lines:
                            yield item, 1.0, 1.0, 1.0

    def windows(self, ids: np.ndarray, sizes: np.ndarray):
        """Starts of the windows of each width that can hold an item, in each stretch of so many words
        that has any."""
        at = np.flatnonzero(self.posts[ids])
        if not len(at):
            return
        # stretches lie further apart than the words of one window
        apart = np.cumsum(sizes) - sizes + np.arange(len(sizes)) * (int(self.within.max()) + 1)
        bits = int(apart[-1] + sizes[-1]).bit_length()
        own = ids[at]
        counts = self.posts[own]
        place = (np.arange(len(ids)) + np.repeat(apart - (np.cumsum(sizes) - sizes), sizes))[at]
        post = np.arange(int(counts.sum())) + np.repeat(self.first_post[own] - (np.cumsum(counts) - counts), counts)
        key = np.sort(self.posted[post] << bits | np.repeat(place, counts))
        item, place = key >> bits, key & (1 << bits) - 1
        end = np.arange(len(key)) + self.need[item] - 1
        end[end >= len(key)] = 0
        go = np.flatnonzero((item[end] == item) & (place[end] >= place) & (place[end] - place <= self.within[item]))
        if not len(go):
            return
        of = np.searchsorted(apart, place[go], "right") - 1
        middle, width = (place[go] + place[end[go]]) // 2 - apart[of], self.width[item[go]]
        out: dict[int, dict] = {}
        for w in np.unique(width).tolist():
            stride = max(1, w // 4)
            base = np.maximum(0, middle[width == w] - w // 2) // stride
            both = of[width == w] << bits | base
            both = np.unique(np.concatenate([both, both + 1]))
            own, starts = both >> bits, (both & (1 << bits) - 1) * stride
            inside = starts < sizes[own]
            own, starts = own[inside], starts[inside]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for j, part in zip(own[first].tolist(), np.split(starts, first[1:])):
                out.setdefault(j, {})[w] = part
        yield from sorted(out.items())

    def _stretch(self, words: list[bytes], ids: np.ndarray, found: dict[int, np.ndarray]):
        best: dict[int, tuple] = {}
        rows = np.concatenate([self.feature[ids], np.full(max(WIDTHS), self.space.size)])
        weight = self.space.idf[rows]
        for width, starts in found.items():
            stride = max(1, width // 4)
            for part in np.split(starts, range(PROJECTED, len(starts), PROJECTED)):
                at = part[:, None] + np.arange(width)
                own = np.einsum("sw,swd->sd", weight[at], self.space.vectors.take(rows[at], axis=0))
                own /= np.maximum(np.linalg.norm(own, axis=1), 1e-6)[:, None]
                for r, k, close in self.cells[width].near(own, weight[at].sum(1), self.cosine):
                    s, size = int(part[r]), len(self.items[k][1])
                    reach = max(stride, size // 4, size - width)
                    region = words[max(0, s - reach) : s + width + reach]
                    share = common(self.places(k), size, region) / size
                    if share < self.likely or k in best and best[k][1] >= share:
                        continue
                    there = set(region)
                    answer = sum(w in there for w in self.answers[k]) / len(self.answers[k])
                    if share >= self.sure or answer >= ANSWER_SHARE:
                        best[k] = (close, share, answer)
        for k, own in sorted(best.items()):
            yield k, *own


def _frequencies(docs: DataFrame, space: Space) -> tuple[np.ndarray, int]:
    """In how many documents each known feature is, over all documents, and their number. At most
    FEATURES rows reach the driver."""
    size, known = space.size, space.known

    def count(batch):
        hashes, sizes = hashed(batch.column(0).to_pylist())
        at = np.flatnonzero(known[hashes & np.uint64(size - 1)])
        # the low bits of a word's hash, with its feature, above its row: each once
        bits = batch.num_rows.bit_length()
        own = np.sort(hashes[at] << bits | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)[at])
        own = own[np.flatnonzero(np.r_[True, own[1:] != own[:-1]])] if len(own) else own
        sums = np.bincount((own >> bits & np.uint64(size - 1)).astype(np.int64), minlength=size)
        there = np.flatnonzero(sums)
        return {"term": pa.array(np.r_[there, size]), "n": pa.array(np.r_[sums[there], batch.num_rows])}

    found = arrow_map(docs.select("text"), count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()
    out = np.zeros(size + 1)
    for r in found:
        out[r["term"]] = r["n"]
    return out[:size], int(out[size])


def directions(found: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Leading directions, the strongest first, of a matrix of which the product with orthonormal
    columns is known: those of Nystrom's approximation, with a shift against rounding."""
    shift = 1e-7 * max(float(np.linalg.norm(found)), 1e-30)
    shifted = found + shift * start
    inner = start.T @ shifted
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, shift))
    return np.linalg.svd(shifted @ root, full_matrices=False)[0]


def fit(docs: DataFrame, items: DataFrame, seed: int = 11) -> Space:
    """Weigh the terms over all documents and find the latent space of all passages, of documents and
    items, once for all items."""
    spark = docs.sparkSession
    n_items = items.count()
    words = 0 if n_items > BLOCK_ITEMS else len({w for r in items.select("text").toLocalIterator() for w in words_of(r["text"])})
    size = FEATURES if n_items > BLOCK_ITEMS else min(FEATURES, 1 << max(8, (4 * words).bit_length()))

    def features(batch):
        found = {w for t in batch.column(0).to_pylist() for w in words_of(t)}
        return {"term": pa.array(np.unique(features_of(list(found), size)))} if found else None

    known = np.zeros(size, bool)
    for r in arrow_map(items.select("text"), features, "term bigint").distinct().toLocalIterator():
        known[r["term"]] = True
    space = Space(size, known)
    space.weigh(*_frequencies(docs, space))
    if not space.terms:
        return space
    width = min(DIMENSIONS + EXTRA, space.terms)
    texts = docs.select("text").union(items.select("text")).where("text is not null")
    shared = spark.sparkContext.broadcast(space)
    start = space.start(width, seed)
    carrier = spark.sparkContext.broadcast(space.weighted(start))

    def sketch(batch, out):
        for rows, first in shared.value.passages(batch.column(0).to_pylist()):
            shared.value.back(rows, first, *shared.value.carried(rows, first, carrier.value), out[0].reshape(-1, width))

    found = totals(texts, sketch, space.terms * width, np.float64)[0].reshape(-1, width) * space.weight[:-1, None]
    leading = directions(found, start)[:, :DIMENSIONS]
    space.vectors = np.zeros((size + 1, leading.shape[1]), np.float32)
    space.vectors[:size][known] = leading
    shared.unpersist()
    carrier.unpersist()
    return space


def _items(benchmark: DataFrame) -> DataFrame:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text", answer.alias("answer")).where("text is not null").distinct()


def indices(docs: DataFrame, benchmark: DataFrame, cosine: float, sure: float, likely: float):
    """An index for each block of about BLOCK_ITEMS items at most, as a broadcast."""
    items = _items(benchmark)
    parts = -(-items.count() // BLOCK_ITEMS)
    if not parts:
        return
    space = fit(docs.select("text"), items)
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text", "answer").collect()
        yield docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"], r["answer"]) for r in rows], space, cosine, sure, likely))


def find(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, sure: float = SURE, likely: float = LIKELY) -> DataFrame:
    """doc_id, item_id, cosine, common_share and answer_share of each leak."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = rows.sparkSession.createDataFrame([], SCHEMA)
    for shared in indices(rows, benchmark, cosine, sure, likely):
        out = out.union(_searched(rows, shared))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "common_share", "answer_share")])


def _searched(rows: DataFrame, shared) -> DataFrame:
    def run(batch):
        ids = batch.column(0).to_pylist()
        out = [(ids[k], *found) for k, *found in shared.value.leaks(batch.column(1).to_pylist())]
        if not out:
            return None
        return {c: pa.array(x, pa.int64() if i < 2 else pa.float64()) for i, (c, x) in enumerate(zip(("doc_id", "item_id", "cosine", "common_share", "answer_share"), zip(*out)))}

    return arrow_map(rows, run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...], cosine: float = COSINE, sure: float = SURE, likely: float = LIKELY) -> DataFrame:
    """The rows of docs whose text leaks no item, in one narrow stage for each block of items."""
    prepare(docs.sparkSession)
    carry = columns if "text" in columns else (*columns, "text")
    out = docs.select(*carry)
    for shared in indices(docs, benchmark, cosine, sure, likely):
        out = _without(out, carry.index("text"), shared)
    return out.select(*columns)


def _without(rows: DataFrame, place: int, shared) -> DataFrame:
    def run(batch):
        stay = np.ones(batch.num_rows, bool)
        stay[[k for k, *_ in shared.value.leaks(batch.column(place).to_pylist())]] = False
        kept = batch.filter(pa.array(stay))
        return {c: kept.column(i) for i, c in enumerate(kept.schema.names)} if kept.num_rows else None

    return arrow_map(rows, run, rows.schema)
