"""Language identification with labelled spans of mixed-language text.

Each word's script (a code point range) narrows the candidate languages to those that the
labelled rows write in that script. Character n-grams score the word for the candidates, and a
Viterbi pass over the words with a penalty for each switch labels spans. A document's language is
the one whose spans have most letters.

Learning uses labelled rows only, all of them but those held out, and all of their words. Their
n-grams are counted where the rows are, so the driver gets tables of fixed size for each language.

The Viterbi pass runs over all words of a batch at once. Texts are cut into blocks; a block's best
scores from each entry state to each exit state form a matrix; the matrices of a text are chained;
then each block is traced with its known entry and exit. The result is that of the plain pass.

Edge cases: a null, empty or letterless text is `und` with score 0; a text with letters in unseen
scripts only gets the language with most labelled rows and a score of 1 over the number of
languages; with no labelled rows at all every text is `und`. A null doc_id is never learned from
and never held out. Equal scores go to the language that sorts first. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from medloom.llm.common import arrow_map, totals

#: Script ranges: name, first and last code point. Letters outside all of them are "other".
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = ["none", "other", *dict.fromkeys(s[0] for s in SCRIPTS)]
GRAMS, BITS = (2, 3, 4), 15
BLOCK = 64
#: Counts of a language: n-grams for each n, then letters for each script.
COUNTS = len(GRAMS) * (1 << BITS) + len(NAMES)
#: Characters of words whose n-grams are made at a time.
SPELT = 150_000
#: Longer words are learned from in stretches of so many characters, as scripts without spaces have them.
LONGEST = 64
FLOOR = -8.0
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, n_spans bigint, spans string"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point the number of its script, 0 for what isn't a letter."""
    out = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    for name, first, last in SCRIPTS:
        part = out[first : last + 1]
        part[part > 0] = NAMES.index(name)
    return out


def gram_features(words: list[str]):
    """For each n: hashed n-grams of the words with an end mark on both sides, and the number of
    the word of each; then the letters and the script of each word."""
    cp = np.frombuffer(("\x01" + "\x01".join(w.replace("\x01", " ") for w in words) + "\x01").encode("utf-32-le", "replace"), np.uint32)
    mark = cp == 1
    of = np.cumsum(mark) - 1
    script = letters()[cp]
    counts = np.bincount(of, script > 0, len(words) + 1)[: len(words)].astype(np.int64)
    kind = np.zeros(len(words) + 1, np.uint8)
    at = np.flatnonzero(script)[::-1]
    kind[of[at]] = script[at]
    out, h = [], cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    base = h
    for n in range(2, max(GRAMS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + base[n - 1 :]
        if n in GRAMS:
            last = of[n - 1 :] - mark[n - 1 :]
            ok = np.flatnonzero(of[: len(h)] == last)
            out.append(((h[ok] >> np.uint64(64 - BITS)).astype(np.int64), of[ok]))
    return out, counts, kind[: len(words)]


class LanguageModel:
    """Log-probabilities of hashed n-grams by language, and which languages each script may be."""

    def __init__(self, totals: dict[str, np.ndarray], rows: dict[str, int], smooth: float = 0.05, penalty: float = 10.0):
        self.langs = sorted(rows)
        self.penalty = penalty
        k = len(self.langs)
        self.default = max(range(k), key=lambda i: rows[self.langs[i]]) if k else 0
        every = np.array([totals[x] for x in self.langs], float).reshape(k, COUNTS)
        counts = np.split(every[:, : -len(NAMES)] + smooth, len(GRAMS), axis=1)
        by_script = every[:, -len(NAMES) :].T
        self.tables = [np.ascontiguousarray((np.log(c) - np.log(c.sum(1, keepdims=True))).T.astype(np.float32)) for c in counts]
        self.allowed = by_script > 0.001 * by_script.sum(0, keepdims=True)

    def word_scores(self, words: list[str]):
        """Log of each language's share for each word, its letters, and whether it tells anything."""
        k = len(self.langs)
        scores = np.zeros((len(words), k), np.float32)
        letter, told = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        start = 0
        while start < len(words):
            size, end = 0, start
            while end < len(words) and (end == start or size < SPELT):
                size += len(words[end]) + 1
                end += 1
            grams, letter[start:end], kind = gram_features(words[start:end])
            part = np.zeros((end - start, k), np.float64)
            for table, (g, of) in zip(self.tables, grams):
                if len(of):
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    part[of[first]] += np.add.reduceat(table[g], first, axis=0)
            ok = self.allowed[kind]
            know = (kind > 0) & ok.any(1)
            part = np.where(ok, part, -1e9)
            part -= part.max(1, keepdims=True)
            part -= np.log(np.exp(part).sum(1, keepdims=True))
            scores[start:end] = np.where(know[:, None], np.maximum(part, FLOOR), 0)
            told[start:end] = know
            start = end
        return scores, letter, told

    def label(self, scores: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi labels of the words: index has a row of scores for each word, sizes the words
        of each text."""
        k, total = scores.shape[1], int(sizes.sum())
        blocks = -(-sizes // BLOCK)
        first_block = np.cumsum(blocks) - blocks
        n = int(blocks.sum())
        if not n:
            return np.zeros(0, np.int64)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = first_block[text_of] * BLOCK + within
        padded = np.full(n * BLOCK, len(scores))
        padded[cell] = index
        padded = padded.reshape(n, BLOCK)
        scores = np.vstack([scores, np.zeros((1, k), np.float32)])
        low, penalty = np.float32(-1e9), np.float32(self.penalty)
        reach = np.where(np.eye(k, dtype=bool), np.float32(0), low)[None].repeat(n, 0)
        for t in range(BLOCK):
            reach = np.maximum(reach, reach.max(2, keepdims=True) - penalty) + scores[padded[:, t]][:, None, :]
        order = np.argsort(-blocks, kind="stable")
        order = order[blocks[order] > 0]
        b, f = blocks[order], first_block[order]
        v, entry = np.zeros((len(order), k), np.float64), np.zeros((n, k), np.int64)
        for t in range(int(b[0])):
            live = int(np.searchsorted(-b, -t, "left"))
            each = v[:live, :, None] + reach[f[:live] + t]
            entry[f[:live] + t] = each.argmax(1)
            v[:live] = each.max(1)
        leave, enter = np.zeros(n, np.int64), np.zeros(n, np.int64)
        state = v.argmax(1)
        for t in range(int(b[0]) - 1, -1, -1):
            live = int(np.searchsorted(-b, -t, "left"))
            at = f[:live] + t
            leave[at] = state[:live]
            state[:live] = enter[at] = entry[at, state[:live]]
        d = np.full((n, k), low, np.float32)
        d[np.arange(n), enter] = 0
        back = np.zeros((BLOCK, n, k), np.uint8)
        own = np.arange(k, dtype=np.uint8)
        for t in range(BLOCK):
            best = d.max(1, keepdims=True)
            stay = d >= best - penalty
            back[t] = np.where(stay, own, d.argmax(1)[:, None])
            d = np.where(stay, d, best - penalty) + scores[padded[:, t]]
        out, state, rows = np.zeros((n, BLOCK), np.int64), leave, np.arange(n)
        for t in range(BLOCK - 1, -1, -1):
            out[:, t] = state
            state = back[t, rows, state]
        return out.reshape(-1)[cell]

    def predict(self, texts: pa.Array):
        """Language, score, number of spans and spans (language:first word:last word) of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        k = len(self.langs)
        if not k:
            return ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts), [""] * len(texts)
        scores, letter, told = self.word_scores(words)
        labels = self.label(scores, index, sizes)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        weight = letter[index]
        heard = np.where(told[index], weight, 0)
        by = np.bincount(text_of * k + labels, heard, len(sizes) * k).reshape(-1, k)
        best = by.argmax(1)
        share = np.bincount(text_of, heard * np.exp(scores[index, best[text_of]].astype(np.float64)), len(sizes))
        known, all_letters = np.bincount(text_of, heard, len(sizes)), np.bincount(text_of, weight, len(sizes))
        lang, score, n_spans, spans = [], [], [], []
        ends = np.cumsum(sizes)
        change = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])]) if len(labels) else np.zeros(0, int)
        lo, hi = np.searchsorted(change, ends - sizes), np.searchsorted(change, ends)
        for i in range(len(sizes)):
            if not all_letters[i]:
                lang.append("und"), score.append(0.0), n_spans.append(0), spans.append("")
                continue
            if not known[i]:
                lang.append(self.langs[self.default]), score.append(1 / k), n_spans.append(0), spans.append("")
                continue
            lang.append(self.langs[best[i]])
            score.append(min(1.0, float(share[i] / known[i])))
            cuts, base = [*change[lo[i] : hi[i]].tolist(), int(ends[i])], int(ends[i] - sizes[i])
            n_spans.append(len(cuts) - 1)
            spans.append(",".join(f"{self.langs[labels[a]]}:{a - base}:{z - 1 - base}" for a, z in zip(cuts, cuts[1:])))
        return lang, score, n_spans, spans


def fold(doc_id):
    """The remainder that holds a fifth of the rows out of learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def add_counts(words: list[str], times: np.ndarray, out: np.ndarray) -> None:
    """Adds the n-grams and letters of words that occur so many times to a language's counts."""
    long = [i for i, w in enumerate(words) if len(w) > LONGEST]
    if long:
        cut = [[w[a : a + LONGEST] for a in range(0, len(w), LONGEST)] for w in words]
        times = np.repeat(times, [len(x) for x in cut])
        words = [w for x in cut for w in x]
    ends = np.cumsum([len(w) + 1 for w in words])
    start = 0
    while start < len(words):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SPELT, "right")))
        grams, letter, kind = gram_features(words[start:end])
        own = times[start:end]
        for i, (g, of) in enumerate(grams):
            out[i << BITS : (i + 1) << BITS] += np.bincount(g, own[of], 1 << BITS).astype(np.int64)
        out[-len(NAMES) :] += np.bincount(kind, own * letter, len(NAMES)).astype(np.int64)
        start = end


def learn(docs: DataFrame, penalty: float = 10.0) -> LanguageModel:
    """Fit on all labelled rows whose fold isn't 0. What reaches the driver are COUNTS numbers for
    each language."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return LanguageModel({}, {}, penalty=penalty)
    place = {lang: i for i, lang in enumerate(sorted(rows))}

    def count(batch, out):
        texts, langs = batch.column(1).cast(pa.large_string()), batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            split = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pc.equal(langs, lang))))
            coded = split.flatten().dictionary_encode()
            words, times = coded.dictionary.to_pylist(), np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
            some = [i for i, w in enumerate(words) if w]
            add_counts([words[i] for i in some], times[some], out[place[lang]])

    found = totals(known.select("lang", "text"), count, COUNTS, np.int64)
    return LanguageModel({lang: found[i] for lang, i in place.items()}, rows, penalty=penalty)


def predict(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs, in one narrow stage; the columns in carry come along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in carry if c not in ("doc_id", "text")]
    shown = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), *kept)

    def run(batch):
        lang, score, n_spans, spans = shared.value.predict(batch.column(1))
        out = {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "n_spans": pa.array(n_spans, pa.int64()), "spans": pa.array(spans, pa.string())}
        if carry:
            out |= {"text": batch.column(1)} | {c: batch.column(3 + i) for i, c in enumerate(kept)}
        return out

    kinds = dict(docs.dtypes)
    more = ", text string" + "".join(f", `{c}` {kinds[c]}" for c in kept) if carry else ""
    return arrow_map(shown, run, SCHEMA + more)


def identify(docs: DataFrame, penalty: float = 10.0) -> DataFrame:
    """Learn from docs, then predict the language of each of its rows."""
    return predict(docs, learn(docs, penalty))
