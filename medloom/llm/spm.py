"""SentencePiece encoding and decoding, exact for models of the merge type.

Encoding is by backtracking. A sequence of tokens is the one that merging gives exactly when
each two neighbours, merged again on their own, come out as the same two tokens. So the encoder
takes the longest match of an Aho-Corasick automaton at the current byte position; it accepts a
token if it is compatible with its predecessor; it then goes on. Where no token fits it gives up
the last token, marks that position as failed in a bit field and tries the next shorter match.
Each position fails at most once, so the work is linear in positions times match lengths.

Text is cut into words first: a run of space marks with what follows up to the next run. No
piece of such a model has a space mark behind another character (checked when the model is
read), so no merge crosses a cut and words can be encoded alone and remembered.

Edge cases: a null text is an empty text; an empty text gives the begin and end ids only; a
literal space mark in a text is a space mark and decodes to a space, as in the library; characters
outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from medloom.llm.common import arrow_map

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Remembered words and pairs of one Python worker; the memory is emptied when it is full.
WORDS, PAIRS = 300_000, 400_000
#: Characters of a text that are encoded at a time.
LONG = 2 << 20

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _fields(data: bytes):
    """Field number and value of each field of a protocol buffer message."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unexpected wire type {kind}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class MergeModel:
    """A merge-type model: pieces, scores, and the exact encoder and decoder."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL}
                piece.update(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2):
            raise ValueError("only merge-type models without a character map are read")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        if normalizer.get(4, 1):
            raise ValueError("models that remove extra spaces are not read")
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        if USER in self.kinds or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("words can't be encoded alone with this model")
        self.byte_ids = [self.pieces.index(f"<0x{i:02X}>") for i in range(256)]
        self.longest_mark = max(len(p) for p in self.ids if not p.strip(MARK))
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i, b in enumerate(self.byte_ids):
            self.raw[b] = bytes([i])
        for i, k in enumerate(self.kinds):
            if k == CONTROL:
                self.raw[i] = b""
            elif k == UNKNOWN:
                self.raw[i] = " ⁇ ".encode()
        self.pack = struct.Struct("<I").pack
        self.whole: dict[str, bool] = {}
        self.joins: dict[int, bool] = {}
        self.raw_array = None
        self.sizes = [len(p) for p in self.pieces]
        self.words: dict[str, bytes] = {}
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, self.ids[p])
        self.automaton.make_automaton()
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1) for p in self.pieces]
        full = MARK * self.longest_mark
        self.rests = [self.merge(MARK * n) for n in range(self.longest_mark)]
        if any(self.merge(full + MARK * n) != [full, *rest] for n, rest in enumerate(self.rests)):
            raise ValueError("a long run of space marks isn't full pieces and a rest")
        least = min(s for p, s in zip(self.pieces, self.scores) if p in self.ids and p.strip(MARK))
        if any(self.scores[self.ids[p]] >= least for p in self.ids if len(p) > 1 and not p.strip(MARK)):
            raise ValueError("runs of space marks must merge last")

    def merge(self, text: str) -> list[str]:
        """The tokens of text by merging the best adjacent pair, leftmost of equals, over and
        over: the definition, used on pairs of tokens only."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, where = scores[i], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def reachable(self, piece: str) -> bool:
        """Whether merging the piece's own characters gives the piece."""
        got = self.whole.get(piece)
        if got is None:
            got = self.whole[piece] = len(piece) == 1 or self.merge(piece) == [piece]
        return got

    def joined(self, last: int, i: int) -> bool:
        """Whether piece i may follow piece last, or start a word if last is negative."""
        key = last * len(self.pieces) + i
        fit = self.joins.get(key)
        if fit is None:
            if len(self.joins) >= PAIRS:
                self.joins.clear()
            token = self.pieces[i]
            fit = self.joins[key] = self.reachable(token) and (last < 0 or self.merge(self.pieces[last] + token) == [self.pieces[last], token])
        return fit

    def tokens(self, word: str) -> list[int]:
        """The pieces of a word with one leading space mark at most, by backtracking; a character
        that no piece has is the complement of its code point and merges with nothing."""
        size, sizes, shorter = len(word), self.sizes, self.shorter
        best = [-1] * size
        for end, i in self.automaton.iter(word):
            best[end + 1 - sizes[i]] = i  # the longest match of a start comes last
        out: list[int] = []
        failed, at, last, i = 0, 0, -1, best[0]
        while True:
            while i >= 0:
                if not failed >> (at + sizes[i]) & 1 and self.joined(last, i):
                    break
                i = shorter[i]
            if i >= 0 or best[at] < 0 and not failed >> at & 1:
                if i < 0:
                    i = ~ord(word[at])
                out.append(i)
                at += sizes[i] if i >= 0 else 1
                if at == size:
                    return out
                last, i = max(i, -1), best[at]
                continue
            failed |= 1 << at
            if not out:
                raise ValueError(f"no tokens for {word!r}")
            gone = out.pop()
            at -= sizes[gone] if gone >= 0 else 1
            last = max(out[-1], -1) if out else -1
            if gone >= 0:
                i = shorter[gone]
            else:
                i = -1
                failed |= 1 << at

    def longest(self, word: str) -> list[int] | None:
        """Ids of the longest matches from the left, if they cover the word and each is compatible
        with its predecessor: then they are what backtracking would end with, at its first try."""
        at, last, out = 0, -1, []
        joins, sizes, count = self.joins, self.sizes, len(self.pieces)
        for end, i in self.automaton.iter_long(word):
            if end + 1 - sizes[i] != at:
                return None
            fit = joins.get(last * count + i)
            if not (self.joined(last, i) if fit is None else fit):
                return None
            out.append(i)
            last, at = i, end + 1
        return out if at == len(word) else None

    def _packed(self, tokens: list[int]) -> bytes:
        out = []
        for i in tokens:
            out += [i] if i >= 0 else [self.byte_ids[b] for b in chr(~i).encode()]
        return struct.pack(f"<{len(out)}I", *out)

    def word(self, word: str) -> bytes:
        """Packed ids of a space mark and the word, which has no space mark."""
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            ids = self.longest(MARK + word)
            got = self.words[word] = self._packed(ids or self.tokens(MARK + word))
        return got

    def run(self, marks: int) -> bytes:
        """Packed ids of a run of space marks: equal scores, so the leftmost grows first."""
        full, rest = divmod(marks, self.longest_mark)
        return self.pack(self.ids[MARK * self.longest_mark]) * full + self._packed([self.ids[p] for p in self.rests[rest]])

    def spaced(self, marks: int, word: str) -> bytes:
        """Packed ids of a run of space marks with a word behind it. The run's own merges score
        least, so the word and the last mark merge first."""
        if not word:
            return self.run(marks)
        tokens = self.tokens(MARK + word)
        if tokens[0] == self.ids[MARK]:
            return self.run(marks) + self._packed(tokens[1:])
        return self.run(marks - 1) + self._packed(tokens)

    def encode_packed(self, text: str) -> bytes:
        """Packed ids of text without begin and end ids."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if len(text) > LONG and self.dummy_prefix:
            # a space between two other characters parts words, and the prefix stands for it
            out, at = [], 0
            for m in re.finditer(r"(?<=[^ ]) (?=[^ ])", text):
                if m.start() - at >= LONG:
                    out.append(self._words_packed(text[at : m.start()]))
                    at = m.end()
            return b"".join([*out, self._words_packed(text[at:])])
        return self._words_packed(text)

    def _words_packed(self, text: str) -> bytes:
        parts = text.split(" ")
        head = b""
        if not self.dummy_prefix:
            first = parts.pop(0)
            head = self._packed(self.tokens(first)) if first else b""
        if "" not in parts:
            get, missing = self.words.get, self.word
            return head + b"".join([get(w) or missing(w) for w in parts])
        out, marks = [head], 0
        for w in parts:
            marks += 1
            if w:
                out.append(self.word(w) if marks == 1 else self.spaced(marks, w))
                marks = 0
        if marks:
            out.append(self.run(marks))
        return b"".join(out)

    def encode(self, text: str, add_bos: bool = True, add_eos: bool = True) -> list[int]:
        packed = self.encode_packed(text)
        ids = list(struct.unpack(f"<{len(packed) // 4}I", packed))
        return [self.bos] * add_bos + ids + [self.eos] * add_eos

    def decode(self, ids) -> str:
        """Text of ids: begin and end ids vanish, the first space mark of the first piece with it."""
        return self._text(b"".join(map(self.raw.__getitem__, ids))).decode()

    def _text(self, raw: bytes) -> bytes:
        if self.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode(errors="replace").encode()

    def decode_all(self, packed: list[bytes]):
        """UTF-8 of the text of each of the packed ids, taken piece by piece from one array."""
        if self.raw_array is None:
            self.raw_array = pa.array(self.raw, pa.binary())
        ids = np.frombuffer(b"".join(packed), "<u4")
        pieces = self.raw_array.take(pa.array(ids))
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, at = memoryview(pieces.buffers()[2]) if len(ids) else b"", 0
        for p in packed:
            end = at + len(p) // 4
            yield self._text(bytes(data[ends[at] : ends[end]]))
            at = end


_MODELS: dict[bytes, MergeModel] = {}


def model_of(data: bytes) -> MergeModel:
    """The model of these bytes, built once per process."""
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        _MODELS[key] = MergeModel(data)
    return _MODELS[key]


def encode_documents(docs: DataFrame, model_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text, with the ids
    themselves if keep_ids. One narrow stage; the model file is read on the driver and travels
    with the task. Other columns of docs are ignored; repeated rows give repeated results."""
    data = read_model(model_path or default_model())

    def run(batch):
        model = model_of(data)
        bos, eos = model.pack(model.bos), model.pack(model.eos)
        packed = [bos + model.encode_packed(text or "") + eos for text in batch.column(1).to_pylist()]
        counts = np.array([len(p) // 4 for p in packed], np.int64)
        out = {
            "doc_id": batch.column(0), "n_tokens": pa.array(counts), "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in model.decode_all(packed)], pa.string()),
        }
        if keep_ids:
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        return out

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, SCHEMA + ", ids array<int>" * keep_ids)
