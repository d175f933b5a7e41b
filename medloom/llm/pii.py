"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The base spans come from four patterns. The field then labels whole segments: features of a
candidate span as a whole (its layout, digits, check sum, the word before it, its neighbours) score
each type, weights between neighbouring segments' types are added, and dynamic programming over the
tokens, with entities of at most MOST tokens, chooses boundaries and types together. So two card
numbers that run into each other, a phone number without a plus after "tel" or a spelt-out address
come out as spans of their own. A span of the field is added if no base span overlaps it.

Candidates are segments that could be of a type by what they are made of: seven digits at least for
a phone, thirteen for a card, four short numbers with points, one at sign or its spelling. Whether
they are is the field's choice. It is trained on the driver for the conditional likelihood of whole
segmentations: forward and backward sums over all segmentations give the expected features. The
training lines are generated (`examples`, a parameter), the same for a seed; the weights travel with
the tasks. At most MOST tokens and CHARS characters make an entity, the bounds of the field (an
address has no more than 254 characters); base spans have no such bound. Work is linear in the text.

Edge cases: a null or empty text has no span and the digest of the empty string; repeated rows
give repeated results; an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from medloom.llm.common import arrow_map

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Tokens and characters of an entity at most, and characters around a candidate that the field reads.
MOST, CHARS, REACH = 24, 254, 64
#: Groups of digits of a card or phone number at most; tokens that are decoded at a time (pieces of a
#: longer stretch overlap by an entity).
GROUPS, PIECE = 7, 2048

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]", re.ASCII)
_SIGN = re.compile(r"[0-9@]")
_AT = re.compile(r"@|\bat\b", re.ASCII)
_WORD = re.compile(r"([A-Za-z]{1,12})[^A-Za-z0-9]{0,3}$")

SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d += d if d < 5 else d - 9
        total += d
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, each leftmost and not overlapping within its kind, in linear time."""
    emails, ips, cards, phones = [], [], [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            emails.append((start, found.end()))
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)
    if _SIGN.search(text):
        for m in _DOTTED.finditer(text):
            # groups of four numbers of a dotted chain, from the left
            chain, start = m.group().split("."), m.start()
            for i in range(0, len(chain) - 3, 4):
                own = chain[i : i + 4]
                size = sum(map(len, own)) + 3
                if all(map(small, own)):
                    ips.append((start, start + size))
                start += size + 1
        for m in _CARD.finditer(text):
            digits = digits_of(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                phones.append(m.span())
    return [emails, ips, cards, phones]


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def layout(span: str) -> str:
    """The span's outline: runs of digits by length, runs of letters, other characters as they are."""
    out = re.sub(r"[A-Za-z]+", "a", span)
    return re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", out)


def features(kind: int, span: str, before: str, after: str) -> list[str]:
    """Features of a segment as a whole for a type, with the text before it and after it."""
    digits = digits_of(span)
    n = len(digits)
    last, word = before[-1:], _WORD.search(before)
    kind_of = lambda c: "-" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c
    out = ["bias", f"n{min(n, 20)}", f"first{kind_of(span[0])}", f"left{kind_of(last)}", f"right{kind_of(after[:1])}"]
    out.append(f"word{word.group(1).lower() if word else ''}")
    if kind == 0:
        out += [f"at{len(_AT.findall(span))}", f"dot{'.' in span or 'dot' in span}", f"gap{' ' in span}"]
    elif kind == 1:
        parts = span.split(".")
        out += [f"small{all(map(small, parts))}", f"longest{max(map(len, parts))}"]
    elif kind == 2:
        out += [f"luhn{luhn(digits)}", f"lead{digits[:1]}", f"groups{len(re.findall('[0-9]+', span))}"]
    else:
        out += ["lay" + layout(span)[:40], f"seps{len(re.findall(r'[^0-9]+', span))}", f"zero{span.startswith('0')}", f"closed{span.count('(') == span.count(')')}"]
    return out


_EMAIL = re.compile(r"[\w.%+-]+ ?(?:@|[(\[]at[)\]]|(?<= )at(?= )) ?[\w-]+(?: ?(?:\.|[(\[]dot[)\]]|(?<= )dot(?= )) ?[\w-]+)+", re.ASCII)
_CARD_MADE = re.compile(r"[0-9](?:[ -]{0,3}[0-9])*")
_PHONE_MADE = re.compile(r"[+(]{0,2}[0-9][0-9 ().+/-]*")


def candidates(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int, str]]]:
    """For each token that can end an entity, its candidates: the first token, type and span."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in spans]
    own = [text[a:z] for a, z in spans]
    digits, signs, groups = [0], [0], [0]
    for w in own:
        groups.append(groups[-1] + ("0" <= w[0] <= "9"))
        digits.append(digits[-1] + (len(w) if "0" <= w[0] <= "9" else 0))
        signs.append(signs[-1] + (w == "@" or w == "at"))
    for j in range(1, len(spans) + 1):
        end = spans[j - 1][1]
        if not own[j - 1][0].isalnum() or digits[j] - digits[max(0, j - MOST)] < 4 and signs[j] == signs[max(0, j - MOST)]:
            continue
        for i in range(j - 1, max(-1, j - 1 - MOST), -1):
            start = spans[i][0]
            if end - start > CHARS or (i < j - 1 and "\n" in text[spans[i][1] : spans[i + 1][0]]):
                break
            count, mail = digits[j] - digits[i], signs[j] - signs[i]
            if mail > 1 or not mail and count > 19:
                break
            if not (own[i][0].isalnum() or own[i] in "+("):
                continue
            if not mail and groups[j] - groups[i] > GROUPS:
                break
            span = text[start:end]
            if mail:
                if _EMAIL.fullmatch(span):
                    out[j - 1].append((i, 0, span))
            elif count >= 4:
                if j - i == 7 and all(w == "." for w in own[i + 1 : j : 2]) and all(w.isdigit() and len(w) < 4 for w in own[i:j:2]) and len(span) == sum(map(len, own[i:j])):
                    out[j - 1].append((i, 1, span))
                if count >= 13 and _CARD_MADE.fullmatch(span):
                    out[j - 1].append((i, 2, span))
                if 7 <= count <= 15 and _PHONE_MADE.fullmatch(span):
                    out[j - 1].append((i, 3, span))
    return out


def _added(values: list[float]) -> float:
    """Logarithm of the sum of exponentials."""
    most = max(values)
    return most if most == -math.inf else most + math.log(sum(math.exp(v - most) for v in values))


class SegmentField:
    """Weights of whole-span features by type and between neighbouring types, with the sums and the
    best path over all segmentations. A token outside entities is a segment of type NONE."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, keys: list[str]) -> float:
        w = self.weights
        return sum(w[k] for k in keys if k in w)

    def between(self) -> list[list[float]]:
        return [[self.weights.get(f"{a}>{b}", 0.0) for b in range(NONE + 1)] for a in range(NONE + 1)]

    def lattice(self, text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int, list[str]]]]:
        """The candidates that end at each token: first token, type and keys of the features."""
        return [[(i, k, [f"{k}{f}" for f in features(k, span, text[max(0, spans[i][0] - 24) : spans[i][0]], text[spans[j][1] : spans[j][1] + 1])]) for i, k, span in own] for j, own in enumerate(candidates(text, spans))]

    def forward(self, lattice, fold=_added):
        """For each place and type, the folded score of the segmentations up to there that end with
        the type, and the same with the weight to a next type."""
        move, low = self.between(), -math.inf
        ends, enter = [], []
        first = [low] * NONE + [0.0]
        for j in range(len(lattice) + 1):
            if j:
                own: list[list[float]] = [[] for _ in range(NONE)]
                for i, k, keys in lattice[j - 1]:
                    own[k].append(enter[i][k] + self.score(keys))
                first = [fold(x) if x else low for x in own] + [enter[j - 1][NONE]]
            ends.append(first)
            live = [a for a in range(NONE + 1) if first[a] > low]
            enter.append([fold([first[a] + move[a][b] for a in live]) for b in range(NONE + 1)])
        return ends, enter

    def expected(self, lattice) -> tuple[dict[str, float], float]:
        """Expected count of each key over all segmentations, and the logarithm of their sum."""
        ends, enter = self.forward(lattice)
        n, move, low = len(lattice), self.between(), -math.inf
        total = _added(ends[n])
        # after[i][a]: folded score of what may follow place i after a segment of type a
        after: list = [None] * n + [[0.0] * (NONE + 1)]
        starts: list[list] = [[] for _ in range(n + 1)]
        for j, own in enumerate(lattice):
            for i, k, keys in own:
                starts[i].append((j + 1, k, keys, self.score(keys)))
        out: dict[str, float] = {}
        for i in range(n - 1, -1, -1):
            begin: list[list[float]] = [[] for _ in range(NONE)] + [[after[i + 1][NONE]]]
            for j, k, keys, score in starts[i]:
                rest = score + after[j][k]
                begin[k].append(rest)
                share = math.exp(enter[i][k] + rest - total)
                for key in keys:
                    out[key] = out.get(key, 0.0) + share
            value = [_added(x) if x else low for x in begin]
            for a in range(NONE + 1):
                if ends[i][a] > low:
                    for b in range(NONE + 1):
                        if value[b] > low:
                            key = f"{a}>{b}"
                            out[key] = out.get(key, 0.0) + math.exp(ends[i][a] + move[a][b] + value[b] - total)
            after[i] = [_added([move[a][b] + value[b] for b in range(NONE + 1) if value[b] > low]) for a in range(NONE + 1)]
        return out, total

    def decode(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation of the tokens: kind, start and end of its entities."""
        lattice = self.lattice(text, spans)
        if not any(lattice):
            return []
        ends, enter = self.forward(lattice, max)
        move, out = self.between(), []
        j, kind = len(lattice), max(range(NONE + 1), key=lambda a: ends[len(lattice)][a])
        while j:
            i = j - 1
            if kind != NONE:
                i = max((i for i, k, _ in lattice[j - 1] if k == kind), key=lambda i: max(enter[i][kind] + self.score(keys) for f, k, keys in lattice[j - 1] if f == i and k == kind))
                out.append((kind, spans[i][0], spans[j - 1][1]))
            before = kind
            j, kind = i, max(range(NONE + 1), key=lambda a: ends[i][a] + move[a][before])
        return out[::-1]


def counted(lattice, spans: list[tuple[int, int]], gold: list[tuple[int, int, int]]) -> dict[str, float]:
    """Count of each key in a given segmentation."""
    first, last = {a: i for i, (a, _) in enumerate(spans)}, {z: i for i, (_, z) in enumerate(spans)}
    out: dict[str, float] = {}
    at, before = 0, NONE

    def add(key):
        out[key] = out.get(key, 0.0) + 1

    for kind, a, z in gold:
        i, j = first[a], last[z]
        keys = next((keys for f, k, keys in lattice[j] if f == i and k == kind), None)
        if keys is None:
            continue
        for _ in range(at, i):
            add(f"{before}>{NONE}")
            before = NONE
        add(f"{before}>{kind}")
        for key in keys:
            add(key)
        at, before = j + 1, kind
    for _ in range(at, len(spans)):
        add(f"{before}>{NONE}")
        before = NONE
    return out


def generated(seed: int, examples: int):
    """Lines of words with entities and look-alikes, and the spans of the entities."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "er", "th", "in", "ou", "es", "de", "la"]) for _ in range(rng.randint(1, 4)))

    def card():
        body = rng.choice("3456") + number(rng.choice([11, 12, 14, 14, 14, 17]))
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        if rng.random() < 0.5:
            return digits
        return rng.choice([" ", "-", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone():
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"0049 {a} {b} {c}", f"+{number(2)} {a} {b}{c}", f"1-{a}-{b}-{c}", f"(0{number(2)}) {number(3)} {number(4)}", f"0{number(3)}/{number(6)}"])

    def told_phone():
        cue = rng.choice(["tel", "tel:", "phone", "Phone:", "call", "fax", "mobile", "tel.", "cell"])
        a, b, c = number(3), number(3), number(4)
        return cue + " ", rng.choice([f"{a} {b} {c}", f"0{number(2)} {number(7)}", f"{a}{b}{c}", f"{b}-{c}", f"{b} {c}", f"0{number(4)} {number(6)}"])

    def email():
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] ")])
        return f"{word()}{rng.choice(['', '.', '_'])}{number(rng.randint(0, 2))}{at}{word()}{dot}{rng.choice(['com', 'org', 'net'])}"

    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def other():
        cue = rng.choice(["order", "invoice", "id", "ref", "isbn", "no", "part", "year", "total", "page", "version", ""])
        a = rng.choice([f"{number(4)}-{number(2)}-{number(2)}", number(rng.randint(1, 20)), f"{number(1)}.{number(2)}.{number(1)}", " ".join(number(3) for _ in range(rng.randint(2, 6))), f"{number(2)}:{number(2)}:{number(2)}", f"{number(1)},{number(3)},{number(3)}", f"{number(5)}-{number(6)}-{number(5)}", f"{number(3)}.{number(1)}.{number(3)}.{rng.randint(256, 999)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(4)} {number(4)} {number(4)}", f"{number(4)}-{number(4)}", f"{word()} at {word()} and {word()}", f"978-{number(1)}-{number(5)}-{number(3)}-{number(1)}"])
        return (cue + " " if cue else "") + a

    for _ in range(examples):
        text, gold = "", []
        for _ in range(rng.randint(3, 8)):
            kind = rng.randint(0, 11)
            before, piece = ("", word())
            if kind < 4:
                before, piece = ("", [email, ip, card, phone][kind]())
            elif kind == 4:
                before, piece = told_phone()
                kind = 3
            elif kind < 9:
                piece, kind = other(), NONE
            else:
                kind = NONE
            text += before
            if kind < 4:
                gold.append((kind, len(text), len(text) + len(piece)))
            text += piece + rng.choice([" ", " ", " ", ", ", ". "])
        yield text, gold


@lru_cache(maxsize=4)
def train(seed: int = 7, examples: int = 400, rounds: int = 4, rate: float = 0.3, decay: float = 1e-3) -> SegmentField:
    """Stochastic ascent of the conditional likelihood of whole segmentations of generated lines."""
    field = SegmentField()
    lines = [(field.lattice(t, spans), spans, g) for t, g in generated(seed, examples) for spans in [tokens_of(t, 0, len(t))]]
    size: dict[str, float] = {}
    for _ in range(rounds):
        for lattice, spans, gold in lines:
            step = field.expected(lattice)[0]
            step = {k: -v for k, v in step.items()}
            for k, v in counted(lattice, spans, gold).items():
                step[k] = step.get(k, 0.0) + v
            for k, v in step.items():
                w = field.weights.get(k, 0.0)
                v -= decay * w
                size[k] = size.get(k, 0.0) + v * v
                field.weights[k] = w + rate * v / (1e-6 + math.sqrt(size[k]))
    return field


#: Where a candidate may be: seven digits with little between them, four numbers with points, an at sign.
_MAYBE = re.compile(r"[0-9](?:[ ().+/-]{0,3}[0-9]){6,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|@|[(\[]at[)\]]|\bat\b(?= [\w-]{1,64} dot )", re.ASCII)


def surroundings(text: str):
    """Stretches around what may be a candidate, as far as REACH characters on either side."""
    start = end = -1
    for m in _MAYBE.finditer(text):
        a, z = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if start >= 0 and a <= end:
            end = z
        else:
            if start >= 0:
                yield start, end
            start, end = a, z
    if start >= 0:
        yield start, end


def added_spans(text: str, field: SegmentField, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Spans by kind that the field finds besides the base spans."""
    taken = sorted(x for own in base for x in own)
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    for a, z in surroundings(text):
        # not within a word, if it isn't longer than any entity
        low, high = a, z
        while low and a - low < CHARS and text[low - 1].isalnum() and text[low].isalnum():
            low -= 1
        while high < len(text) and high - z < CHARS and text[high - 1].isalnum() and text[high].isalnum():
            high += 1
        tokens, at = tokens_of(text, low, high), 0
        while at < len(tokens):
            stop = tokens[at + PIECE][0] if at + PIECE < len(tokens) else high
            for kind, start, end in field.decode(text, tokens[at : at + PIECE + MOST]):
                if start < stop:
                    stop = max(stop, end)
                    if not _overlaps(taken, start, end):
                        out[kind].append((start, end))
            at = bisect_left(tokens, (stop, 0), at + 1)
    return out


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted spans overlaps; spans of one kind don't overlap each other."""
    i = bisect_left(taken, (end,))
    return any(start < z for _, z in taken[max(0, i - 2 * len(KINDS)) : i])


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, own in enumerate(spans) for a, z in sorted(own))


def find(docs: DataFrame, field: SegmentField | None = None) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans and the number of added
    ones, for each row. One narrow stage."""
    own = field or train()

    def run(batch):
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            more = added_spans(text, own, base)
            rows.append((*map(len, base), hashlib.sha256(joined(base).encode()).hexdigest(), joined([b + m for b, m in zip(base, more)]), sum(map(len, more))))
        columns = list(zip(*rows))
        names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
        return {"doc_id": batch.column(0)} | {c: pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for c, x in zip(names, columns)}

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, SCHEMA)
