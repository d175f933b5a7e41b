"""Secret scans with SQL functions only.

Three patterns give the base spans. Besides them, each run of at least `window` token characters
outside an assignment is a candidate. A window slides over it: one character comes in and one goes
out, and only their two counts change the sum that gives the window's Shannon entropy. This is done
per character class: for the candidate as a whole if it holds letters and digits, and for each run
of hexadecimal characters in it. A candidate is a secret if a window of a class reaches the class's
threshold, unless the allow-list names it or it holds a base span.

Positions come from the pieces between matches: both functions cut at the same matches, so
lengths of pieces and matches add up to code point offsets. Sums run over stretches of STRETCH
matches, so the work stays in proportion to a text with very many of them.

Edge cases: a null or empty text has no span and the digest of the empty string; repeated rows
give repeated results; an empty table gives none; other columns, whatever their names, are ignored.
Spans that start together are ordered as kinds are listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidates are looked for outside assignments, which start a match before them.
SCAN = f"(?:{ASSIGN})|{CANDIDATE}"
HEX_RUN = r"[0-9A-Fa-f]{20,}"
#: Least entropy in bits of a window of hexadecimal and of other token characters.
HEX_BITS, TOKEN_BITS = 3.0, 3.85
#: Candidates that look like these are known not to be secrets.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6}|0123456789|1234567890|abcdefgh|qwerty|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Matches whose places are summed up together.
STRETCH = 256

SPAN = "struct<start:int,kind:int,end:int,hit:string>"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the matches of a pattern, in order; the text is scanned once if there are none."""
    none = F.array().cast(f"array<{SPAN}>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sized = F.filter(F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("hit"), F.coalesce(F.length(gap), F.lit(0)).alias("gap"))), lambda x: x["hit"].isNotNull())

    def step(state, x):
        first = state["at"] + x["gap"]
        last = first + F.length(x["hit"])
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), last.alias("end"), x["hit"].alias("hit")).cast(SPAN)
        return F.struct(last.alias("at"), F.array_append(state["found"], span).alias("found"))

    def stretch(state, own):
        found = F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("found")), step)
        return let(found, lambda f: F.struct(f["at"].alias("at"), F.array_append(state["found"], f["found"]).alias("found")))

    def placed(own):
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / STRETCH).cast("int")), lambda j: F.slice(own, j * STRETCH + 1, F.lit(STRETCH)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("found"))
        return F.flatten(F.aggregate(stretches, start, stretch, lambda s: s["found"]))

    return F.when(text.rlike(pattern), let(sized, placed)).otherwise(none)


def greatest_entropy(token: Column, window: int = WINDOW) -> Column:
    """The greatest entropy of a window of the token, from incremental counts: of the character that
    goes and of the one that comes, counted in the window they leave or join."""
    weights = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    weigh = lambda n: F.element_at(weights, n + 1)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def counted(chars, first, size, c):
        return F.size(F.filter(F.slice(chars, first, size), lambda x: x == c))

    def step(chars):
        def slide(state, i):
            gone = let(F.element_at(chars, F.greatest(i - window, F.lit(1))), lambda c: let(counted(chars, F.greatest(i - window, F.lit(1)), F.lit(window), c), lambda n: weigh(n) - weigh(n - 1)))
            come = let(F.element_at(chars, i), lambda c: let(counted(chars, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)), c), lambda n: weigh(n + 1) - weigh(n)))
            moved = state["s"] - F.when(i > window, gone).otherwise(F.lit(0.0)) + come
            bits = lambda s: F.when(i >= window, F.lit(math.log2(window)) - s / window).otherwise(F.lit(0.0))
            return let(moved, lambda s: F.struct(s.alias("s"), F.greatest(state["best"], bits(s)).alias("best")))

        return slide

    return let(F.split(token, ""), lambda chars: F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step(chars), lambda s: s["best"]))


def is_secret(token: Column) -> Column:
    """Whether a window of a class of the candidate reaches the class's threshold, and neither the
    allow-list nor a base pattern fits."""
    hexadecimal = lambda run: run.rlike("[0-9]") & run.rlike("[A-Fa-f]") & (greatest_entropy(run) >= HEX_BITS)
    of_hex = token.rlike(HEX_RUN) & F.exists(F.regexp_extract_all(token, F.lit(HEX_RUN), F.lit(0)), hexadecimal)
    of_token = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (greatest_entropy(token) >= TOKEN_BITS)
    known = token.rlike(ALLOWED) | token.rlike(ASSIGN) | token.rlike(ACCESS) | token.rlike(HEX)
    return ~known & (of_token | of_hex)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans, of each row."""
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.filter(matches(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= LEAST_VALUE).alias("assign"),
        matches(text, ACCESS, 1).alias("access"),
        matches(text, HEX, 2).alias("hex"),
        F.when(text.rlike(CANDIDATE), matches(text, SCAN, 3)).otherwise(F.array().cast(f"array<{SPAN}>")).alias("candidates"),
    )
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    free = F.filter("candidates", lambda c: ~c["hit"].rlike(f"^(?:{ASSIGN})") & is_secret(c["hit"]))
    found = found.withColumn("entropy", F.when(F.size("candidates") > 0, free).otherwise(F.col("candidates")))
    count = lambda c: F.size(c).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "entropy")).alias("spans"), count("entropy").alias("n_entropy"),
    )


def _sql_spans(kind: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return (
        f"list_transform(range(1, 1 + len(regexp_extract_all(t, '{quoted}'))), lambda i: {{'start': list_sum(list_transform(string_split_regex(t, '{quoted}')[1:i], lambda g: length(g)))::BIGINT "
        f"+ coalesce(list_sum(list_transform(regexp_extract_all(t, '{quoted}')[1:i - 1], lambda g: length(g))), 0)::BIGINT, 'kind': {kind}, 'hit': regexp_extract_all(t, '{quoted}')[i]}})"
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL, with each window's entropy counted anew."""
    assign, allowed = ASSIGN.replace("'", "''"), ALLOWED.replace("'", "''")
    bits = lambda x: f"list_max(list_transform(range(1, length({x}) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr({x}, i, {WINDOW}), ''), 'entropy')))"
    ended = lambda x: f"list_transform({x}, lambda s: {{'start': s.start, 'kind': s.kind, 'end': s.start + length(s.hit), 'hit': s.hit}})"
    text = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda s: ['assign', 'access', 'hex', 'entropy'][s.kind + 1] || ':' || s.start || ':' || s.\"end\"), ',')"
    known = " AND ".join(f"NOT regexp_matches(x.hit, '{p}')" for p in (allowed, assign, ACCESS, HEX))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id,
  list_filter({ended(_sql_spans(0, ASSIGN))}, lambda s: length(regexp_extract(s.hit, '{assign}', 2)) >= {LEAST_VALUE}) AS a,
  {ended(_sql_spans(1, ACCESS))} AS k, {ended(_sql_spans(2, HEX))} AS h, {ended(_sql_spans(3, SCAN))} AS c FROM d),
b AS (SELECT doc_id, a, k, h, c, list_concat(list_concat(a, k), h) AS base FROM m),
e AS (SELECT doc_id, a, k, h, base, list_filter(c, lambda x: NOT regexp_matches(x.hit, '^(?:{assign})') AND {known}
  AND (regexp_matches(x.hit, '[0-9]') AND regexp_matches(x.hit, '[A-Za-z]') AND {bits("x.hit")} >= {TOKEN_BITS}
    OR len(list_filter(regexp_extract_all(x.hit, '{HEX_RUN}'), lambda r: regexp_matches(r, '[0-9]') AND regexp_matches(r, '[A-Fa-f]') AND {bits("r")} >= {HEX_BITS})) > 0)) AS e FROM b)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(k)::BIGINT AS n_access, len(h)::BIGINT AS n_hex,
  sha256({text('base')}) AS base_sha256, {text('list_concat(base, e)')} AS spans, len(e)::BIGINT AS n_entropy FROM e"""
