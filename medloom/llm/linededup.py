"""Line dedup through a log-template tree, with DataFrame functions only.

A line's fields that hold a digit or an at sign are variable at once. The tree has a fixed depth:
token count, then the leading tokens; a leaf holds the masked lines that share both, and any number
of templates. A token's support is in how many documents' lines of the leaf it is at its position.
A line's own template has the support that `alike` of its positions reach; positions whose token has
less than `share` of that are variable, the others are fixed. So lines of one template agree in what
is fixed, whatever other lines the leaf holds and however many there are: all measures are ratios.

A template recurs if at least `least` documents have it (a line of `long` tokens or more from
`least_long` documents on). Its lines are dropped; with `keep_first` they stay in the document with
the smallest id that has it.

Lines themselves aren't shuffled: 128-bit hashes of masked lines are, with the document's key.
Tokens are looked at for leaves that may hold templates of several lines only; a bit map of those
leaves' hashes, 8 MB whatever their number, is broadcast to find them, and another one to leave the
texts of documents that lose nothing out of the last shuffle. Counts are combined on the map side,
and what a hot line has to tell its documents is joined, so Spark can split it.

Edge cases: a null text is an empty text; blank lines are never templates and stay; rows with the
same doc_id count as one document; a null doc_id counts as the smallest. A document whose lines
all go keeps its row with an empty text. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from medloom.llm.common import BITS, prepare
from medloom.runtime import Scratch

LEADING, ALIKE, SHARE = 3, 0.7, 0.5
LEAST, LONG, LEAST_LONG = 5, 50, 2
VARIABLE = r"\S*[0-9@]\S*"
MASK = "<*>"
NONE = -(1 << 63)


def masked(line: Column) -> Column:
    own = F.trim(line)
    return F.when(own.rlike("[0-9@]"), F.regexp_replace(own, VARIABLE, MASK)).otherwise(own)


def tokens(own: Column) -> Column:
    """Number of tokens between single spaces."""
    return F.length(own) - F.length(F.replace(own, F.lit(" "), F.lit(""))) + 1


def _keyed(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The document's key (_d, _h) and its text (_text), with the columns in extra."""
    return docs.select(*extra, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE)).alias("_d"), F.xxhash64("text").alias("_h"), F.coalesce("text", F.lit("")).alias("_text"))


def _lines(docs: DataFrame) -> DataFrame:
    """d, h, pos, own (the masked line), n (its tokens), leaf (a hash), l1 and l2 (the line's hash)
    of each line that isn't blank."""
    each = _keyed(docs).select(F.col("_d").alias("d"), F.col("_h").alias("h"), F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    each = each.select("d", "h", "pos", masked(F.col("line")).alias("own")).where("own <> ''").withColumn("n", tokens(F.col("own")))
    return each.select("d", "h", "pos", "own", "n", F.xxhash64("n", F.substring_index("own", " ", LEADING)).alias("leaf"), F.xxhash64("own").alias("l1"), F.xxhash64(F.lit("line"), "own").alias("l2"))


def _bit_map(hashes: DataFrame, column: str) -> DataFrame:
    """A map of BITS bits, those of the column's values set, as rows of a few kilobytes."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    return hashes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))


def _in_map(frame: DataFrame, column: str, shown: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows whose column's value is (or isn't) in a bit map."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    place = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = frame.join(F.broadcast(shown), F.bitmap_bucket_number(bit) == F.col("_row"), "left")
    there = F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))), F.lit(0)) == 1
    return found.where(there if wanted else ~there).drop("_row", "_bits")


def _templates(read: DataFrame, lines: DataFrame, enough: Column, alike: float, share: float, parts: int, scratch: Scratch) -> DataFrame:
    """l1, l2 and the template (t1, t2) of each line with positions that are variable in its leaf."""
    leaves = lines.groupBy("leaf", "n").agg(F.sum("docs").alias("w"), F.count("*").alias("kinds")).where((F.col("kinds") > 1) & (F.col("w") >= enough) & (F.col("n") > LEADING)).select("leaf")
    leaves = scratch.keep(leaves)
    own = _in_map(read.select("leaf", "l1", "l2", "own"), "leaf", _bit_map(leaves, "leaf"))
    own = own.groupBy("leaf", "l1", "l2").agg(F.min("own").alias("own")).join(lines.drop("first"), ["leaf", "l1", "l2"]).join(leaves.distinct().repartition(parts), "leaf", "left_semi")
    place = own.select("leaf", "n", "l1", "l2", "docs", F.posexplode(F.split("own", " ")).alias("i", "token")).where(f"i >= {LEADING}").withColumn("token", F.xxhash64("token"))
    support = place.groupBy("leaf", "i", "token").agg(F.sum("docs").alias("df")).repartition(parts)
    each = place.join(support, ["leaf", "i", "token"]).groupBy("leaf", "n", "l1", "l2").agg(F.array_sort(F.collect_list(F.struct("i", "token", "df"))).alias("at"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(alike)).cast("int") - LEADING)
    each = each.withColumn("most", F.sort_array(F.transform("at", lambda x: x["df"]), asc=False))
    each = each.where(F.element_at("most", -1) < F.element_at("most", rank) * F.lit(share))
    # bound once for all positions of the line
    own = F.transform(F.array(F.struct("at", (F.element_at("most", rank) * F.lit(share)).alias("typical"))), lambda s: F.filter(s["at"], lambda x: x["df"] >= s["typical"]))
    fixed = F.transform(F.element_at(own, 1), lambda x: F.struct(x["i"], x["token"]))
    return each.select("leaf", "l1", "l2", fixed.alias("fixed")).select("l1", "l2", F.xxhash64("leaf", "fixed").alias("t1"), F.xxhash64(F.lit("template"), "leaf", "fixed").alias("t2"))


def recurring(docs: DataFrame, least: int = LEAST, least_long: int = LEAST_LONG, long: int = LONG, alike: float = ALIKE, share: float = SHARE, keep_first: bool = False, *, scratch: Scratch) -> DataFrame:
    """d, h and pos of the lines to drop, which depend on the tables in scratch."""
    prepare(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = F.when(F.col("n") >= long, least_long).otherwise(least)
    read = _lines(docs)
    seen = scratch.keep(read.select("d", "h", "pos", "n", "leaf", "l1", "l2"))
    held = seen.groupBy("leaf", "n", "l1", "l2", "d").agg(F.lit(1).alias("one"))
    lines = scratch.keep(held.groupBy("leaf", "n", "l1", "l2").agg(F.count("*").alias("docs"), F.min("d").alias("first")))
    shaped = scratch.keep(_templates(read, lines, enough, alike, share, parts, scratch))
    of = seen.select("n", "l1", "l2", "d").join(shaped.repartition(parts), ["l1", "l2"]).groupBy("n", "t1", "t2", "d").agg(F.lit(1).alias("one"))
    templates = of.groupBy("n", "t1", "t2").agg(F.count("*").alias("docs"), F.min("d").alias("first")).where(F.col("docs") >= enough)
    several = shaped.join(templates.repartition(parts), ["t1", "t2"]).select("l1", "l2", "first")
    single = lines.where(F.col("docs") >= enough).join(shaped.select("l1", "l2"), ["l1", "l2"], "left_anti").select("l1", "l2", "first")
    gone = seen.select("d", "h", "pos", "l1", "l2").join(several.union(single).repartition(parts), ["l1", "l2"])
    return (gone.where("d <> first") if keep_first else gone).select("d", "h", "pos")


def drop_lines(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), **rules) -> DataFrame:
    """The columns, the text without its dropped lines, n_lines and n_dropped, for each row; rules
    are those of `recurring`."""
    extra = tuple(c for c in columns if c != "text")
    prepare(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        gone = recurring(docs, scratch=scratch, **rules).groupBy("d", "h").agg(F.collect_set("pos").alias("gone")).checkpoint()
    near = _bit_map(gone, "h")
    own = gone.select(F.col("d").alias("_d"), F.col("h").alias("_h"), F.col("gone").alias("_gone"))
    keyed = _keyed(docs, extra)
    lines = F.size(F.split("_text", "\n")).cast("bigint").alias("n_lines")
    whole = _in_map(keyed, "_h", near, False).select(*extra, F.col("_text").alias("text"), lines, F.lit(0).cast("bigint").alias("n_dropped"))
    kept = _in_map(keyed, "_h", near).join(own.hint("shuffle_hash"), ["_d", "_h"], "left").withColumn("_lines", F.split("_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("_lines", i + 1)), "\n"))
    return kept.select(*extra, text.alias("text"), F.size("_lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped")).union(whole)


def dedup_lines(docs: DataFrame, **rules) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256, the digest of the text that stays."""
    found = drop_lines(docs, ("doc_id",), **rules)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle(least: int = LEAST, least_long: int = LEAST_LONG, long: int = LONG, alike: float = ALIKE, share: float = SHARE) -> str:
    """The same rows in DuckDB's SQL, on strings in place of hashes."""
    lead = f"array_to_string(string_split(own, ' ')[1:{LEADING}], ' ')"
    enough = f"CASE WHEN n >= {long} THEN {least_long} ELSE {least} END"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NONE}) AS d, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, d, text, string_split(text, chr(10)) AS lines FROM docs),
each AS (SELECT r, d, u.pos, trim(u.line) AS line FROM split, (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS pos) u),
own AS (SELECT r, d, pos, regexp_replace(line, '{VARIABLE}', '{MASK}', 'g') AS own FROM each WHERE line <> ''),
leaf AS (SELECT r, d, pos, own, length(own) - length(replace(own, ' ', '')) + 1 AS n, {lead} AS lead FROM own),
kind AS (SELECT n, lead, own, count(DISTINCT d) AS docs FROM leaf GROUP BY ALL),
big AS (SELECT n, lead FROM kind WHERE n > {LEADING} GROUP BY ALL HAVING count(*) > 1 AND sum(docs) >= {enough}),
place AS (SELECT n, lead, own, docs, p.i, p.token FROM (SELECT * FROM kind SEMI JOIN big USING (n, lead)), (SELECT unnest(string_split(own, ' ')) AS token, generate_subscripts(string_split(own, ' '), 1) AS i) p WHERE p.i > {LEADING}),
support AS (SELECT n, lead, i, token, sum(docs) AS df FROM place GROUP BY ALL),
line AS (SELECT n, lead, own, list(i ORDER BY i) AS i, list(token ORDER BY i) AS token, list(df ORDER BY i) AS df, list(df ORDER BY df DESC) AS most FROM place JOIN support USING (n, lead, i, token) GROUP BY ALL),
shape AS (SELECT n, lead, own, list_transform(token, lambda t, k: CASE WHEN df[k] >= most[greatest(1, ceil(n * {alike}::DOUBLE)::INT - {LEADING})] * {share}::DOUBLE THEN t END) AS shape FROM line),
shaped AS (SELECT n, lead, own, shape FROM shape WHERE len(list_filter(shape, lambda t: t IS NULL)) > 0),
named AS (SELECT r, d, pos, leaf.n, leaf.lead, shape, CASE WHEN shape IS NULL THEN own END AS own FROM leaf LEFT JOIN shaped USING (n, lead, own)),
again AS (SELECT n, lead, shape, own FROM named GROUP BY ALL HAVING count(DISTINCT d) >= {enough}),
gone AS (SELECT r, pos FROM named JOIN again ON named.n = again.n AND named.lead = again.lead AND named.own IS NOT DISTINCT FROM again.own AND named.shape IS NOT DISTINCT FROM again.shape),
by_row AS (SELECT r, list(pos) AS gone FROM gone GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  sha256(array_to_string(list_filter(lines, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), chr(10))) AS kept_sha256
FROM split LEFT JOIN by_row USING (r)"""
