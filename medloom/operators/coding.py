"""Diagnosis codes by three layers, and search in the code table.

The code table is a constant of some eighty rows; its aliases, token sets and term weights are
folded into literals, so coding is a projection over distinct diagnoses: no join, no shuffle but
the one that makes diagnoses distinct.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from medloom.functions import lexicon, text as T

MATCH = "struct<icd_code:string,confidence:double,match_type:string>"
_WORD = r"\b[a-z]+\b"


def literal(value, kind: str) -> Column:
    """A constant of any type; folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def tokens(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def normal(c: Column) -> Column:
    """A diagnosis as aliases are written: lower case, single spaces, no empty suffix."""
    c = F.regexp_replace(T.strip(F.lower(c)), r"\s+", " ")
    return T.strip(F.regexp_replace(c, r",?\s*(unspecified|nos|nec|not otherwise specified)$", ""))


def exact(c: Column, codes=lexicon.CODES) -> Column:
    """Layer 1: the alias itself, or what is left of it without a qualifier."""
    known = literal(lexicon.alias_codes(codes), "map<string,string>")

    def layer(own):
        tries = F.filter(F.transform(F.array(*[F.lit(q) for q in lexicon.QUALIFIERS]), lambda q: F.element_at(known, F.replace(own, q, F.lit("")))), lambda x: x.isNotNull())
        direct = F.element_at(known, own)
        return F.when(direct.isNotNull(), _match(direct, F.lit(0.97), "exact")).otherwise(F.get(F.transform(tries, lambda x: _match(x, F.lit(0.90), "exact_trimmed")), F.lit(0)))

    return T.let(normal(c), layer)


def _match(code: Column, confidence: Column, kind: str) -> Column:
    return F.struct(code.alias("icd_code"), confidence.alias("confidence"), F.lit(kind).alias("match_type")).cast(MATCH)


def fuzzy(c: Column, codes=lexicon.CODES) -> Column:
    """Layer 2: the best Jaccard similarity of token sets with descriptions and aliases; more for a
    diagnosis within an alias. The first of equals wins."""
    sets = []
    for code, description, _, aliases in codes:
        for text, is_alias in [(description, False), *((a, True) for a in aliases)]:
            own = sorted(set(tokens(text)) - set(lexicon.STOP_WORDS))
            if own:
                sets.append({"code": code, "words": own, "alias": is_alias})
    table = literal(sets, "array<struct<code:string,words:array<string>,alias:boolean>>")
    words = F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))
    asked = F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in lexicon.STOP_WORDS]))

    def layer(own):
        def step(best, row):
            def better(both):
                score = both / F.size(F.array_union(own, row["words"]))
                score = F.when(row["alias"] & (both == F.size(own)), F.least(score * 1.3, F.lit(1.0))).otherwise(score)
                return T.let(score, lambda s: F.when(s > best["score"], F.struct(s.alias("score"), row["code"].alias("code"))).otherwise(best))

            return T.let(F.size(F.array_intersect(own, row["words"])), lambda both: F.when(both > 0, better(both)).otherwise(best))

        best = F.aggregate(table, F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("code")), step)
        return F.when(F.size(own) > 0, T.let(best, lambda b: F.when(b["score"] >= 0.35, _match(b["code"], F.round(F.least(b["score"] * 0.23 + 0.65, F.lit(0.88)), 3), "fuzzy"))))

    return T.let(asked, layer)


def term_weights(codes=lexicon.CODES) -> list[dict]:
    """Weights of the terms of each code's texts and their norm. Documents are counted by words
    between spaces, terms by runs of letters."""
    texts = [d.lower() + " " + " ".join(a) for _, d, _, a in codes]
    split = [set(t.split()) for t in texts]
    out = []
    for (code, *_), text in zip(codes, texts):
        words = re.findall(_WORD, text)
        own = {w: n / len(words) * (math.log((len(texts) + 1) / (sum(w in s for s in split) + 1)) + 1) for w, n in Counter(words).items()}
        out.append({"code": code, "norm": math.sqrt(sum(v * v for v in own.values())), "weights": own})
    return out


def semantic(c: Column, codes=lexicon.CODES) -> Column:
    """Layer 3: the best cosine of the diagnosis's term shares with the codes' term weights."""
    index = term_weights(codes)
    table = literal(index, "array<struct<code:string,norm:double,weights:map<string,double>>>")
    known = literal(sorted({w for x in index for w in x["weights"]}), "array<string>")
    words = F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))
    share = lambda own, t: F.size(F.filter(own, lambda w: w == t)) / F.size(own)
    query = T.let(words, lambda own: F.transform(F.array_intersect(own, known), lambda t: F.struct(t.alias("term"), share(own, t).alias("share"))))

    def layer(q):
        norm = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x["share"] * x["share"]))
        dot = lambda row: F.aggregate(q, F.lit(0.0), lambda a, x: a + x["share"] * F.coalesce(F.element_at(row["weights"], x["term"]), F.lit(0.0)))

        def search(norm):
            def step(best, row):
                return T.let(dot(row) / (norm * row["norm"]), lambda s: F.when(s > best["score"], F.struct(s.alias("score"), row["code"].alias("code"))).otherwise(best))

            return F.aggregate(table, F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("code")), step)

        best = T.let(norm, search)
        return F.when(F.size(q) > 0, T.let(best, lambda b: F.when(b["score"] >= 0.20, _match(b["code"], F.round(F.least(b["score"] * 0.35 + 0.40, F.lit(0.78)), 3), "semantic"))))

    return T.let(query, layer)


def coded(diagnoses: DataFrame, codes=lexicon.CODES) -> DataFrame:
    """icd_code, confidence, match_type, description and category of each row's diagnosis: the
    first layer that finds one."""
    info = literal({c: {"d": d, "c": k} for c, d, k, _ in codes}, "map<string,struct<d:string,c:string>>")
    none = F.struct(F.lit("").alias("icd_code"), F.lit(0.0).alias("confidence"), F.lit("no_match").alias("match_type")).cast(MATCH)
    name = F.col("diagnosis")
    rows = diagnoses.withColumn("m", F.coalesce(exact(name, codes), fuzzy(name, codes), semantic(name, codes), none))
    own = F.element_at(info, F.col("m.icd_code"))
    return rows.select(*diagnoses.columns, "m.icd_code", "m.confidence", "m.match_type", F.coalesce(own["d"], F.lit("No mapping found")).alias("description"), F.coalesce(own["c"], F.lit("Unknown")).alias("category"))


def map_reports(found: DataFrame, threshold: float = 0.40, codes=lexicon.CODES) -> DataFrame:
    """A row for each report and distinct diagnosis of recognised reports. Diagnoses are made
    distinct before they are coded, so work doesn't grow with how often one is named. Names under
    three characters are skipped; matches under the threshold count as none."""
    each = found.select("report_id", F.explode(F.array_distinct("diseases")).alias("diagnosis")).where(F.length(T.strip(F.col("diagnosis"))) >= 3)
    names = coded(each.select("diagnosis").distinct(), codes)
    none = (F.col("confidence") < threshold) & (F.col("match_type") != "no_match")
    names = names.select("diagnosis", *[F.when(none, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in (("icd_code", ""), ("confidence", 0.0), ("match_type", "no_match"), ("description", "No mapping found"), ("category", "Unknown"))])
    return each.join(names, "diagnosis").select("report_id", "diagnosis", "icd_code", "confidence", "match_type", "description", "category")


def summarise(matches: DataFrame) -> DataFrame:
    """Mapped and unmapped counts, categories and codes of each report."""
    mapped = F.col("icd_code") != ""
    return matches.groupBy("report_id").agg(
        F.count(F.when(mapped, 1)).alias("mapped_count"), F.count(F.when(~mapped, 1)).alias("unmapped_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(mapped, F.col("category")))), ",").alias("categories"),
        F.array_join(F.array_sort(F.collect_set(F.when(mapped, F.col("icd_code")))), ",").alias("codes"),
    )


def code_table(spark: SparkSession, codes=lexicon.CODES) -> DataFrame:
    return spark.createDataFrame([(i, c, d, k, a) for i, (c, d, k, a) in enumerate(codes)], "ord int, icd_code string, description string, category string, aliases array<string>")


def search(spark: SparkSession, keyword: str, most: int = 5, codes=lexicon.CODES) -> DataFrame:
    """Codes whose description or an alias holds the keyword, in the table's order: the top few."""
    low = keyword.lower()
    hit = F.contains(F.lower("description"), F.lit(low)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(low)))
    rows = code_table(spark, codes).where(hit).orderBy("ord").limit(most)
    return rows.select("icd_code", "description", "category", F.lit(0.85).alias("confidence"), F.lit("search").alias("match_type"))


def code_info(spark: SparkSession, code: str, codes=lexicon.CODES) -> DataFrame:
    return code_table(spark, codes).where(F.col("icd_code") == code).select("icd_code", "description", "category")


def confidence_bar(confidence: Column) -> Column:
    """Ten blocks, as many filled as tenths."""
    full = F.floor(confidence * 10).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 10 - full))


def formatted(matches: DataFrame) -> DataFrame:
    """A display line of each match, with a bar and a level."""
    level = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    line = F.when(F.col("icd_code") != "", F.concat_ws(" ", F.col("diagnosis"), F.lit("→"), F.col("icd_code"), confidence_bar(F.col("confidence")), F.concat(F.lit("("), F.col("match_type"), F.lit(")")))).otherwise(F.concat(F.col("diagnosis"), F.lit("  →  No ICD-10 match found")))
    return matches.select("report_id", "diagnosis", line.alias("line"), level.alias("level"))
