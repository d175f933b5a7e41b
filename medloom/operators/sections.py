"""Sections and sentences of reports, made in the row: no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from medloom.functions import lexicon, text as T

WHOLE = "full_report"
PATTERN = r"(?imd)(?:^|\n)\s*(" + "|".join(re.escape(h).replace("\\ ", " ") for h in sorted(lexicon.SECTION_HEADERS, key=len, reverse=True)) + r")\s*[:\-]?\s*\n?"


def sections(c: Column) -> Column:
    """Array of name and body in order. A header needs no end, so a longer word may start a section;
    a repeated name keeps its first place and its last body; empty bodies and what comes before the
    first header go; a text without headers is one section."""
    names = F.transform(F.regexp_extract_all(c, F.lit(PATTERN), F.lit(1)), lambda h: F.lower(T.strip(h)))
    bodies = F.transform(F.split(c, PATTERN, -1), T.strip)
    whole = F.array(F.struct(F.lit(WHOLE).alias("name"), T.strip(c).alias("body")))

    def found(heads):
        pairs = F.zip_with(heads, F.slice(bodies, F.lit(2), F.size(heads)), lambda n, b: F.struct(n.alias("name"), b.alias("body")))
        return T.let(F.filter(pairs, lambda p: p["body"] != ""), lambda own: F.transform(F.array_distinct(F.transform(own, lambda p: p["name"])), lambda n: F.element_at(F.filter(own, lambda p: p["name"] == n), -1)))

    return T.let(names, lambda heads: F.when(F.size(heads) > 0, found(heads)).otherwise(whole))


def section_rows(reports: DataFrame) -> DataFrame:
    """report_id, ord, name, title, body, word_count, sentences of each section."""
    each = reports.select("report_id", F.posexplode(sections(F.col("text"))).alias("ord", "s"))
    return each.select("report_id", "ord", F.col("s.name").alias("name"), T.title(F.replace("s.name", F.lit("_"), F.lit(" "))).alias("title"), F.col("s.body").alias("body"), T.count_words(F.col("s.body")).alias("word_count"), T.split_sentences(F.col("s.body")).alias("sentences"))


def sentence_rows(reports: DataFrame) -> DataFrame:
    """report_id, position, sentence of each sentence of the whole text."""
    return reports.select("report_id", F.posexplode(T.split_sentences(F.col("text"))).alias("position", "sentence"))


def process(reports: DataFrame, expand_abbreviations: bool = True, abbreviations: dict[str, str] = lexicon.ABBREVIATIONS, strict: bool = False) -> DataFrame:
    """Clean reports: id, clean text, word counts, number of expanded abbreviations. Empty reports
    go, or fail the run if strict; a report without an id gets the one that follows from its text."""
    if strict:
        empty = F.raise_error(F.lit("Input text is empty or could not be read."))
        reports = reports.withColumn("text", F.when(F.length("text") > 0, F.col("text")).otherwise(empty.cast("string")))
    rows = reports.where(F.length("text") > 0)
    given = F.col("report_id").cast("string") if "report_id" in rows.columns else F.lit(None).cast("string")
    rows = rows.select(F.coalesce(given, T.report_id(F.col("text"))).alias("report_id"), F.col("text").alias("raw_text"), T.basic_clean(F.col("text")).alias("basic"))
    if expand_abbreviations:
        rows = rows.withColumn("done", T.expand(F.col("basic"), abbreviations))
    else:
        rows = rows.withColumn("done", F.struct(F.col("basic").alias("text"), F.lit(0).alias("expanded")))
    rows = rows.withColumn("clean_text", T.normalize(F.col("done.text")))
    return rows.select("report_id", "raw_text", "clean_text", T.count_words(F.col("clean_text")).alias("word_count"), T.count_words(F.col("raw_text")).alias("original_word_count"), F.col("done.expanded").alias("abbreviations_expanded"))


def statistics(reports: DataFrame) -> DataFrame:
    """Display figures of processed reports."""
    clean = F.col("clean_text")
    return process(reports).select(
        "report_id", F.lit("text").alias("source_type"), "original_word_count", F.col("word_count").alias("cleaned_word_count"), F.transform(sections(clean), lambda s: s["name"]).alias("sections_detected"),
        F.size(T.split_sentences(clean)).alias("sentence_count"), "abbreviations_expanded",
    )
