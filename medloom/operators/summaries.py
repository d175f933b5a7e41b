"""Extractive summaries, short summaries and rendered notes, made in the row: no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from medloom.functions import lexicon, text as T
from medloom.operators.coding import literal
from medloom.operators.sections import sections


def score(sentence: Column, position: Column, total: Column, section: Column) -> Column:
    """Weight of a sentence: keywords, numbers, section, place and length."""
    low = F.lower(sentence)
    words = T.count_words(sentence).cast("double")
    keywords = F.size(F.filter(F.array(*[F.lit(k) for k in lexicon.CLINICAL_KEYWORDS]), lambda k: F.contains(low, k)))
    numbers = F.regexp_count(sentence, F.lit(r"\d+\.?\d*"))
    place = position / total
    placed = F.when((place <= 0.15) | (place >= 0.85), 0.8).when(place <= 0.30, 0.6).otherwise(0.3)
    length = F.when((words >= 8) & (words <= 35), F.lit(1.0)).when(words < 8, words / 8.0).otherwise(F.greatest(F.lit(0.3), F.lit(35.0) / words))
    total_score = F.least(keywords / 3.0, F.lit(1.0)) * 0.40 + F.least(numbers / 5.0, F.lit(1.0)) * 0.20 + priority(section) * 0.20 + placed * 0.10 + length * 0.10
    return F.round(total_score, 4)


def priority(section: Column) -> Column:
    return F.coalesce(F.element_at(literal(lexicon.SECTION_PRIORITY, "map<string,double>"), F.lower(section)), F.lit(0.5))


def scored(sentences: Column, section: Column) -> Column:
    """Array of position, score, text of the sentences of five words or more."""
    rows = F.transform(sentences, lambda s, i: F.struct(i.alias("position"), score(s, i, F.size(sentences), section).alias("score"), s.alias("text")))
    return F.filter(rows, lambda r: T.count_words(r["text"]) >= 5)


def chosen(sentences: Column, section: Column, ratio: Column, least: int, most: int) -> Column:
    """The heaviest sentences in their own order, joined: a share of them within bounds. The earlier
    of equals wins. Without long sentences the first few are taken."""

    def pick(rows):
        keep = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.size(rows) * ratio).cast("int")))
        by_score = F.array_sort(F.transform(rows, lambda r: F.struct((-r["score"]).alias("k"), r["position"].alias("position"), r["text"].alias("text"))))
        own = F.array_sort(F.transform(F.slice(by_score, F.lit(1), keep), lambda r: F.struct(r["position"], r["text"].alias("text"))))
        return F.when(F.size(rows) > 0, F.array_join(F.transform(own, lambda r: r["text"]), " ")).otherwise(F.array_join(F.slice(sentences, 1, least), " "))

    return T.let(scored(sentences, section), pick)


def section_summaries(c: Column) -> Column:
    """Array of priority, ord, name, summary: the heaviest section first."""
    rows = F.transform(sections(c), lambda s, i: F.struct(s["name"].alias("name"), i.alias("ord"), T.split_sentences(s["body"]).alias("sentences")))
    rows = F.filter(rows, lambda r: F.size(r["sentences"]) > 0)

    def each(r):
        weight = priority(r["name"])
        text = chosen(r["sentences"], r["name"], F.when(weight >= 0.8, 0.5).otherwise(0.3), 1, 6)
        return F.struct((-weight).alias("k"), r["ord"].alias("ord"), r["name"].alias("name"), text.alias("summary"))

    return F.array_sort(F.transform(rows, each))


def extract(c: Column) -> Column:
    """The summaries of sections that weigh at least half, joined; sections are always there, as a
    text without headers is one."""
    return F.array_join(F.transform(F.filter(section_summaries(c), lambda s: s["k"] <= -0.5), lambda s: s["summary"]), " ")


def plain_extract(c: Column) -> Column:
    """The summary of a text taken as one, whatever its sections."""
    return chosen(T.split_sentences(c), F.lit(""), F.lit(0.40), 3, 12)


def short(diseases: Column, symptoms: Column, medications: Column, fallback: Column) -> Column:
    """One line: first diagnosis, symptoms, medications; else the first two sentences."""
    names = F.transform(medications, lambda m: m["name"])
    parts = F.concat_ws(
        " ",
        F.when(F.size(diseases) > 0, F.concat(F.lit("Primary diagnosis: "), F.get(diseases, F.lit(0)), F.lit("."))),
        F.when(F.size(symptoms) > 0, F.concat(F.lit("Presenting symptoms: "), F.array_join(F.slice(symptoms, 1, 3), ", "), F.lit("."))),
        F.when(F.size(names) > 0, F.concat(F.lit("Medications: "), F.array_join(F.slice(names, 1, 3), ", "), F.lit("."))),
    )
    return F.when(parts != "", parts).otherwise(F.array_join(F.slice(F.split(fallback, r"(?<=[.!?])\s+"), 1, 2), " "))


def summarise(found: DataFrame) -> DataFrame:
    """Extractive, abstractive (by default the shortened extract; a model may be plugged in by a
    column `abstractive`), short summary, word counts and compression of recognised reports."""
    rows = found.withColumn("extractive", extract(F.col("text")))
    if "abstractive" not in found.columns:
        rows = rows.withColumn("abstractive", T.truncate(F.col("extractive"), 120))
    words, own = T.count_words(F.col("text")), T.count_words(F.col("abstractive"))
    return rows.select(
        "report_id", "extractive", "abstractive", short(F.col("diseases"), F.col("symptoms"), F.col("medications"), F.col("abstractive")).alias("short"), words.alias("original_words"),
        own.alias("summary_words"), F.coalesce(F.rint(F.try_divide(own, words) * 100) / 100, F.lit(0.0)).alias("compression"),
    )


def _body(own: Column, *names: str) -> Column:
    """The body of the first of these sections that a text has."""
    return F.coalesce(*[F.get(F.transform(F.filter(own, lambda s: s["name"] == n), lambda s: s["body"]), F.lit(0)) for n in names])


def _lines(title: str, rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.concat(F.lit(title + "\n"), F.array_join(rows, "\n")))


def clinical_note(found: DataFrame, generated: str) -> DataFrame:
    """report_id and note: subjective, objective, assessment, plan, summary. `generated` is the time
    to print, so that a note is the same each time it is made."""
    bar, thin = "=" * 65, "─" * 40
    c = F.col("_sections")
    found = found.withColumn("_sections", sections(F.col("text"))).withColumn("_summary", T.truncate(extract(F.col("text")), 120))
    found = found.withColumn("_history", F.array_join(F.slice(T.split_sentences(_body(c, "history of present illness", "hpi")), 1, 3), " "))
    bullet = lambda x: F.concat(F.lit("  • "), x)
    complaint = F.coalesce(T.strip(F.substring(_body(c, "chief complaint"), 1, 200)), F.when(F.size("symptoms") > 0, F.array_join(F.slice("symptoms", 1, 4), ", ")), F.lit("See original report"))
    history = F.col("_history")
    vitals = F.coalesce(_lines("Vital Signs:", F.transform("vitals", lambda v: bullet(F.concat(v["vital"], F.lit(": "), v["value"])))), F.concat(F.lit("Vitals: "), T.strip(F.substring(_body(c, "vital signs"), 1, 150))))
    labs = _lines("\nKey Lab Values:", F.transform(F.slice("labs", 1, 8), lambda x: bullet(F.concat(x["test_name"], F.lit(": "), x["value"], F.when(x["unit"] != "", F.concat(F.lit(" "), x["unit"])).otherwise("")))))
    parts = F.array(*[F.lit(w) for w in lexicon.NOT_DIAGNOSES])
    real = F.filter("diseases", lambda d: ~F.exists(parts, lambda p: F.contains(F.lower(d), p)) & (T.count_words(d) <= 6))
    shown = F.slice(F.when(F.size(real) > 0, real).otherwise(F.slice("diseases", 1, 4)), 1, 6)
    assessment = F.coalesce(_lines("Diagnoses:", F.transform(shown, lambda d, i: F.concat(F.lit("  "), i + 1, F.lit(". "), d))), T.truncate(_body(c, "assessment and plan", "assessment"), 100))
    with_space = lambda x: F.when(x != "", F.concat(F.lit(" "), x)).otherwise("")
    meds = F.transform(F.slice("medications", 1, 8), lambda m: F.concat(F.lit("  • "), m["name"], with_space(m["dosage"]), with_space(m["frequency"]), F.when(m["route"] != "", F.concat(F.lit(" ("), m["route"], F.lit(")"))).otherwise("")))
    plan = F.coalesce(_lines("Medications:", meds), _lines("Medications:", F.transform(F.slice("drugs", 1, 8), bullet)))
    done = _lines("\nProcedures:", F.transform(F.slice("procedures", 1, 5), bullet))
    summary = F.col("_summary")
    note = F.concat_ws(
        "\n", F.lit(bar), F.lit("         AUTO-GENERATED CLINICAL NOTE (AI-ASSISTED)"), F.lit(f"         Generated: {generated}"), F.lit(bar), F.lit("\n[S] SUBJECTIVE"), F.lit(thin),
        F.concat(F.lit("Chief Complaint: "), complaint), F.when(history != "", F.concat(F.lit("\nHistory: "), T.truncate(history, 80))), F.lit("\n[O] OBJECTIVE"), F.lit(thin), vitals, labs,
        F.lit("\n[A] ASSESSMENT"), F.lit(thin), assessment, F.lit("\n[P] PLAN"), F.lit(thin), plan, done, F.when(summary != "", F.concat(F.lit(f"\n[SUMMARY]\n{thin}\n"), T.truncate(summary, 80))),
        F.lit("\n" + bar), F.lit("⚠️  AI-GENERATED NOTE — Requires physician review before use"), F.lit("⚠️  NOT for clinical decision-making without verification"), F.lit(bar),
    )
    return found.select("report_id", note.alias("note"))


def simple_note(found: DataFrame, diagnoses: DataFrame, generated: str) -> DataFrame:
    """A second, plainer template, with a code for each diagnosis. diagnoses has report_id and
    `coded`, an array of "name  [code]" lines in order."""
    bar = "=" * 60
    bullet = lambda x: F.concat(F.lit("  • "), x)
    rows = found.join(diagnoses, "report_id", "left")
    note = F.concat_ws(
        "\n", F.lit(bar), F.lit("AUTO-GENERATED CLINICAL NOTE"), F.lit(f"Generated: {generated}"), F.lit(bar), F.lit("\nPATIENT: N/A "),
        F.when(F.size("symptoms") > 0, F.concat(F.lit("\nCHIEF COMPLAINT:\n  "), F.array_join(F.slice("symptoms", 1, 3), ", "))),
        _lines("\nASSESSMENT / DIAGNOSES:", F.transform(F.coalesce("coded", F.array().cast("array<string>")), lambda d, i: F.concat(F.lit("  "), i + 1, F.lit(". "), d))),
        _lines("\nMEDICATIONS:", F.transform("medications", lambda m: T.strip(F.concat(F.lit("  • "), m["name"], F.lit(" "), m["dosage"], F.lit(" "), m["frequency"])))),
        _lines("\nVITALS:", F.transform("vitals", lambda v: F.concat(F.lit("  "), v["vital"], F.lit(": "), v["value"]))),
        F.lit("\n" + bar), F.lit("⚠️  AI-GENERATED — Requires physician review before use"), F.lit(bar),
    )
    return rows.select("report_id", note.alias("note"))


def statistics(summarised: DataFrame, sections_summarised: DataFrame, model: str = "extractive-only") -> DataFrame:
    """Display figures of summaries. sections_summarised has report_id and sections."""
    ratio = F.col("compression")
    rows = summarised.join(sections_summarised, "report_id", "left")
    return rows.select(
        "report_id", "original_words", "summary_words", F.concat(F.round(ratio * 100).cast("int"), F.lit("%")).alias("compression_ratio"),
        F.concat(((1 - ratio) * 100).cast("int"), F.lit("% shorter")).alias("compression_percent"), F.coalesce("sections", F.lit(0)).alias("sections_summarized"), F.lit(model).alias("model_used"),
    )


#: Heads of a note's blocks; lines with these marks are rules and banners.
BLOCKS = ["[S] SUBJECTIVE", "[O] OBJECTIVE", "[A] ASSESSMENT", "[P] PLAN", "[SUMMARY]"]
BANNERS = ["═", "─", "AUTO-GENERATED", "AI-GENERATED", "Generated:"]


def note_blocks(notes: DataFrame) -> DataFrame:
    """The blocks of rendered notes: report_id, place, block, body, without rules and banners."""
    head = r"(?m)^[ \t]*(" + "|".join(re.escape(b) for b in BLOCKS) + r").*$"
    kept = F.filter(F.split("note", "\n"), lambda line: ~F.exists(F.array(*[F.lit(b) for b in BANNERS]), lambda b: F.contains(line, b)))

    def blocks(text):
        bodies = F.transform(F.split(text, head, -1), lambda b: F.regexp_replace(b, r"\A\n|\n\z", ""))
        heads = F.regexp_extract_all(text, F.lit(head), F.lit(1))
        return T.let(heads, lambda own: F.zip_with(own, F.slice(bodies, F.lit(2), F.size(own)), lambda h, b: F.struct(h.alias("block"), b.alias("body"))))

    return notes.select("report_id", F.posexplode(T.let(F.array_join(kept, "\n"), blocks)).alias("place", "x")).select("report_id", "place", "x.block", "x.body")
