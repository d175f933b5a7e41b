"""The whole analysis of a corpus of reports: one lazy plan for each result table.

Entities are recognised once and shared by the summary, relation and code plans; nothing loops over
reports. Results can be registered as views for SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from medloom.functions import lexicon
from medloom.operators import coding, entities, relations, sections, summaries
from medloom.runtime import kept


@dataclass(frozen=True)
class Settings:
    """What a run can be told: tables that replace the defaults, thresholds, and hooks for models."""

    expand_abbreviations: bool = True
    abbreviations: dict = field(default_factory=lambda: lexicon.ABBREVIATIONS)
    codes: tuple = field(default_factory=lambda: tuple(lexicon.CODES))
    confidence_threshold: float = 0.5
    code_threshold: float = 0.40
    #: Loads a tagging model in a worker; see entities.tag_with.
    load_tagger: object = None
    #: Makes the column `abstractive` of recognised reports; else the extract is shortened.
    abstractive: object = None
    #: Keep the recognised reports as a checkpoint, so that the tables don't recognise them again each.
    keep: bool = False
    #: Printed in notes.
    generated: str = "not dated"


def analyse(reports: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Result tables of reports(report_id, text): reports_clean, sections, sentences, recognised,
    entities, medications, labs, vitals, sentence_scores, summaries, relations, icd_matches,
    icd_summaries, notes, metrics."""
    s = settings or Settings()
    clean = sections.process(reports, s.expand_abbreviations, s.abbreviations)
    texts = clean.select("report_id", F.col("clean_text").alias("text"))
    tagged = entities.tag_with(texts, s.load_tagger) if s.load_tagger else texts
    found = entities.recognise(tagged, s.confidence_threshold)
    if s.abstractive is not None:
        found = found.withColumn("abstractive", s.abstractive)
    if s.keep:
        found = kept(found)
    secs = sections.section_rows(texts)
    related = relations.extract(found)
    matches = coding.map_reports(found, s.code_threshold, s.codes)
    summary = summaries.summarise(found)
    coded = coding.summarise(matches)
    rows = lambda name: found.select("report_id", F.explode(name).alias("x")).select("report_id", "x.*")
    metrics = (
        clean.select("report_id", "word_count").join(summary.select("report_id", "summary_words", "compression"), "report_id")
        .join(found.select("report_id", F.size("entities").alias("entities"), F.size("diseases").alias("diagnoses"), F.size("medications").alias("medications")), "report_id")
        .join(related.select("report_id", F.size("relations").alias("relations")), "report_id").join(coded.select("report_id", "mapped_count"), "report_id", "left").fillna(0, ["mapped_count"])
    )
    return {
        "reports_clean": clean, "sections": secs, "sentences": secs.select("report_id", F.col("name").alias("section"), F.posexplode("sentences").alias("position", "text")), "recognised": found,
        "entities": rows("entities"), "medications": rows("medications"), "labs": rows("labs"), "vitals": rows("vitals"),
        "sentence_scores": secs.select("report_id", "name", F.explode(summaries.scored(F.col("sentences"), F.col("name"))).alias("x")).select("report_id", F.col("name").alias("section"), "x.*"),
        "summaries": summary, "relations": relations.relation_rows(related), "icd_matches": matches, "icd_summaries": coded, "notes": summaries.clinical_note(found, s.generated), "metrics": metrics,
    }


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Views of the result tables, for SQL."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
