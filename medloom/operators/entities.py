"""Entities, medications, laboratory values and vitals by rules, made in the row: no shuffle.

Diseases and drugs come from models where a caller plugs one in (`tag_with`); by default a
gazetteer of diagnosis aliases and of drugs tags them, which is not the same as a trained model.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from medloom.functions import lexicon, text as T

ENTITY = "struct<text:string,label:string,start:int,end:int,confidence:double,source:string>"
# The patterns of dates, medications, laboratory values and vitals.
DATES = r"(?i)\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d{1,2},?\s+\d{4}"
MEDICATION = (
    r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)\s+(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|mEq|IU|milligrams?|micrograms?|grams?|milliliters?|units?)\s*"
    r"(once|twice|three times|daily|weekly|monthly|q\d+h|prn|stat)?(?:\s+(by mouth|intravenous|oral|iv|po|im|sc|topical))?"
)
LAB = (
    r"(?i)\b(Sodium|Potassium|Chloride|Glucose|BUN|Creatinine|Calcium|Magnesium|Hemoglobin|Hematocrit|Platelets|WBC|ALT|AST|ALP|Bilirubin|INR|HbA1c|TSH|Troponin|BNP|CRP|ESR|"
    r"LDL|HDL|Triglycerides|Albumin|Lactate|Procalcitonin)\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*([a-zA-Z/%µg]*)"
)
VITALS = {
    "Blood Pressure": r"(?i)\bblood pressure[:\s]+(\d{2,3}/\d{2,3})\s*(?:mmHg)?",
    "Heart Rate": r"(?i)\bheart rate[:\s]+(\d{2,3})\s*(?:bpm)?",
    "Respiratory Rate": r"(?i)\brespiratory rate[:\s]+(\d{1,2})\s*(?:rpm|breaths)?",
    "Temperature": r"(?i)\btemperature[:\s]+(\d{2,3}\.?\d*\s*°?[FCfc]?)",
    "Oxygen Saturation": r"(?i)\boxygen saturation[:\s]+(\d{2,3})\s*(?:%)?",
    "BMI": r"(?i)\bbody mass index[:\s]+(\d{2,3}\.?\d*)",
    "Weight": r"(?i)\bweight[:\s]+(\d{2,3}\.?\d*\s*(?:kg|lbs)?)",
}
VITALS_WITH_UNITS = {
    "Blood Pressure": r"(?i)(?:blood pressure|BP)\s*[:\-]?\s*(\d{2,3}/\d{2,3}(?:\s*mmHg)?)",
    "Heart Rate": r"(?i)(?:heart rate|HR|pulse)\s*[:\-]?\s*(\d{2,3}(?:\s*bpm)?)",
    "Respiratory Rate": r"(?i)(?:respiratory rate|RR)\s*[:\-]?\s*(\d{1,2}(?:\s*(?:rpm|breaths/min))?)",
    "Temperature": r"(?i)(?:temperature|Temp)\s*[:\-]?\s*(\d{2,3}(?:\.\d)?(?:\s*°?[FCfc])?)",
    "Oxygen Saturation": r"(?i)(?:oxygen saturation|SpO2|O2 sat)\s*[:\-]?\s*(\d{2,3}(?:\s*%)?)",
    "BMI": r"(?i)(?:BMI|body mass index)\s*[:\-]?\s*(\d{2,3}(?:\.\d)?)",
    "Weight": r"(?i)(?:weight|Wt)\s*[:\-]?\s*(\d{2,3}(?:\.\d)?(?:\s*(?:kg|lbs))?)",
    "Height": r"(?i)(?:height|Ht)\s*[:\-]?\s*(\d{2,3}(?:\.\d)?(?:\s*(?:cm|in|ft))?)",
}
DISEASE_NAMES = sorted({*lexicon.alias_codes(), *(d.lower() for own in lexicon.SYMPTOM_DISEASES.values() for d in own)} - set(lexicon.SYMPTOMS), key=lambda x: (-len(x), x))
DRUG_NAMES = sorted(lexicon.DRUG_DISEASES, key=lambda x: (-len(x), x))


def words_pattern(names: list[str]) -> str:
    return r"(?i)\b" + T.any_of(names) + r"\b"


def _strings(own: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in own])


def entity(text, label: str, start, confidence: float, source: str = "rule") -> Column:
    return F.struct(text.alias("text"), F.lit(label).alias("label"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")).cast(ENTITY)


def places(c: Column, pattern: str, hits: Column) -> Column:
    """Starts of the matches of a pattern, from the lengths of the pieces between them."""
    sizes = F.zip_with(F.split(c, pattern, -1), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    return T.starts_of(F.filter(sizes, lambda x: x["h"].isNotNull()))


def matched(c: Column, pattern: str, label: str, confidence: float, source: str) -> Column:
    """Entities of all matches of a pattern."""
    none = F.array().cast(f"array<{ENTITY}>")
    found = lambda hits: F.zip_with(hits, places(c, pattern, hits), lambda h, p: entity(h, label, p, confidence, source))
    return T.let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, found(hits)).otherwise(none))


def symptoms(c: Column) -> Column:
    """Every occurrence of each keyword, inside words too, in the keywords' order."""
    low = F.lower(c)
    present = F.filter(_strings(lexicon.SYMPTOMS), lambda k: F.contains(low, k))

    def every(k):
        gaps = F.split(low, F.concat(F.lit("\\Q"), k, F.lit("\\E")), -1)
        pieces = T.let(gaps, lambda own: F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda g: F.struct(F.length(g).alias("g"), F.length(k).alias("h"))))
        return F.transform(T.starts_of(pieces), lambda s: entity(F.substring(c, s + 1, F.length(k)), "SYMPTOM", s, 0.9))

    return F.flatten(F.transform(present, every))


def procedures(c: Column) -> Column:
    """The first occurrence of each keyword."""
    low = F.lower(c)
    present = F.filter(_strings(lexicon.PROCEDURES), lambda k: F.contains(low, k))
    return F.transform(present, lambda k: entity(F.substring(c, F.instr(low, k), F.length(k)), "PROCEDURE", F.instr(low, k) - 1, 0.9))


def dates(c: Column) -> Column:
    return matched(c, DATES, "DATE", 0.95, "rule")


def gazetteer(c: Column) -> Column:
    """Diseases and drugs by name, longest first; the stand-in for a model."""
    return F.concat(matched(c, words_pattern(DISEASE_NAMES), "DISEASE", 0.85, "gazetteer"), matched(c, words_pattern(DRUG_NAMES), "DRUG", 0.85, "gazetteer"))


def deduplicate(found: Column) -> Column:
    """The first of equal texts of a label, without those of one character."""
    key = lambda x: F.struct(F.lower(T.strip(x["text"])), x["label"])
    return F.filter(first_of_each(found, key), lambda x: F.length(T.strip(x["text"])) > 1)


def entities(c: Column, threshold: float = 0.5, tagged: Column | None = None) -> Column:
    """All entities: those of a tagger (the gazetteer by default), symptoms, procedures, dates;
    without repeats and without those under the threshold."""
    found = F.concat(gazetteer(c) if tagged is None else tagged.cast(f"array<{ENTITY}>"), symptoms(c), procedures(c), dates(c))
    return F.filter(deduplicate(found), lambda x: x["confidence"] >= threshold)


def relabel(label: Column) -> Column:
    """A model's label as the label used here; unknown ones pass."""
    known = F.create_map(*[F.lit(x) for kv in lexicon.ENTITY_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(known, label), label)


def chunks(text: str, most: int) -> list[tuple[int, str]]:
    """Stretches of at most `most` characters for a model, with their offsets: the rest if it is
    short enough, else up to the last full stop, else as many as fit."""
    stretch = re.compile(rf"(?s).{{1,{most}}}\Z|.{{1,{most - 1}}}\.|.{{1,{most}}}")
    return [(m.start(), m.group()) for m in stretch.finditer(text)]


def tag_with(reports: DataFrame, load, most: int = 1500) -> DataFrame:
    """report_id, text and `tagged`: the entities of a model. load() gives, once in each worker, a
    function from a text to (text, label, start, end, confidence) of each entity."""

    def run(batches):
        import pandas as pd

        tag = load()
        for batch in batches:
            out = []
            for text in batch["text"]:
                own = [(t, label, s + at, e + at, float(p)) for at, part in chunks(text or "", most) for t, label, s, e, p in tag(part)]
                out.append([{"text": t, "label": label, "start": s, "end": e, "confidence": p, "source": "model"} for t, label, s, e, p in own])
            yield pd.DataFrame({"report_id": batch["report_id"], "text": batch["text"], "tagged": out})

    kind = dict(reports.dtypes)["report_id"]
    tagged = reports.select("report_id", "text").mapInPandas(run, f"report_id {kind}, text string, tagged array<{ENTITY}>")
    return tagged.withColumn("tagged", F.transform("tagged", lambda x: x.withField("label", relabel(x["label"]))))


def first_of_each(rows: Column, key) -> Column:
    """The first item of each key, in order: keys are sorted with their places, so many items take
    little more than few."""
    places = lambda own: F.array_sort(F.transform(own, lambda r, i: F.struct(key(r).alias("k"), i.alias("i"))))
    new = lambda keys: F.filter(keys, lambda x, j: x["k"].isNotNull() & ((j == 0) | ~x["k"].eqNullSafe(F.get(keys, j - 1)["k"])))
    return T.let(rows, lambda own: F.transform(F.array_sort(F.transform(T.let(places(own), new), lambda x: x["i"])), lambda i: F.get(own, i)))


def medications(c: Column) -> Column:
    """Array of name, dosage, frequency, route, raw_text: the first of each name that can be a drug."""
    part = [F.regexp_extract_all(c, F.lit(MEDICATION), F.lit(g)) for g in range(6)]
    units = F.create_map(*[F.lit(x) for kv in lexicon.UNITS.items() for x in kv])
    rows = F.transform(
        F.arrays_zip(*[p.alias(n) for p, n in zip(part, ("raw", "name", "dose", "unit", "frequency", "route"))]),
        lambda r: F.struct(
            T.strip(r["name"]).alias("name"), F.concat(r["dose"], F.lit(" "), F.coalesce(F.element_at(units, F.lower(r["unit"])), F.lower(r["unit"]))).alias("dosage"),
            r["frequency"].alias("frequency"), r["route"].alias("route"), T.strip(r["raw"]).alias("raw_text"),
        ),
    )
    low = lambda r: F.lower(r["name"])
    kept = F.filter(rows, lambda r: ~low(r).isin(lexicon.NOT_DRUGS) & (F.length(r["name"]) >= 4) & ~F.element_at(F.split(low(r), r"\s+"), 1).isin(lexicon.NOT_FIRST))
    return first_of_each(kept, low)


def labs(c: Column) -> Column:
    """Array of test_name, value, unit, raw_text: the first of each test."""
    part = [F.regexp_extract_all(c, F.lit(LAB), F.lit(g)) for g in range(4)]
    rows = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(part, ("raw", "test", "value", "unit"))]), lambda r: F.struct(r["test"].alias("test_name"), r["value"].alias("value"), r["unit"].alias("unit"), T.strip(r["raw"]).alias("raw_text")))
    return first_of_each(rows, lambda r: F.lower(r["test_name"]))


def vitals(c: Column, patterns: dict[str, str] = VITALS) -> Column:
    """Array of vital, value of the vitals found, in the patterns' order."""
    rows = F.array(*[F.struct(F.lit(n).alias("vital"), T.strip(F.regexp_extract(c, p, 1)).alias("value")) for n, p in patterns.items()])
    return F.filter(rows, lambda r: r["value"] != "")


def mentioned(c: Column, keywords: list[str]) -> Column:
    """Titles of the keywords in a text, in their own order."""
    low = F.lower(c)
    return F.transform(F.filter(_strings(keywords), lambda k: F.contains(low, k)), T.title)


def of_label(found: Column, label: str) -> Column:
    """Texts of a label, the first spelling of each."""
    own = F.transform(F.filter(found, lambda x: x["label"] == label), lambda x: x["text"])
    return first_of_each(own, F.lower)


def recognise(reports: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Everything about each report in one row: entities, lists by label, medications, labs, vitals."""
    c = F.col("text")
    tagged = F.col("tagged") if "tagged" in reports.columns else None
    rows = reports.withColumn("entities", entities(c, threshold, tagged))
    drugs = F.filter(of_label(F.col("entities"), "DRUG"), lambda d: ~F.lower(d).isin(lexicon.NOT_DRUGS) & (F.length(d) > 2))
    return rows.select(
        "report_id", "text", "entities", of_label(F.col("entities"), "DISEASE").alias("diseases"), drugs.alias("drugs"), mentioned(c, lexicon.SYMPTOMS).alias("symptoms"),
        mentioned(c, lexicon.PROCEDURES).alias("procedures"), of_label(F.col("entities"), "BODY_PART").alias("body_parts"), of_label(F.col("entities"), "DATE").alias("dates"), medications(c).alias("medications"), labs(c).alias("labs"), vitals(c).alias("vitals"),
    )


def summary(found: DataFrame, model: str = "gazetteer") -> DataFrame:
    """The display form of recognised reports as one JSON column."""
    own = F.struct(
        F.size("entities").alias("total_entities"), F.lit(model).alias("model_used"), F.col("diseases"), F.col("drugs"), F.slice("symptoms", 1, 5).alias("symptoms"), F.slice("procedures", 1, 5).alias("procedures"),
        F.transform("medications", lambda m: F.struct(m["name"].alias("name"), m["dosage"].alias("dosage"), m["frequency"].alias("frequency"))).alias("medications_structured"),
        F.transform("labs", lambda x: F.struct(x["test_name"].alias("test"), T.strip(F.concat_ws(" ", x["value"], x["unit"])).alias("value"))).alias("lab_values"),
        F.map_from_entries(F.transform("vitals", lambda v: F.struct(v["vital"], v["value"]))).alias("vitals"),
    )
    return found.select("report_id", F.to_json(own).alias("summary"))


def formatted(found: DataFrame) -> DataFrame:
    """Entities by label as display text: labels in order, each text once."""
    labels = F.array_sort(F.array_distinct(F.transform("entities", lambda x: x["label"])))

    def block(label):
        own = F.array_distinct(F.transform(F.filter("entities", lambda x: x["label"] == label), lambda x: x["text"]))
        return F.concat(label, F.lit(":\n"), F.array_join(F.transform(own, lambda t: F.concat(F.lit("   • "), t)), "\n"))

    text = F.when(F.size("entities") == 0, F.lit("No entities found.")).otherwise(F.array_join(F.transform(labels, block), "\n"))
    return found.select("report_id", text.alias("display"))
