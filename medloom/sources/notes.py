"""Sources and sinks of reports, and notes made up from a table's keys.

Readers give report_id and text; nothing is guessed from a string's length, as a path and a text
have readers of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from medloom.functions import text as T


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as reports: UTF-8, or Latin-1 where a file isn't UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    # a file that isn't UTF-8 doesn't survive the way there and back
    utf8 = F.decode("content", "UTF-8")
    latin = F.decode("content", "ISO-8859-1")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), utf8).otherwise(latin)
    return with_ids(files.select(text.alias("text"), F.col("path").alias("source")))


def read_pdfs(spark: SparkSession, path: str, parser) -> DataFrame:
    """PDF files through a parser given by the caller: bytes of a file to a list of page texts.
    Pages are joined by line ends."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"source": batch["path"], "text": ["\n".join(parser(c)) for c in batch["content"]]})

    return with_ids(files.mapInPandas(run, "source string, text string"))


def uploaded(pasted: DataFrame, uploads: DataFrame, key: str = "report_id") -> DataFrame:
    """Pasted reports (key, text) with uploaded ones (key, content): an upload that isn't empty takes
    the place of the pasted text of its key. Bytes that aren't UTF-8 are left out."""
    own = uploads.select(key, F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("_own"))
    both = pasted.select(key, "text").join(own, key, "full")
    return both.select(key, F.when(F.length(F.trim("_own")) > 0, F.col("_own")).otherwise(F.col("text")).alias("text"))


def with_ids(reports: DataFrame) -> DataFrame:
    """Reports with text and the id that follows from it; empty ones go."""
    return reports.where(F.length("text") > 0).withColumn("report_id", T.report_id(F.col("text")))


def write_json(rows: DataFrame, path: str, indent: bool = False) -> None:
    """A JSON object for each row: one line each, or indented and apart by an empty line."""
    if indent:
        shown = rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("value"))
        shown.write.mode("overwrite").text(path, lineSep="\n\n")
    else:
        rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, indent: bool = False) -> DataFrame:
    """Rows of JSON objects as write_json writes them; with indent, files of one array too."""
    if not indent:
        return spark.read.json(path)
    schema = spark.read.option("multiLine", True).json(path).schema
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n\n")).alias("value")).where(F.trim("value") != "")
    rows = F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", F.lit(f"array<{schema.simpleString()}>"))).otherwise(F.array(F.from_json("value", schema)))
    return objects.select(F.explode(rows).alias("x")).select("x.*")


def write_notes(notes: DataFrame, path: str) -> None:
    """Rendered notes as text files."""
    notes.select("note").write.mode("overwrite").text(path, lineSep="\n\n")


COMPLAINTS = ["Chest pain and shortness of breath.", "Headache for 3 days with nausea.", "Cough and fever since Monday.", "Fatigue, polyuria and polydipsia.", "Pt c/o abdominal pain, n/v.", "Dizziness."]
HISTORY = [
    "The patient was diagnosed with type 2 diabetes mellitus in March.", "He presents with acute chest pain due to coronary artery disease.", "She has a history of htn and copd.",
    "Pt reports SOB with exertion, fever secondary to pneumonia.", "The patient was found to have atrial fibrillation with palpitations related to anxiety.",
]
COURSE = ["Diagnosis of heart failure was made on 03/14/2023.", "Ultrasound and chest x-ray were ordered.", "A stroke was ruled out by computed tomography on Jan 5, 2024.", "Symptoms improved.", "Biopsy confirmed lung cancer, see page 2 of the report."]
DRUGS = [
    "Aspirin 81 mg daily oral", "Metformin 500mg twice", "Lisinopril 10 milligrams once by mouth", "Heparin 5000 units q8h", "Oxygen 2 ml daily", "Started Furosemide 40 mg daily iv", "Warfarin 5 mg daily",
]
MORE_DRUGS = ["Atorvastatin 40 mg weekly", "Aspirin 81 mg", "Insulin 10 units daily subcutaneous", "Normal Saline 500 ml once", "Metoprolol 25.5 mg twice oral"]
VITALS = [
    "Blood pressure 120/80 mmHg, heart rate 88 bpm, temperature 98.6 F", "blood pressure 188/112 mmHg. Heart rate: 104. Oxygen saturation 96, ok. Weight 80 kg",
    "BP 130/85, HR 72 bpm, SpO2 97%, RR 18", "blood pressure 140/90, oxygen saturation 98%, body mass index 27.5, respiratory rate 18",
]
LABS = [
    "Sodium 138 mEq/L, Troponin 2.4 ng/mL, glucose 250 mg/dL", "Hemoglobin 9.1 g/dL. Creatinine of 1.9 mg/dL. Sodium: 140", "HbA1c 9.2%, LDL 160 mg/dL, WBC 14.1 K/uL",
    "Troponin was elevated consistent with myocardial infarction. BNP 900 pg/mL", "INR 2.5, Na+ 138, K 4.1, test (+), culture a+ve",
]
ALLERGY = ["Allergic to penicillin.", "Allergies to sulfa drugs, latex.", "No known problems.", "Intolerance to codeine."]
PLANS = [
    "Started on Aspirin 81 mg for angina. Follow up in 2 weeks.", "Prescribed Lisinopril for hypertension, daily.", "Continue Metformin 500 mg to control diabetes mellitus.",
    "Metoprolol 25 mg for atrial fibrillation. Surgery if needed.", "Plan: refer to cardiology. He was diagnosed with sepsis.", "The patient was given Heparin for deep vein thrombosis.",
]
DIAGNOSES = [
    "1. Hypertension.\n2. Type 2 diabetes mellitus.", "Inferior STEMI.", "- Congestive heart failure\n- Chronic kidney disease stage 3", "Pneumonia and sepsis.", "Stroke, unspecified.", "Asthma exacerbation.", "Obstructive sleep apnea; obesity.",
]
RULES = ["----------", "Page 2 of 9", "[ ] done | seen", "***** CONFIDENTIAL", "\t\ttabs  and   spaces\r\n"]

PIECES = [
    ("CHIEF COMPLAINT: ", COMPLAINTS, 1, "\n"), ("HPI: ", HISTORY, 1, " "), ("", COURSE, 3, "\n"), ("Medications:\n- ", DRUGS, 1, "\n"), ("- ", MORE_DRUGS, 2, "\n"), ("Vital Signs: ", VITALS, 1, "\n"),
    ("LABORATORY RESULTS\n", LABS, 1, ".\n"), ("", RULES, 1, "\n\n\n\n"), ("Allergies\n", ALLERGY, 5, "\n"), ("ASSESSMENT AND PLAN:\n", DIAGNOSES, 1, "\n"), ("", PLANS, 7, "\n"),
]


def made_up(key: Column) -> Column:
    """A note for each key; each seventh has no headers."""
    number = F.coalesce(key.cast("bigint"), F.lit(0))
    out = []
    for head, own, step, tail in PIECES:
        piece = F.element_at(F.array(*[F.lit(x) for x in own]), (F.pmod(number * step + F.floor(number / 5).cast("bigint"), F.lit(len(own))) + 1).cast("int"))
        out += [F.when(number % 7 == 3, F.lit("")).otherwise(F.lit(head)), piece, F.lit(tail)]
    return F.concat(*out)


def made_up_sql(key: str = "doc_id") -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'"
    parts = []
    for head, own, step, tail in PIECES:
        parts.append(f"CASE WHEN {key} % 7 = 3 THEN '' ELSE {quote(head)} END || ([{', '.join(quote(x) for x in own)}])[({key} * {step} + {key} // 5) % {len(own)} + 1] || {quote(tail)}")
    return " || ".join(parts)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id and text of a made-up note for each document."""
    # keys are dealt out first: a file of one row group would make all notes in one task
    keys = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("report_id"))
    return keys.repartition(spark.sparkContext.defaultParallelism).select("report_id", made_up(F.col("report_id")).alias("text"))
