"""Golden cases of the clinical operators, quirks included."""

import pytest
from pyspark.sql import functions as F

from medloom.functions import lexicon, text as T
from medloom.operators import coding as C, entities as E, relations as R, sections as S, summaries as U
from medloom.plans import oracle as O
from medloom.sources import notes as N


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (T.clean_whitespace, "\n a\n\n\n\nb  c\td  ", "a\n\nb c d"),
        (T.basic_clean, "Page 2 of 9 a|b [ ] ---- x\r\ny", "aIb x\ny"),
        (T.basic_clean, "══ rule ══", "══ rule ══"),
        (T.count_words, " a b  c ", 3),
        (T.count_words, "", 0),
        (T.count_sentences, "Hi... ok?! x.", 3),
        (T.title, "crohn's hba1c c-reactive", "Crohn'S Hba1C C-Reactive"),
        (T.normalize_vitals, "blood pressure 188/112 mmHg", "blood pressure 188/11 mmHg2 mmHg"),
        (T.normalize_vitals, "blood pressure 120/80", "blood pressure 120/80 mmHg"),
        (T.normalize_vitals, "Oxygen saturation 96, ok", "oxygen saturation 96% ok"),
        (T.normalize_vitals, "oxygen saturation 100% on air", "oxygen saturation 100% on air"),
        (T.normalize, "Na+ 138", "Sodium+ 138"),
        (T.normalize, "12 percent and 500mg at 98.6 F", "12% and 500 mg at 98.6°F"),
        (T.normalize, "HbA1c a(+) (-)", "HbA1c a(positive) (-)"),
        (lambda c: T.truncate(c, 3), "a b c d", "a b c..."),
        (lambda c: T.truncate(c, 3), "one two three. four", "one two three."),
        (lambda c: T.truncate(c, 9), "  as it   is ", "  as it   is "),
        (lambda c: T.report_id(c, 10), "x", "9DD4E46126"),
        (T.remove_special, "a#b 5% é", "a b 5% é"),
        (T.split_sentences, "One two three. Four five six.\n- seven eight nine\n2) ten", ["One two three.", "Four five six.", "seven eight nine"]),
        (T.split_sentences, "Short.", ["Short."]),
        (T.split_sentences, "  ", []),
        (T.basic_clean, None, None),
    ],
)
def test_text(spark, function, text, expected):
    assert value(spark, function, text) == expected


@pytest.mark.parametrize(
    "text, expected, count",
    [
        ("Pt c/o SOB", "patient complains of shortness of breath", 3),
        ("w/ fever", "w/ fever", 0),
        ("WBC 14 K/uL", "white blood cell count 14 potassium/uL", 2),
        ("troponin 2.4 ng/mL", "troponin 2.4 ng/mL", 0),
        ("éor or", "éor operating room", 1),
        ("", "", 0),
    ],
)
def test_expand(spark, text, expected, count):
    got = value(spark, T.expand, text)
    assert (got["text"], got["expanded"]) == (expected, count)


def test_expand_takes_a_table(spark):
    assert value(spark, lambda c: T.expand(c, {"zz": "sleep"}), "zz or")["text"] == "sleep or"


def test_sections(spark):
    text = "lost\nPLAN: first\nHPI\none\nPlanned: second\nROS:\n"
    got = value(spark, S.sections, text)
    assert [(s["name"], s["body"]) for s in got] == [("plan", "ned: second"), ("hpi", "one")]
    assert [(s["name"], s["body"]) for s in value(spark, S.sections, " no headers ")] == [("full_report", "no headers")]


def test_process_drops_empty_reports(spark):
    got = S.process(spark.createDataFrame([("", "a"), (None, "b"), ("BP 120/80", None)], "text string, report_id string")).collect()
    assert [(r["report_id"], r["clean_text"]) for r in got] == [(T_ID, "blood pressure 120/80 mmHg")]


T_ID = __import__("hashlib").md5(b"BP 120/80").hexdigest()[:10].upper()


def test_symptoms_inside_words_and_every_time(spark):
    got = value(spark, E.symptoms, "Headache, ache. Cough cough")
    assert [(x["text"], x["start"], x["end"]) for x in got] == [("Headache", 0, 8), ("Cough", 16, 21), ("cough", 22, 27), ("ache", 4, 8), ("ache", 10, 14)]


def test_procedures_once(spark):
    assert [(x["text"], x["start"]) for x in value(spark, E.procedures, "Biopsy and biopsy")] == [("Biopsy", 0)]


def test_dates(spark):
    assert [x["text"] for x in value(spark, E.dates, "on 3/14/23, 03-14-2023 and March 5, 2024 or Feb. 2 2020")] == ["3/14/23", "03-14-2023", "March 5, 2024", "Feb. 2 2020"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Aspirin 81 mg daily oral", [("Aspirin", "81 mg", "daily", "oral")]),
        ("Metformin 500 milligrams by mouth", [("Metformin", "500 mg", "", "")]),
        ("Started Heparin 5000 units", []),
        ("Oxygen 2 ml, Zinc 5 mg", []),
        ("Aspirin 81 mg then ASPIRIN 5 mg", [("Aspirin", "81 mg", "", "")]),
        ("aspirin 81 mg", []),
    ],
)
def test_medications(spark, text, expected):
    assert [(m["name"], m["dosage"], m["frequency"], m["route"]) for m in value(spark, E.medications, text)] == expected


def test_labs(spark):
    got = value(spark, E.labs, "Sodium: 138, sodium 140 mEq/L, Sodium 1; creatinine of 1.9 mg/dL")
    assert [(x["test_name"], x["value"], x["unit"]) for x in got] == [("sodium", "140", "mEq/L"), ("creatinine", "1.9", "mg/dL")]


def test_vitals(spark):
    text = "Blood pressure: 120/80 mmHg, SpO2 97%, weight 80 kg, Ht 170 cm"
    assert [(v["vital"], v["value"]) for v in value(spark, E.vitals, text)] == [("Blood Pressure", "120/80"), ("Weight", "80 kg")]
    with_units = lambda c: E.vitals(c, E.VITALS_WITH_UNITS)
    assert [(v["vital"], v["value"]) for v in value(spark, with_units, text)] == [("Blood Pressure", "120/80 mmHg"), ("Oxygen Saturation", "97%"), ("Weight", "80 kg"), ("Height", "80")]


def test_entities_are_distinct_and_sure(spark):
    got = value(spark, E.entities, "Asthma, asthma and cough. Aspirin for ASTHMA.")
    assert [(x["text"], x["label"]) for x in got] == [("Asthma", "DISEASE"), ("Aspirin", "DRUG"), ("cough", "SYMPTOM")]
    assert value(spark, lambda c: E.entities(c, 0.95), "Asthma and cough") == []
    assert all(0 <= x["confidence"] <= 1 and x["start"] < x["end"] for x in got)


def test_model_hook(spark):
    def load():
        return lambda text: [(m, "B-Disease", text.index(m), text.index(m) + len(m), 0.7) for m in ["gout"] if m in text]

    reports = spark.createDataFrame([(1, "has gout and cough"), (2, None)], "report_id int, text string")
    got = {r["report_id"]: r for r in E.recognise(E.tag_with(reports, load)).collect()}
    assert got[1]["diseases"] == ["gout"] and got[1]["symptoms"] == ["Cough"]
    assert E.chunks("aa. bb. cc", 5) == [(0, "aa."), (3, " bb."), (7, " cc")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The patient is allergic to penicillin, latex.", [("Patient", "ALLERGIC_TO", "Penicillin")]),
        ("ALLERGIES: Penicillin and more words", []),
        ("She was started on Lisinopril for hypertension, daily", [("Lisinopril", "TREATS", "Hypertension")]),
        ("Troponin was elevated consistent with myocardial infarction", [("Troponin", "INDICATES", "Myocardial Infarction")]),
        ("He has chest pain due to angina pectoris", [("Chest Pain", "SYMPTOM_OF", "Angina Pectoris")]),
        ("She was diagnosed with heart failure, again", [("Patient", "DIAGNOSED_WITH", "Heart Failure")]),
        ("gout was confirmed", []),
    ],
)
def test_rules(spark, text, expected):
    got = value(spark, lambda c: R.deduplicate(R.by_rules(c)), text)
    assert [(r["entity1"], r["relation"], r["entity2"]) for r in got] == expected


def test_relations_rank_and_layers(spark):
    reports = spark.createDataFrame([(1, "He was started on Aspirin for angina, daily.\nAspirin 81 mg, COPD and cough.")], "report_id int, text string")
    rows = R.relation_rows(R.extract(E.recognise(reports))).collect()
    assert [r["confidence"] for r in rows] == sorted((r["confidence"] for r in rows), reverse=True)
    triples = [(r["entity1"].lower(), r["relation"], r["entity2"].lower()) for r in rows]
    assert len(set(triples)) == len(triples)
    assert ("aspirin", "TREATS", "angina") in triples and ("aspirin", "TREATS", "stroke prevention") in triples
    assert ("cough", "SYMPTOM_OF", "copd") in triples
    assert not any(r["entity2"] == "Copd" and r["relation"].startswith("POTENTIAL") for r in rows)


@pytest.mark.parametrize(
    "name, code, kind",
    [
        ("Hypertension, unspecified", "I10", "exact"), ("diabetes type", "E13.65", "exact_trimmed"), ("stemi", "I21.9", "exact"), ("urosepsis", "A41.51", "exact"),
        ("heart failure chronic", "I50.9", "fuzzy"), ("type 1", "E11.9", "fuzzy"), ("xyz", "", "no_match"), ("", "", "no_match"), ("mi", "I21.9", "exact"),
    ],
)
def test_codes(spark, name, code, kind):
    got = C.coded(spark.createDataFrame([(name,)], "diagnosis string")).first()
    assert (got["icd_code"], got["match_type"]) == (code, kind) and 0 <= got["confidence"] <= 1


def test_written_codes_of_known_problems(spark):
    gold = {"inferior stemi": "I21.19", "uncontrolled diabetes": "E11.65", "hypertension": "I10", "hyperlipidemia": "E78.5", "obstructive sleep apnea": "G47.33", "ischemic stroke": "I63.9", "atrial fibrillation": "I48.91"}
    got = C.coded(spark.createDataFrame([(n,) for n in gold], "diagnosis string")).collect()
    assert {r["diagnosis"]: r["icd_code"] for r in got} == gold


def test_map_reports_skips_short_names_and_keeps_unmatched(spark):
    found = spark.createDataFrame([(1, ["mi", "gout", "gout", "Asthma"]), (2, [])], "report_id int, diseases array<string>")
    got = {(r["report_id"], r["diagnosis"], r["icd_code"]) for r in C.map_reports(found).collect()}
    assert got == {(1, "gout", ""), (1, "Asthma", "J45.909")}


def test_search_keeps_order_and_limit(spark):
    assert [r["icd_code"] for r in C.search(spark, "Diabetes", 3).collect()] == ["E11.9", "E11.65", "E11.40"]


def test_scores_are_bounded_and_choice_keeps_order(spark):
    text = "Acute chest pain with troponin 2.4 and glucose 250 was seen here today. The weather was rather nice on that day. He was diagnosed with sepsis and started on antibiotic treatment."
    got = value(spark, U.plain_extract, text)
    assert got == text
    scores = value(spark, lambda c: U.scored(T.split_sentences(c), F.lit("plan")), text)
    assert all(0 <= s["score"] <= 1 for s in scores) and [s["position"] for s in scores] == [0, 1, 2]


def test_note_has_its_blocks(spark):
    reports = spark.createDataFrame([(1, "Chief Complaint: Cough.\nPlan: Aspirin 81 mg daily. Rest at home for days.")], "report_id int, text string")
    note = U.clinical_note(E.recognise(reports), "2024-01-01 00:00")
    assert "Generated: 2024-01-01 00:00" in note.first()["note"] and "Chief Complaint: Cough." in note.first()["note"]
    assert [r["block"] for r in U.note_blocks(note).collect()] == U.BLOCKS


def test_empty_tables(spark):
    none = spark.createDataFrame([], "report_id int, text string")
    found = E.recognise(none)
    for frame in (S.section_rows(none), found, R.relation_rows(R.extract(found)), C.map_reports(found), U.summarise(found), E.summary(found)):
        assert frame.count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("déjà vu".encode())
    (tmp_path / "in" / "b.txt").write_bytes("déjà vu!".encode("latin-1"))
    (tmp_path / "in" / "c.txt").write_bytes(b"")
    reports = N.read_texts(spark, str(tmp_path / "in"))
    assert sorted(r["text"] for r in reports.collect()) == ["déjà vu", "déjà vu!"]
    N.write_json(reports.select("report_id", "text"), str(tmp_path / "json"))
    assert {r["text"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {"déjà vu", "déjà vu!"}
    pages = N.read_pdfs(spark, str(tmp_path / "in" / "a.txt"), lambda content: ["page 1", "page 2"])
    assert pages.first()["text"] == "page 1\npage 2"
    N.write_notes(spark.createDataFrame([("n",)], "note string"), str(tmp_path / "notes"))
    (tmp_path / "table.csv").write_text("zz,sleep\nzz,rest\n")
    assert lexicon.read_pairs(spark, str(tmp_path / "table.csv")) == {"zz": "rest"}


def test_tables_are_whole():
    from medloom.functions import lexicon

    assert len(lexicon.ABBREVIATIONS) == 234 and len(lexicon.alias_codes()) == 296
    assert lexicon.ABBREVIATIONS["mg"] == "milligrams" and lexicon.alias_codes()["urosepsis"] == "A41.51"
    assert "n/v/d" in lexicon.ABBREVIATIONS and "brain attack" in lexicon.alias_codes()


@pytest.mark.parametrize("indent", [False, True])
def test_json_there_and_back(spark, tmp_path, indent):
    rows = spark.createDataFrame([("a", 1, ["x", "y"]), ("b é", 2, []), ("c\n\nd", 3, ["{"])], "name string, n bigint, own array<string>").coalesce(1)
    N.write_json(rows, str(tmp_path / "j"), indent)
    got = N.read_json(spark, str(tmp_path / "j"), indent)
    assert sorted((r["name"], r["n"], r["own"]) for r in got.collect()) == sorted(map(tuple, rows.collect()))


def test_strict_reports_fail_on_empty_text(spark):
    rows = spark.createDataFrame([("1", "some text"), ("2", "")], "report_id string, text string")
    assert S.process(rows).count() == 1
    with pytest.raises(Exception, match="empty"):
        S.process(rows, strict=True).collect()


def test_tables_are_whole():
    assert len(lexicon.ABBREVIATIONS) == 234 and {"aids", "bipap", "fev1", "n/v/d", "picc", "ugib"} <= {k.lower() for k in lexicon.ABBREVIATIONS}
    aliases = [a.lower() for _, _, _, own in lexicon.CODES for a in own]
    assert len(lexicon.CODES) == 80 and len(aliases) >= 296
    assert {"hf", "acute mi", "hypercholesterolemia", "cerebral infarction", "chronic renal failure", "gastroesophageal reflux", "mdd", "blood poisoning"} <= set(aliases)
    assert lexicon.ABBREVIATIONS["n/v/d"] == "nausea vomiting and diarrhea"


def test_many_hits_take_time_in_proportion(spark):
    import time

    rows = spark.createDataFrame([("1", "Aspirin 81 mg daily. fever on 03/14/2023, hypertension. " * 4000)], "report_id string, text string")
    start = time.perf_counter()
    got = E.recognise(rows).collect()[0]
    assert time.perf_counter() - start < 60
    assert {e["text"].lower() for e in got["entities"]} >= {"aspirin", "fever", "hypertension", "03/14/2023"} and len(got["medications"]) == 1


def test_letters_beyond_ascii_are_parts_of_words(spark):
    assert [value(spark, T.expand, t)["text"] for t in ("éPT or PTé", "über Pt")] == ["éPT operating room PTé", "über patient"]


def test_uploads_take_the_place_of_pasted_texts(spark):
    pasted = spark.createDataFrame([("1", "pasted"), ("2", "stays"), ("3", "stays too")], "report_id string, text string")
    uploads = spark.createDataFrame([("1", b"file \xff\xc3\xa9"), ("2", b"  "), ("4", b"alone")], "report_id string, content binary")
    assert {tuple(r) for r in N.uploaded(pasted, uploads).collect()} == {("1", "file é"), ("2", "stays"), ("3", "stays too"), ("4", "alone")}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from medloom import runtime

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda _: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_blocks_are_timed(caplog):
    from medloom.runtime import timed

    with caplog.at_level("DEBUG", "medloom"), timed("block"):
        pass
    assert "block took" in caplog.text


def test_truncation_at_seven_tenths(spark):
    """A full stop at just seven tenths of the head is too early, whatever its length, as in the SQL."""
    import duckdb

    texts = [("x" * stop + "." + "y" * (n - stop - 1) + " z",) for n in range(10, 400, 10) for stop in (7 * n // 10 - 1, 7 * n // 10, 7 * n // 10 + 1)]
    rows = spark.createDataFrame(texts, "text string")
    got = [r[0] for r in rows.select(T.truncate(F.col("text"), 1)).collect()]
    assert got == [t[: t.index(".") + 1] if i % 3 == 2 else t[:-2] + "..." for i, (t,) in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?)", texts)
    assert got == [r[0] for r in con.execute(f"SELECT {O.truncated('text', 1)} FROM texts ORDER BY rowid").fetchall()]
