from pyspark.sql import functions as F

from medloom.plans.analysis import Settings, analyse, register
from medloom.sources.notes import notes


def test_tables_and_views(spark, small):
    tables = analyse(notes(spark, small).limit(40).withColumn("report_id", F.col("report_id").cast("string")))
    register(spark, tables)
    assert spark.sql("SELECT count(*) AS n FROM reports_clean").first()["n"] == 40
    for name in tables:
        assert spark.table(name).limit(1).count() == 1, name
    assert tables["metrics"].count() == 40
    assert spark.sql("SELECT max(confidence) AS c FROM icd_matches").first()["c"] <= 1


def test_settings_take_effect(spark):
    reports = spark.createDataFrame([("a", "Pt has gout, zz 5 mg.")], "report_id string, text string")
    own = analyse(reports, Settings(abbreviations={"zz": "sleep"}, load_tagger=lambda: lambda t: [("gout", "B-Disease", 7, 11, 0.9)], codes=(("M10", "Gout", "Musculoskeletal", ["gout"]),), abstractive=F.lit("short text")))
    assert own["reports_clean"].first()["clean_text"] == "Pt has gout, sleep 5 mg."
    assert own["icd_matches"].first()["icd_code"] == "M10"
    assert own["summaries"].first()["abstractive"] == "short text"
    plain = analyse(reports, Settings(expand_abbreviations=False))
    assert plain["reports_clean"].first()["clean_text"] == "Pt has gout, zz 5 mg."
