import json

from medloom.streaming import notes as S


def test_counts_by_window(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("a", "Cough and asthma", "2024-01-01T10:05:00"), ("b", "Cough", "2024-01-01T10:50:00"), ("c", "Cough", "2024-01-01T12:10:00")]
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("report_id", "text", "ts"), r))) for r in rows))
    query = S.entity_counts(S.read_stream(spark, str(folder))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = {(r["window"]["start"].hour, r["label"]): r["n"] for r in spark.table("counts").collect()}
    assert got == {(10, "SYMPTOM"): 2, (10, "DISEASE"): 1, (12, "SYMPTOM"): 1}
