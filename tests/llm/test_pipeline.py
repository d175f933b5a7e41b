"""The pipeline's stages and its whole run, against plain forms of its stages."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from medloom.llm import decontam, langid, linededup, simhash, spm
from medloom.runtime import table

LAST = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def near_copies(texts):
    """Ids that stay: the least of each group that links of fingerprints within the radius and of five-word similarity connect."""
    own = {d: (simhash.fingerprint(t, 5), t.encode().lower().split()) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, (_, w) in own.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            far = (own[a][0] ^ own[b][0]).bit_count()
            if a < b and (far == 0 or far <= simhash.NEAR_RADIUS and len(sets[a] & sets[b]) >= simhash.NEAR * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in texts}


def test_stages_keep_columns_and_take_effect(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, small)
        assert out.columns == (LAST if k == len(P.STAGES) - 1 else list(P.COLUMNS))
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in got.collect()}
        assert set(after) <= set(before) and len(after) == got.count()
        if name == "language":
            found = {r["doc_id"] for r in langid.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= P.LEAST_SCORE}
            assert set(after) == found
        elif name == "lines":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert sum(len(r["text"]) for r in after.values()) < sum(len(r["text"]) for r in before.values())
        elif name == "near_duplicates":
            want = near_copies({d: r["text"] or "" for d, r in before.items()})
            assert set(after) == want and len(after) < len(before)
        elif name == "decontamination":
            gone = {r["doc_id"] for r in decontam.find(docs, table(spark, small, "benchmark")).collect()}
            assert gone and set(after) == set(before) - gone
        else:
            model = spm.model_of(spm.read_model(spm.default_model()))
            assert all(r["ids"] == model.encode(before[d]["text"]) for d, r in list(after.items())[:50])
        docs = got


def test_run_is_the_stages_one_after_another(spark, small):
    docs = table(spark, small, "documents")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = sorted((r["doc_id"], r["ids_sha256"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in P.run(spark, small).collect()) == want


def test_language_rejects_what_has_no_letters(spark, small):
    docs = table(spark, small, "documents")
    odd = spark.createDataFrame([(-1, "12 34", None, None, 5), (-2, None, "en", None, None), (-3, "", "en", None, 0)], docs.schema)
    kept = P.language(spark, docs.union(odd), small)
    assert kept.where("doc_id < 0").count() == 0 and kept.where(F.col("lang").isNull()).count() == 0


def test_odd_rows_at_each_stage(spark, small):
    """Null and repeated ids, equal rows, empty and null texts, another column with a clashing name."""
    docs = table(spark, small, "documents").limit(60)
    one, two = (" ".join(reversed(r["text"].split())) for r in docs.where(F.length("text") > 400).limit(2).collect())
    odd = [(None, one, "en", "s", 1), (None, one, "en", "s", 1), (None, two, None, None, None), (5, "1 2 3", "en", "s", 1), (5, None, "en", None, 0), (None, None, None, None, None), (6, "", None, "s", 0)]
    more = docs.union(spark.createDataFrame(odd, docs.schema))
    for name, stage in P.STAGES:
        for extra in ("_key", "d", "_r1", "k", "fp"):
            out = stage(spark, more.withColumn(extra, F.lit("x")), small)
        last = name == P.STAGES[-1][0]
        assert out.columns == (LAST if last else list(P.COLUMNS))
        got = out.collect()
        assert len(got) <= more.count()
        if name in ("lines", "sentencepiece"):
            assert len(got) == more.count()
        if name == "near_duplicates":
            assert sum(r["doc_id"] is None for r in got) == 2 and len({tuple(r) for r in got}) == len(got)
        if name == "language":
            assert sum(r["doc_id"] is None for r in got) == 3 and not any(r["text"] in (None, "", "1 2 3") for r in got)
        assert stage(spark, more.limit(0), small).count() == 0


def test_without_labels_documents_with_letters_stay(spark, small):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12", None, "s", 1), (3, None, None, None, None)], table(spark, small, "documents").schema)
    assert [r["doc_id"] for r in P.language(spark, docs, small).collect()] == [1]


def test_lines_keep_documents(spark, small):
    docs = table(spark, small, "documents")
    assert P.lines(spark, docs, small).count() == docs.count() == linededup.dedup_lines(docs).count()
