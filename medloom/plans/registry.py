"""The clinical queries, with the SQL that gives the same rows.

Text queries that need no clinical words read documents as they are; the others read notes made up
from the documents' keys, as documents hold no clinical words. SQL's regular expressions know ASCII
only, so letters beyond it are spelt with word characters where word boundaries matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from medloom.functions import lexicon, text as T
from medloom.operators import coding as C, entities as E, relations as R, sections as S, summaries as U
from medloom.plans import oracle as O
from medloom.runtime import kept, table
from medloom.sources.notes import notes, read_texts  # noqa: F401

FLAGSHIP = "medication_doses"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def on_notes(name: str, sql: str | None, more: dict[str, str] | None = None):
    """Register a function of the made-up notes, with the select that follows the SQL steps."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(notes(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = O.query(sql, more)
        return build

    return add


def on_documents(name: str, sql: str):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(table(spark, sf_dir, "documents"))
        ORACLE_SQL[name] = sql
        return build

    return add


_MAPPED = O.coding_steps("(SELECT disease AS diagnosis FROM diseases)") | {"matches": f"SELECT d.report_id, d.disease AS diagnosis, c.* EXCLUDE (diagnosis) FROM diseases d JOIN coded c ON c.diagnosis = d.disease WHERE length({O.strip('d.disease')}) >= 3"}

# --- texts -----------------------------------------------------------------------------------


@on_documents("report_ids", "SELECT doc_id, upper(substr(md5(text), 1, 10)) AS report_id, upper(substr(md5(text), 1, 12)) AS long_id FROM documents WHERE length(text) > 0")
def report_ids(d: DataFrame) -> DataFrame:
    return d.where(F.length("text") > 0).select("doc_id", T.report_id(F.col("text")).alias("report_id"), T.report_id(F.col("text"), 12).alias("long_id"))


@on_documents("text_counts", f"SELECT doc_id, {O.nwords('text')}::INT AS words, len(regexp_extract_all(text, '[.!?]+'))::INT AS sentences FROM documents")
def text_counts(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.count_words(F.col("text")).alias("words"), T.count_sentences(F.col("text")).alias("sentences"))


@on_documents("truncated_texts", f"SELECT doc_id, {O.truncated('text', 60)} AS head FROM documents")
def truncated_texts(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.truncate(F.col("text"), 60).alias("head"))


@on_documents("document_sentences", f"SELECT doc_id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS position FROM (SELECT doc_id, {O.sentences('text')} AS l FROM documents)")
def document_sentences(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("position", "sentence"))


@on_documents("expanded_documents", f"SELECT doc_id, {O.spelt(O.expanded('t'), True)} AS expanded, {O.expansions('t')}::INT AS n FROM (SELECT doc_id, {O.spelt('text')} AS t FROM documents)")
def expanded_documents(d: DataFrame) -> DataFrame:
    return d.withColumn("e", T.expand(F.col("text"))).select("doc_id", F.col("e.text").alias("expanded"), F.col("e.expanded").alias("n"))


@on_notes("clean_notes", f"SELECT report_id, {O.basic('text')} AS clean FROM notes")
def clean_notes(n: DataFrame) -> DataFrame:
    return n.select("report_id", T.basic_clean(F.col("text")).alias("clean"))


@on_notes("artifact_free_notes", f"SELECT report_id, replace({O.sub('text', T.ARTIFACTS, ' ')}, '|', 'I') AS clean FROM notes")
def artifact_free_notes(n: DataFrame) -> DataFrame:
    return n.select("report_id", T.fix_ocr(T.remove_artifacts(F.col("text"))).alias("clean"))


@on_notes("expanded_notes", f"SELECT report_id, {O.expanded('text')} AS expanded, {O.expansions('text')}::INT AS n FROM notes")
def expanded_notes(n: DataFrame) -> DataFrame:
    return n.withColumn("e", T.expand(F.col("text"))).select("report_id", F.col("e.text").alias("expanded"), F.col("e.expanded").alias("n"))


@on_notes("normal_vitals", f"SELECT report_id, {O.vitals_normal('text')} AS normal FROM notes")
def normal_vitals(n: DataFrame) -> DataFrame:
    return n.select("report_id", T.normalize_vitals(F.col("text")).alias("normal"))


@on_notes("normal_notes", f"SELECT report_id, {O.normal('text')} AS normal FROM notes")
def normal_notes(n: DataFrame) -> DataFrame:
    return n.select("report_id", T.normalize(F.col("text")).alias("normal"))


@on_notes("plain_notes", f"SELECT report_id, {O.clean_ws(O.sub('text', '[^a-zA-Z0-9_[:space:].,:;!?/%+=<>()' + chr(92) + '[' + chr(92) + ']-]', ' '))} AS medical, {O.clean_ws(O.sub('text', '[^a-zA-Z0-9_[:space:].,!?]', ' '))} AS plain FROM notes")
def plain_notes(n: DataFrame) -> DataFrame:
    return n.select("report_id", T.remove_special(F.col("text")).alias("medical"), T.remove_special(F.col("text"), False).alias("plain"))


@on_notes("medical_texts", f"SELECT report_id, {O.nwords('text')} >= 40 AND ({' + '.join(f'contains(lower(text), {O.q(w)})::INT' for w in lexicon.INDICATORS)}) >= 2 AS medical FROM notes")
def medical_texts(n: DataFrame) -> DataFrame:
    return n.select("report_id", T.is_medical(F.col("text"), 40).alias("medical"))


@on_notes("titled_sentences", f"SELECT report_id, position::INT AS position, {O.title('sentence')} AS title FROM sents")
def titled_sentences(n: DataFrame) -> DataFrame:
    return S.sentence_rows(n).select("report_id", "position", T.title(F.col("sentence")).alias("title"))


@on_notes(
    "processed_notes",
    f"SELECT report_id, {O.normal(O.expanded('b'))} AS clean_text, {O.nwords('text')}::INT AS original_word_count, {O.expansions('b')}::INT AS abbreviations_expanded FROM basic",
    {"basic": f"SELECT report_id::VARCHAR AS report_id, text, {O.basic('text')} AS b FROM notes"},
)
def processed_notes(n: DataFrame) -> DataFrame:
    return S.process(n).select("report_id", "clean_text", "original_word_count", "abbreviations_expanded")


# --- sections and sentences ------------------------------------------------------------------


@on_notes("sections", f"SELECT report_id, ord::INT AS ord, name, {O.title(chr(114) + 'eplace(name, ' + O.q('_') + ', ' + O.q(' ') + ')')} AS title, body, {O.nwords('body')}::INT AS word_count FROM secs")
def sections(n: DataFrame) -> DataFrame:
    return S.section_rows(n).drop("sentences")


@on_notes("section_sentences", "SELECT report_id, ord::INT AS ord, name, position::INT AS position, sentence FROM secsents")
def section_sentences(n: DataFrame) -> DataFrame:
    return S.section_rows(n).select("report_id", "ord", "name", F.posexplode("sentences").alias("position", "sentence"))


@on_notes("note_sentences", "SELECT report_id, position::INT AS position, sentence FROM sents")
def note_sentences(n: DataFrame) -> DataFrame:
    return S.sentence_rows(n)


@on_notes(
    "report_statistics",
    f"SELECT report_id, 'text' AS source_type, original_word_count, {O.nwords('clean')}::INT AS cleaned_word_count, n.names AS sections_detected, len({O.sentences('clean')})::INT AS sentence_count, abbreviations_expanded FROM processed JOIN (SELECT report_id, list(name ORDER BY ord) AS names FROM psecs GROUP BY 1) n USING (report_id)",
    {
        "basic": f"SELECT report_id::VARCHAR AS report_id, text, {O.basic('text')} AS b FROM notes",
        "processed": f"SELECT report_id, {O.normal(O.expanded('b'))} AS clean, {O.nwords('text')}::INT AS original_word_count, {O.expansions('b')}::INT AS abbreviations_expanded FROM basic",
        "pheads": O.STEPS["heads"].replace("text", "clean").replace("FROM notes", "FROM processed"),
        "ppairs": O.STEPS["pairs"].replace("heads", "pheads"), "pmerged": O.STEPS["merged"].replace("pairs", "ppairs"),
        "psecs": "SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY first) - 1 AS ord, name FROM pmerged UNION ALL SELECT report_id, 0, 'full_report' FROM pheads WHERE len(names) = 0",
    },
)
def report_statistics(n: DataFrame) -> DataFrame:
    return S.statistics(n)


# --- entities --------------------------------------------------------------------------------


def _entity_rows(n: DataFrame, column) -> DataFrame:
    return n.select("report_id", F.explode(column).alias("e")).select("report_id", "e.*")


_ENTITY = "report_id, etext AS text, label, start::INT AS start, (start + length(etext))::INT AS \"end\", conf::DOUBLE AS confidence, source"


@on_notes("symptom_mentions", f"SELECT {_ENTITY} FROM symhits")
def symptom_mentions(n: DataFrame) -> DataFrame:
    return _entity_rows(n, E.symptoms(F.col("text")))


@on_notes("procedure_mentions", f"SELECT {_ENTITY} FROM prochits")
def procedure_mentions(n: DataFrame) -> DataFrame:
    return _entity_rows(n, E.procedures(F.col("text")))


@on_notes("date_mentions", f"SELECT {_ENTITY} FROM datehits")
def date_mentions(n: DataFrame) -> DataFrame:
    return _entity_rows(n, E.dates(F.col("text")))


@on_notes("gazetteer_mentions", f"SELECT {_ENTITY} FROM gazhits")
def gazetteer_mentions(n: DataFrame) -> DataFrame:
    return _entity_rows(n, E.gazetteer(F.col("text")))


@on_notes("entities", f"SELECT seq::INT AS seq, {_ENTITY} FROM ents")
def entities(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.posexplode(E.entities(F.col("text"))).alias("seq", "e")).select("report_id", "seq", "e.*")


@on_notes("confident_entities", f"SELECT {_ENTITY} FROM ents WHERE conf >= 0.9")
def confident_entities(n: DataFrame) -> DataFrame:
    return _entity_rows(n, E.entities(F.col("text"), 0.9))


@on_notes("medications", "SELECT report_id, seq::INT AS seq, name, dosage, frequency, route, raw_text FROM meds")
def medications(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.posexplode(E.medications(F.col("text"))).alias("seq", "m")).select("report_id", "seq", "m.*")


@on_notes("medication_doses", "SELECT name, split_part(dosage, ' ', 2) AS unit, count(*) AS notes, round(sum(split_part(dosage, ' ', 1)::DOUBLE), 3) AS total FROM meds GROUP BY ALL")
def medication_doses(n: DataFrame) -> DataFrame:
    rows = medications(n).withColumn("d", F.split("dosage", " "))
    return rows.groupBy("name", F.get("d", F.lit(1)).alias("unit")).agg(F.count("*").alias("notes"), F.round(F.sum(F.get("d", F.lit(0)).cast("double")), 3).alias("total"))


@on_notes("labs", "SELECT report_id, seq::INT AS seq, test_name, value, unit, raw_text FROM labs")
def labs(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.posexplode(E.labs(F.col("text"))).alias("seq", "m")).select("report_id", "seq", "m.*")


def _vitals_sql(patterns: dict[str, str]) -> str:
    one = [f"SELECT report_id, {O.q(k)} AS vital, {O.strip(f'regexp_extract(text, {O.q(p)}, 1)')} AS value FROM notes" for k, p in patterns.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(one) + ") WHERE value <> ''"


@on_notes("vitals", _vitals_sql(E.VITALS))
def vitals(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.explode(E.vitals(F.col("text"))).alias("v")).select("report_id", "v.*")


@on_notes("vitals_with_units", _vitals_sql(E.VITALS_WITH_UNITS))
def vitals_with_units(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.explode(E.vitals(F.col("text"), E.VITALS_WITH_UNITS)).alias("v")).select("report_id", "v.*")


@on_notes("symptom_lists", "SELECT report_id, string_agg(symptom, '|' ORDER BY ord) AS symptoms FROM symptoms GROUP BY report_id")
def symptom_lists(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.array_join(E.mentioned(F.col("text"), lexicon.SYMPTOMS), "|").alias("symptoms")).where("symptoms <> ''")


@on_notes("procedure_lists", "SELECT report_id, string_agg(procedure, '|' ORDER BY ord) AS procedures FROM procs GROUP BY report_id")
def procedure_lists(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.array_join(E.mentioned(F.col("text"), lexicon.PROCEDURES), "|").alias("procedures")).where("procedures <> ''")


@on_notes("label_lists", "SELECT report_id, label, string_agg(etext, '|' ORDER BY seq) AS texts FROM ents WHERE label IN ('DISEASE', 'DRUG', 'SYMPTOM', 'DATE') GROUP BY report_id, label")
def label_lists(n: DataFrame) -> DataFrame:
    rows = n.select("report_id", E.entities(F.col("text")).alias("e"))
    each = [F.struct(F.lit(x).alias("label"), F.array_join(E.of_label(F.col("e"), x), "|").alias("texts")) for x in ("DISEASE", "DRUG", "SYMPTOM", "DATE")]
    return rows.select("report_id", F.explode(F.array(*each)).alias("x")).select("report_id", "x.*").where("texts <> ''")


@on_notes("drug_lists", "SELECT report_id, string_agg(drug, '|' ORDER BY seq) AS drugs FROM drugs GROUP BY report_id")
def drug_lists(n: DataFrame) -> DataFrame:
    return E.recognise(n).select("report_id", F.array_join("drugs", "|").alias("drugs")).where("drugs <> ''")


@on_notes("entity_counts", "SELECT label, source, count(*) AS n, count(DISTINCT report_id) AS reports FROM ents GROUP BY ALL")
def entity_counts(n: DataFrame) -> DataFrame:
    return entities(n).groupBy("label", "source").agg(F.count("*").alias("n"), F.count_distinct("report_id").alias("reports"))


_OWN = {
    "d": "SELECT report_id, list(disease ORDER BY ord) AS l FROM diseases GROUP BY 1", "g": "SELECT report_id, list(drug ORDER BY seq) AS l FROM drugs GROUP BY 1",
    "s": "SELECT report_id, list(symptom ORDER BY ord)[1:5] AS l FROM symptoms GROUP BY 1", "p": "SELECT report_id, list(procedure ORDER BY ord)[1:5] AS l FROM procs GROUP BY 1",
    "m": "SELECT report_id, list({'name': name, 'dosage': dosage, 'frequency': frequency} ORDER BY seq) AS l FROM meds GROUP BY 1", "b": "SELECT report_id, list({'test': test_name, 'value': trim(value || ' ' || unit)} ORDER BY seq) AS l FROM labs GROUP BY 1",
    "e": "SELECT report_id, count(*) AS l FROM ents GROUP BY 1",
}


@on_notes(
    "entity_summaries",
    "SELECT n.report_id, to_json({'total_entities': coalesce(e.l, 0), 'model_used': 'gazetteer', 'diseases': coalesce(d.l, []), 'drugs': coalesce(g.l, []), 'symptoms': coalesce(s.l, []), 'procedures': coalesce(p.l, []),"
    " 'medications_structured': coalesce(m.l, []), 'lab_values': coalesce(b.l, []), 'vitals': map_from_entries(coalesce(v.l, []))})::VARCHAR AS summary FROM notes n"
    + "".join(f" LEFT JOIN ({sql}) {a} USING (report_id)" for a, sql in _OWN.items())
    + f" LEFT JOIN (SELECT report_id, list({{'k': vital, 'v': value}} ORDER BY o) AS l FROM ({' UNION ALL '.join(f'SELECT report_id, {i} AS o, {O.q(k)} AS vital, {O.strip(f'regexp_extract(text, {O.q(p)}, 1)')} AS value FROM notes' for i, (k, p) in enumerate(E.VITALS.items()))}) WHERE value <> '' GROUP BY 1) v USING (report_id)",
)
def entity_summaries(n: DataFrame) -> DataFrame:
    return E.summary(E.recognise(n))


@on_notes(
    "entity_display",
    "SELECT report_id, string_agg(label || ':' || chr(10) || own, chr(10) ORDER BY label) AS display FROM (SELECT report_id, label, string_agg('   • ' || etext, chr(10) ORDER BY seq) AS own FROM (SELECT report_id, label, etext, min(seq) AS seq FROM ents GROUP BY ALL) GROUP BY ALL) GROUP BY report_id",
)
def entity_display(n: DataFrame) -> DataFrame:
    return E.formatted(E.recognise(n))


# --- summaries -------------------------------------------------------------------------------


@on_notes("sentence_scores", "SELECT report_id, ord::INT AS ord, name, position::INT AS position, score, sentence AS text FROM scores")
def sentence_scores(n: DataFrame) -> DataFrame:
    rows = S.section_rows(n).select("report_id", "ord", "name", F.explode(U.scored(F.col("sentences"), F.col("name"))).alias("s"))
    return rows.select("report_id", "ord", "name", "s.*")


@on_notes("section_summaries", "SELECT report_id, ord::INT AS ord, name, summary FROM secsums")
def section_summaries(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.explode(U.section_summaries(F.col("text"))).alias("s")).select("report_id", "s.ord", "s.name", "s.summary")


@on_notes(
    "top_sentences",
    "SELECT report_id, string_agg(sentence, ' ' ORDER BY position) AS summary FROM top GROUP BY report_id",
    {
        "plain": f"SELECT report_id, position, sentence, {O.nwords('sentence')}::DOUBLE AS n, position::DOUBLE / count(*) OVER (PARTITION BY report_id) AS place, lower(sentence) AS low FROM sents",
        "plainscores": f"SELECT report_id, position, sentence, round(least(({O._KEYWORDS}) / 3.0::DOUBLE, 1.0) * 0.40::DOUBLE + least(len(regexp_extract_all(sentence, '\\d+\\.?\\d*')) / 5.0::DOUBLE, 1.0) * 0.20::DOUBLE + 0.5::DOUBLE * 0.20::DOUBLE + CASE WHEN place <= 0.15 OR place >= 0.85 THEN 0.8 WHEN place <= 0.30 THEN 0.6 ELSE 0.3 END::DOUBLE * 0.10::DOUBLE + CASE WHEN n BETWEEN 8 AND 35 THEN 1.0 WHEN n < 8 THEN n / 8.0 ELSE greatest(0.3, 35.0 / n) END::DOUBLE * 0.10::DOUBLE, 4) AS score FROM plain WHERE n >= 5",
        "top": "SELECT report_id, position, sentence FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, position) AS r, count(*) OVER (PARTITION BY report_id) AS c FROM plainscores) WHERE r <= greatest(3, least(12, floor(c * 0.40)::INT))",
    },
)
def top_sentences(n: DataFrame) -> DataFrame:
    return n.select("report_id", U.plain_extract(F.col("text")).alias("summary"))


_ABSTRACT = O.truncated("extractive", 120)


@on_notes(
    "summaries",
    f"SELECT report_id, extractive, {_ABSTRACT} AS abstractive, {O.nwords('text')}::INT AS original_words, {O.nwords('(' + _ABSTRACT + ')')}::INT AS summary_words FROM extracts",
)
def summaries(n: DataFrame) -> DataFrame:
    return U.summarise(E.recognise(n)).drop("short", "compression")


@on_notes(
    "short_summaries",
    "SELECT n.report_id, concat_ws(' ', 'Primary diagnosis: ' || d.x || '.', 'Presenting symptoms: ' || s.x || '.', 'Medications: ' || m.x || '.') AS short FROM notes n LEFT JOIN (SELECT report_id, disease AS x FROM diseases WHERE ord = 1) d USING (report_id)"
    " LEFT JOIN (SELECT report_id, array_to_string(list(symptom ORDER BY ord)[1:3], ', ') AS x FROM symptoms GROUP BY 1) s USING (report_id) LEFT JOIN (SELECT report_id, array_to_string(list(name ORDER BY seq)[1:3], ', ') AS x FROM meds GROUP BY 1) m USING (report_id)",
)
def short_summaries(n: DataFrame) -> DataFrame:
    return U.summarise(E.recognise(n)).select("report_id", "short")


@on_notes("compression", f"SELECT report_id, round_even({O.nwords('(' + _ABSTRACT + ')')}::DOUBLE / {O.nwords('text')}, 2) AS compression FROM extracts")
def compression(n: DataFrame) -> DataFrame:
    return U.summarise(E.recognise(n)).select("report_id", "compression")


@on_notes(
    "summary_statistics",
    "SELECT c.report_id, original_words, summary_words, round(compression * 100)::INT || '%' AS compression_ratio, trunc((1 - compression) * 100)::INT || '% shorter' AS compression_percent, sections AS sections_summarized, 'extractive-only' AS model_used FROM counted c JOIN (SELECT report_id, count(*)::INT AS sections FROM secsums GROUP BY 1) s USING (report_id)",
    {"counted": f"SELECT report_id, {O.nwords('text')}::INT AS original_words, {O.nwords('(' + _ABSTRACT + ')')}::INT AS summary_words, round_even({O.nwords('(' + _ABSTRACT + ')')}::DOUBLE / {O.nwords('text')}, 2) AS compression FROM extracts"},
)
def summary_statistics(n: DataFrame) -> DataFrame:
    return U.statistics(U.summarise(E.recognise(n)), n.select("report_id", F.size(U.section_summaries(F.col("text"))).alias("sections")))


_BAR, _THIN = "=" * 65, "─" * 40
_SIGNS = " UNION ALL ".join(f"SELECT report_id, {i} AS o, {O.q(k)} AS vital, {O.strip(f'regexp_extract(text, {O.q(p)}, 1)')} AS value FROM notes" for i, (k, p) in enumerate(E.VITALS.items()))
_NOT_REAL = " OR ".join(f"contains(lower(disease), {O.q(w)})" for w in lexicon.NOT_DIAGNOSES)
_SHORT = "(" + O.truncated("x.extractive", 120) + ")"
_PARTS = {
    "signs": f"SELECT report_id, string_agg('  • ' || vital || ': ' || value, chr(10) ORDER BY o) AS t FROM ({_SIGNS}) WHERE value <> '' GROUP BY 1",
    "lablines": "SELECT report_id, string_agg('  • ' || test_name || ': ' || value || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END, chr(10) ORDER BY seq) AS t FROM labs WHERE seq < 8 GROUP BY 1",
    "real": f"SELECT report_id, disease, ord, NOT ({_NOT_REAL}) AND {O.nwords('disease')} <= 6 AS yes, bool_or(NOT ({_NOT_REAL}) AND {O.nwords('disease')} <= 6) OVER (PARTITION BY report_id) AS any_real FROM diseases",
    "shown": "SELECT report_id, disease, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS i FROM real WHERE yes OR NOT any_real AND ord <= 4",
    "dxlines": "SELECT report_id, string_agg('  ' || i || '. ' || disease, chr(10) ORDER BY i) AS t FROM shown WHERE i <= 6 GROUP BY 1",
    "medlines": "SELECT report_id, string_agg('  • ' || name || CASE WHEN dosage <> '' THEN ' ' || dosage ELSE '' END || CASE WHEN frequency <> '' THEN ' ' || frequency ELSE '' END || CASE WHEN route <> '' THEN ' (' || route || ')' ELSE '' END, chr(10) ORDER BY seq) AS t FROM meds WHERE seq < 8 GROUP BY 1",
    "druglines": "SELECT report_id, string_agg('  • ' || drug, chr(10) ORDER BY seq) AS t FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY seq) AS i FROM drugs) WHERE i <= 8 GROUP BY 1",
    "proclines": "SELECT report_id, string_agg('  • ' || procedure, chr(10) ORDER BY ord) AS t FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS i FROM procs) WHERE i <= 5 GROUP BY 1",
    "firstsym": "SELECT report_id, array_to_string(list(symptom ORDER BY ord)[1:4], ', ') AS t FROM symptoms GROUP BY 1",
    "bodies": f"SELECT n.report_id, any_value(body) FILTER (name = 'chief complaint') AS cc, coalesce(any_value(l) FILTER (name = 'history of present illness'), any_value(l) FILTER (name = 'hpi')) AS h, any_value(body) FILTER (name = 'vital signs') AS vs, coalesce(any_value(body) FILTER (name = 'assessment and plan'), any_value(body) FILTER (name = 'assessment')) AS ap FROM notes n LEFT JOIN seclists USING (report_id) GROUP BY 1",
    "made": "SELECT x.report_id, concat_ws(chr(10), "
    + ", ".join(
        [
            f"'{_BAR}'", "'         AUTO-GENERATED CLINICAL NOTE (AI-ASSISTED)'", "'         Generated: 2024-01-01 00:00'", f"'{_BAR}'", "chr(10) || '[S] SUBJECTIVE'", f"'{_THIN}'",
            f"'Chief Complaint: ' || coalesce({O.strip('substr(b.cc, 1, 200)')}, fs.t, 'See original report')",
            f"CASE WHEN len(b.h) > 0 THEN chr(10) || 'History: ' || ({O.truncated('array_to_string(b.h[1:3], chr(32))', 80)}) END",
            "chr(10) || '[O] OBJECTIVE'", f"'{_THIN}'", f"coalesce('Vital Signs:' || chr(10) || si.t, 'Vitals: ' || {O.strip('substr(b.vs, 1, 150)')})", "chr(10) || 'Key Lab Values:' || chr(10) || la.t",
            "chr(10) || '[A] ASSESSMENT'", f"'{_THIN}'", f"coalesce('Diagnoses:' || chr(10) || dx.t, ({O.truncated('b.ap', 100)}))", "chr(10) || '[P] PLAN'", f"'{_THIN}'", "'Medications:' || chr(10) || coalesce(me.t, dr.t)",
            "chr(10) || 'Procedures:' || chr(10) || pr.t", f"CASE WHEN {_SHORT} <> '' THEN chr(10) || '[SUMMARY]' || chr(10) || '{_THIN}' || chr(10) || ({O.truncated(_SHORT, 80)}) END",
            f"chr(10) || '{_BAR}'", "'⚠️  AI-GENERATED NOTE — Requires physician review before use'", "'⚠️  NOT for clinical decision-making without verification'", f"'{_BAR}'",
        ]
    )
    + ") AS note FROM extracts x JOIN bodies b USING (report_id)"
    + "".join(f" LEFT JOIN {t} {a} USING (report_id)" for a, t in (("si", "signs"), ("la", "lablines"), ("dx", "dxlines"), ("me", "medlines"), ("dr", "druglines"), ("pr", "proclines"), ("fs", "firstsym"))),
}


@on_notes("clinical_notes", "SELECT report_id, note FROM made", _PARTS)
def clinical_notes(n: DataFrame) -> DataFrame:
    return U.clinical_note(E.recognise(n), "2024-01-01 00:00")


_PLAIN_BAR = "=" * 60


@on_notes(
    "simple_notes",
    "SELECT n.report_id, concat_ws(chr(10), "
    + ", ".join(
        [
            f"'{_PLAIN_BAR}'", "'AUTO-GENERATED CLINICAL NOTE'", "'Generated: 2024-01-01 00:00'", f"'{_PLAIN_BAR}'", "chr(10) || 'PATIENT: N/A '", "chr(10) || 'CHIEF COMPLAINT:' || chr(10) || '  ' || s.t",
            "chr(10) || 'ASSESSMENT / DIAGNOSES:' || chr(10) || d.t", "chr(10) || 'MEDICATIONS:' || chr(10) || m.t", "chr(10) || 'VITALS:' || chr(10) || v.t", f"chr(10) || '{_PLAIN_BAR}'",
            "'⚠️  AI-GENERATED — Requires physician review before use'", f"'{_PLAIN_BAR}'",
        ]
    )
    + f""") AS note FROM notes n LEFT JOIN (SELECT report_id, array_to_string(list(symptom ORDER BY ord)[1:3], ', ') AS t FROM symptoms GROUP BY 1) s USING (report_id)
    LEFT JOIN (SELECT report_id, string_agg('  ' || i || '. ' || x, chr(10) ORDER BY i) AS t FROM (SELECT report_id, x, row_number() OVER (PARTITION BY report_id ORDER BY encode(x)) AS i FROM (SELECT report_id, diagnosis || '  ' || CASE WHEN icd_code <> '' THEN '[' || icd_code || ']' ELSE '' END AS x FROM matches)) GROUP BY 1) d USING (report_id)
    LEFT JOIN (SELECT report_id, string_agg({O.strip("'  • ' || name || ' ' || dosage || ' ' || frequency")}, chr(10) ORDER BY seq) AS t FROM meds GROUP BY 1) m USING (report_id)
    LEFT JOIN (SELECT report_id, string_agg('  ' || vital || ': ' || value, chr(10) ORDER BY o) AS t FROM ({_SIGNS}) WHERE value <> '' GROUP BY 1) v USING (report_id)""",
    _MAPPED,
)
def simple_notes(n: DataFrame) -> DataFrame:
    found = E.recognise(n)
    own = C.map_reports(found).groupBy("report_id").agg(F.array_sort(F.collect_list(F.concat("diagnosis", F.lit("  "), F.when(F.col("icd_code") != "", F.concat(F.lit("["), "icd_code", F.lit("]"))).otherwise("")))).alias("coded"))
    return U.simple_note(found, own, "2024-01-01 00:00")


@on_notes(
    "note_blocks",
    "SELECT report_id, (row_number() OVER (PARTITION BY report_id ORDER BY g) - 1)::INT AS place, any_value(head) AS block, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT is_head), '') AS body FROM grouped WHERE g > 0 GROUP BY report_id, g",
    _PARTS
    | {
        "lines": "SELECT report_id, unnest(string_split(note, chr(10))) AS line, generate_subscripts(string_split(note, chr(10)), 1) AS k FROM made",
        "useful": "SELECT *, " + " OR ".join(f"starts_with(trim(line), {O.q(b)})" for b in U.BLOCKS) + " AS is_head FROM lines WHERE NOT (" + " OR ".join(f"contains(line, {O.q(b)})" for b in U.BANNERS) + ")",
        "grouped": "SELECT *, sum(is_head::INT) OVER (PARTITION BY report_id ORDER BY k) AS g, CASE WHEN is_head THEN trim(line) END AS head FROM useful",
    },
)
def note_blocks(n: DataFrame) -> DataFrame:
    return U.note_blocks(clinical_notes(n))


# --- relations -------------------------------------------------------------------------------


def _rule_query(name: str, relation: str):
    @on_notes(name, f"SELECT report_id, e1 AS entity1, e2 AS entity2, conf::DOUBLE AS confidence, evidence FROM rules WHERE rel = '{relation}'")
    def build(n: DataFrame) -> DataFrame:
        rows = n.select("report_id", F.explode(R.by_rules(F.col("text"))).alias("r")).select("report_id", "r.*")
        return rows.where(F.col("relation") == relation).select("report_id", "entity1", "entity2", "confidence", "evidence")


for _name, _relation in (("rule_allergies", "ALLERGIC_TO"), ("rule_treatments", "TREATS"), ("rule_lab_indications", "INDICATES"), ("rule_symptom_causes", "SYMPTOM_OF"), ("rule_diagnoses", "DIAGNOSED_WITH")):
    _rule_query(_name, _relation)


@on_notes("rule_sentences", "SELECT report_id, (sent - 1)::INT AS position, s AS sentence FROM rsent")
def rule_sentences(n: DataFrame) -> DataFrame:
    return n.select("report_id", F.posexplode(R.rule_sentences(F.col("text"))).alias("position", "sentence"))


def _kb_query(name: str, step: str, build):
    sql = f"SELECT report_id, e1 AS entity1, rel AS relation, e2 AS entity2, conf::DOUBLE AS confidence FROM {step}"

    @on_notes(name, sql)
    def run(n: DataFrame) -> DataFrame:
        rows = E.recognise(n).select("report_id", F.explode(build()).alias("r"))
        return rows.select("report_id", "r.entity1", "r.relation", "r.entity2", "r.confidence")


_kb_query("known_treatments", "kbtreats", lambda: R.kb_treats(F.concat(F.transform("medications", lambda m: m["name"]), F.col("drugs"))))
_kb_query("known_symptoms", "kbsym", lambda: R.kb_symptoms(F.col("symptoms"), F.col("diseases")))
_kb_query("known_lab_indications", "kblab", lambda: R.kb_labs(F.col("labs")))
_kb_query("known_complications", "kbcomp", lambda: R.kb_complications(F.col("diseases")))


@on_notes("relations", "SELECT report_id, seq::INT AS seq, entity1, relation, entity2, confidence, source FROM rels")
def relations(n: DataFrame) -> DataFrame:
    return R.relation_rows(R.extract(E.recognise(n))).select("report_id", "seq", "entity1", "relation", "entity2", "confidence", "source")


@on_notes("relation_buckets", "SELECT report_id, CASE relation WHEN 'POTENTIAL_COMPLICATION_OF' THEN 'complication_of' ELSE lower(relation) END AS bucket, count(*) AS n FROM rels WHERE relation <> 'DIAGNOSED_WITH' GROUP BY ALL")
def relation_buckets(n: DataFrame) -> DataFrame:
    rows = relations(n).withColumn("bucket", R.bucket(F.col("relation"))).where("bucket is not null")
    return rows.groupBy("report_id", "bucket").agg(F.count("*").alias("n"))


_COLOURS = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.COLOURS.items()) + " ELSE '#CCCCCC' END"


@on_notes("relation_triplets", f"SELECT report_id, seq::INT AS seq, confidence, {_COLOURS} AS colour, entity1 || '  ──[' || relation || ']──►  ' || entity2 AS arrow FROM rels")
def relation_triplets(n: DataFrame) -> DataFrame:
    return R.triplets(R.relation_rows(R.extract(E.recognise(n))))


@on_notes("top_relations", "SELECT report_id, relation, entity1, entity2, confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY report_id, relation, lower(entity1), lower(entity2) ORDER BY seq) AS d FROM (SELECT *, row_number() OVER (PARTITION BY report_id, relation ORDER BY seq) AS r FROM rels) WHERE r <= 8) WHERE d = 1")
def top_relations(n: DataFrame) -> DataFrame:
    return R.top(R.extract(E.recognise(n)))


@on_notes("relation_totals", "SELECT report_id, count(*)::INT AS total, count(DISTINCT relation)::INT AS kinds FROM rels GROUP BY report_id")
def relation_totals(n: DataFrame) -> DataFrame:
    rows = R.extract(E.recognise(n))
    return rows.select("report_id", F.size("relations").alias("total"), F.size(F.array_distinct(F.transform("relations", lambda r: r["relation"]))).alias("kinds")).where("total > 0")


# --- codes -----------------------------------------------------------------------------------

# Names as they may stand in reports: aliases, suffixes, qualifiers, other word orders, other words.
NAMES = [
    "Hypertension", "hypertension, unspecified", "HTN", "  Heart   Failure ", "diabetes type", "asthma disorder", "Parkinson", "heart failure chronic", "Kidney injury", "renal disease of the kidney",
    "acute stroke", "sudden infarction of a cerebral region", "neoplasm in the lung", "type 2 diabetes with nephropathy", "pain in chest", "infection of urinary tract", "stemi", "urosepsis", "mi", "pe",
    "lower extremity vein clot", "colitis nos", "unspecified anxiety", "major episode", "wall of the heart", "gallbladder", "skin rash", "xyz", "", "123", "obesity not otherwise specified", "chronic pancreatitis",
    "breast lump malignant", "inferior wall", "low blood oxygen", "viral lung infection", "dependence on insulin long", "family ischaemic disease", "crohn's disease", "alzheimer dementia",
]
_NAMED = {"asked_names": "SELECT * FROM " + O.values([(n,) for n in NAMES], "diagnosis")}


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "diagnosis string")


def _code_query(name: str, sql: str, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_names(spark))
    ORACLE_SQL[name] = O.query(sql, _NAMED | O.coding_steps("asked_names"))


def _layer(f):
    return lambda d: d.withColumn("m", f(F.col("diagnosis"))).where("m is not null").select("diagnosis", "m.icd_code", "m.confidence", "m.match_type")


for _layer_name, _f in (("exact", C.exact), ("fuzzy", C.fuzzy), ("semantic", C.semantic)):
    _code_query(f"code_{_layer_name}", f"SELECT diagnosis, code AS icd_code, conf::DOUBLE AS confidence, kind AS match_type FROM {_layer_name}", _layer(_f))
_code_query("code_lookup", "SELECT * FROM coded", C.coded)




@on_notes("code_reports", "SELECT * FROM matches", _MAPPED)
def code_reports(n: DataFrame) -> DataFrame:
    return C.map_reports(E.recognise(n))


@on_notes("code_summaries", "SELECT report_id, count(*) FILTER (icd_code <> '') AS mapped_count, count(*) FILTER (icd_code = '') AS unmapped_count, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (icd_code <> '')), ','), '') AS categories, coalesce(array_to_string(list_sort(list(DISTINCT icd_code) FILTER (icd_code <> '')), ','), '') AS codes FROM matches GROUP BY report_id", _MAPPED)
def code_summaries(n: DataFrame) -> DataFrame:
    return C.summarise(C.map_reports(E.recognise(n)))


@on_notes(
    "code_display",
    "SELECT report_id, diagnosis, CASE WHEN icd_code <> '' THEN diagnosis || ' → ' || icd_code || ' ' || repeat('█', floor(confidence * 10)::INT) || repeat('░', 10 - floor(confidence * 10)::INT) || ' (' || match_type || ')' ELSE diagnosis || '  →  No ICD-10 match found' END AS line, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM matches",
    _MAPPED,
)
def code_display(n: DataFrame) -> DataFrame:
    return C.formatted(C.map_reports(E.recognise(n)))


_ROWS = O.values([(i, c, d, k, "|".join(a)) for i, (c, d, k, a) in enumerate(lexicon.CODES)], "ord, icd_code, description, category, aliases")
for _word, _most in (("diabetes", 5), ("heart", 10), ("disease", 3)):
    QUERIES[f"code_search_{_word}"] = lambda spark, sf_dir, w=_word, k=_most: C.search(spark, w, k)
    ORACLE_SQL[f"code_search_{_word}"] = f"SELECT icd_code, description, category, 0.85::DOUBLE AS confidence, 'search' AS match_type FROM {_ROWS} WHERE contains(lower(description), '{_word}') OR len(list_filter(string_split(aliases, '|'), lambda a: contains(lower(a), '{_word}'))) > 0 ORDER BY ord LIMIT {_most}"
QUERIES["code_info"] = lambda spark, sf_dir: C.code_info(spark, "E11.9")
ORACLE_SQL["code_info"] = f"SELECT icd_code, description, category FROM {_ROWS} WHERE icd_code = 'E11.9'"


# --- dashboard -------------------------------------------------------------------------------


@on_notes(
    "report_metrics",
    f"SELECT x.report_id, {O.nwords('x.text')}::INT AS words, {O.nwords('(' + O.truncated('x.extractive', 120) + ')')}::INT AS summary_words, coalesce(e.c, 0)::INT AS entities, coalesce(d.c, 0)::INT AS diagnoses, coalesce(m.c, 0)::INT AS medications, coalesce(r.c, 0)::INT AS relations, coalesce(k.c, 0)::INT AS codes FROM extracts x"
    + "".join(f" LEFT JOIN (SELECT report_id, count(*) AS c FROM {step} GROUP BY 1) {a} USING (report_id)" for a, step in (("e", "ents"), ("d", "diseases"), ("m", "meds"), ("r", "rels")))
    + " LEFT JOIN (SELECT report_id, count(DISTINCT icd_code) AS c FROM matches WHERE icd_code <> '' GROUP BY 1) k USING (report_id)",
    _MAPPED,
)
def report_metrics(n: DataFrame) -> DataFrame:
    """One row of figures for each report. Reports are recognised once: the figures and the lists of
    diagnoses, small rows, are kept before the codes of the diagnoses meet them by report."""
    found = E.recognise(n)
    own = F.size(R.deduplicate(F.concat(R.by_rules(F.col("text")), R.kb_treats(F.concat(F.transform("medications", lambda m: m["name"]), F.col("drugs"))), R.kb_symptoms(F.col("symptoms"), F.col("diseases")), R.kb_labs(F.col("labs")), R.kb_complications(F.col("diseases")))))
    rows = found.select("report_id", T.count_words(F.col("text")).alias("words"), T.count_words(T.truncate(U.extract(F.col("text")), 120)).alias("summary_words"), F.size("entities").alias("entities"), F.size("diseases").alias("diagnoses"), F.size("medications").alias("medications"), own.alias("relations"), F.col("diseases"))
    prepared = kept(rows)
    codes = C.map_reports(prepared.select("report_id", F.col("diseases"))).where("icd_code <> ''").groupBy("report_id").agg(F.count_distinct("icd_code").alias("codes"))
    return prepared.drop("diseases").join(codes, "report_id", "left").withColumn("codes", F.coalesce("codes", F.lit(0)).cast("int"))


TAB_MEDICATIONS, TAB_LABS = 10, 8


@on_notes("tab_medications", f"SELECT report_id, seq::INT AS seq, name, dosage, frequency FROM meds WHERE seq < {TAB_MEDICATIONS}")
def tab_medications(n: DataFrame) -> DataFrame:
    """The first ten medications of each report, as a tab shows them."""
    return n.select("report_id", F.posexplode(F.slice(E.medications(F.col("text")), 1, TAB_MEDICATIONS)).alias("seq", "m")).select("report_id", "seq", "m.name", "m.dosage", "m.frequency")


@on_notes("tab_labs", f"SELECT report_id, seq::INT AS seq, test_name, trim(value || ' ' || unit) AS shown FROM labs WHERE seq < {TAB_LABS}")
def tab_labs(n: DataFrame) -> DataFrame:
    """The first eight laboratory values of each report, as a tab shows them."""
    rows = n.select("report_id", F.posexplode(F.slice(E.labs(F.col("text")), 1, TAB_LABS)).alias("seq", "x"))
    return rows.select("report_id", "seq", "x.test_name", F.trim(F.concat_ws(" ", "x.value", "x.unit")).alias("shown"))


@on_notes("tab_entities", f"SELECT * FROM (SELECT report_id, label, etext AS text, row_number() OVER (PARTITION BY report_id, label ORDER BY seq)::INT AS place FROM ents) WHERE place <= 12")
def tab_entities(n: DataFrame) -> DataFrame:
    """The first twelve entities of each label, as a tab shows them."""
    rows = n.select("report_id", E.entities(F.col("text")).alias("e"))
    labels = F.array_distinct(F.transform("e", lambda x: x["label"]))
    each = F.flatten(F.transform(labels, lambda k: F.transform(F.slice(F.filter("e", lambda x: x["label"] == k), 1, 12), lambda x, i: F.struct(x["label"].alias("label"), x["text"].alias("text"), (i + 1).alias("place")))))
    return rows.select("report_id", F.explode(each).alias("x")).select("report_id", "x.*")
