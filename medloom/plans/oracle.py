"""DuckDB's SQL for the clinical queries, written apart from the Spark plans.

The steps are common table expressions; every query gets all of them and DuckDB runs those that it
needs. RE2 has no look-around, so places that need one are marked with an underscore first.
"""

from __future__ import annotations

import math
import re

from medloom.functions import lexicon, text as T
from medloom.operators import coding, entities as E, relations as R
from medloom.operators.sections import PATTERN
from medloom.sources.notes import made_up_sql


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    show = lambda x: q(x) if isinstance(x, str) else "NULL" if x is None else repr(x).upper() if isinstance(x, bool) else repr(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names}))"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def strip(c: str) -> str:
    return sub(c, r"^\s+|\s+$", "")


def nwords(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


def title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'), lambda r: upper(r[1]) || r[2:]), '')"


def clean_ws(c: str) -> str:
    return strip(f"replace({sub(sub(c, chr(10) + '{3,}', chr(10) * 2), ' {2,}', ' ')}, chr(9), ' ')")


def basic(c: str) -> str:
    c = f"replace({sub(c, T.ARTIFACTS, ' ')}, '|', 'I')"
    return clean_ws(f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")


_UNITS = [("ng", "n", "g"), ("pg", "p", "g"), ("ug", "u", "g"), ("mEq", "m", "Eq"), ("mIU", "m", "IU"), ("mcg", "m", "cg"), ("IU", "I", "U")]


def guarded(c: str) -> str:
    """Units after a number, broken up so that no abbreviation is found in them."""
    for _, a, b in _UNITS:
        for v, w in (("m", "L"), ("", "L"), ("d", "L"), ("u", "L"), ("k", "g")):
            c = sub(c, rf"(?i)([0-9]\s*)({a})({b})(\s*/\s*)({v})({w})", r"\1\2_Q_\3\4\5_Q_\6")
    return c


#: Letters beyond ASCII that SQL's patterns would take for word ends, written as word characters.
LETTERS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿŒœŠšŽžŁłĄąĆćĘęŃńŚśŹźŻżĞğİıŞş"


def spelt(c: str, back: bool = False) -> str:
    """A text with its letters beyond ASCII as word characters, or back again."""
    for letter in LETTERS:
        one, two = q(letter), q(f"_{ord(letter):x}_")
        c = f"replace({c}, {two if back else one}, {one if back else two})"
    return c


def expanded(c: str) -> str:
    """One replacement after another, the longest abbreviation first."""
    c = guarded(c)
    for k in sorted(lexicon.ABBREVIATIONS, key=len, reverse=True):
        c = sub(c, rf"(?i)\b{re.escape(k)}\b", lexicon.ABBREVIATIONS[k])
    return f"replace({c}, '_Q_', '')"


def expansions(c: str) -> str:
    keys = "|".join(re.escape(k) for k in sorted(lexicon.ABBREVIATIONS, key=len, reverse=True))
    return f"len(regexp_extract_all({guarded(c)}, {q(rf'(?i)\b(?:{keys})\b')}))"


def vitals_normal(c: str) -> str:
    c = sub(c, r"(?i)\b(blood)( pressure\s+\d{2,3}\s*/\s*\d{2}\s*mmHg)", r"\1_\2")
    c = sub(c, r"(?i)\bblood pressure\s+(\d{2,3})\s*/\s*(\d{2})(\d\s*mmHg)", r"blood_ pressure \1/\2 mmHg\3")
    c = sub(c, r"(?i)\bblood pressure\s+(\d{2,3})\s*/\s*(\d{2,3})", r"blood_ pressure \1/\2 mmHg")
    c = sub(c, r"(?i)\b(oxygen)( saturation\s+\d{2,3}%)", r"\1_\2")
    c = sub(c, r"(?i)\boxygen saturation\s+(\d{2,3})\S*", r"oxygen_ saturation \1%")
    return f"replace(replace({c}, '_ pressure', ' pressure'), '_ saturation', ' saturation')"


def normal(c: str) -> str:
    c = vitals_normal(c)
    c = sub(c, r"(?i)(\d+(?:\.\d+)?)(mg|mcg|g|ml|mEq|IU|mmol)", r"\1 \2")
    c = sub(c, r"\b(\d+\.?\d*)\s*°?\s*([FC])\b", r"\1°\2")
    c = sub(c, r"(?i)(\d+)\s+percent\b", r"\1%")
    for pattern, to in T.SYMBOLS + T.SIGNS:
        c = sub(c, pattern, to)
    return c


def truncated(c: str, most: int) -> str:
    own = f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"
    head = f"array_to_string({own}[1:{most}], ' ')"
    stop = f"(length({head}) - instr(reverse({head}), '.'))"
    return f"CASE WHEN len({own}) <= {most} THEN {c} WHEN contains({head}, '.') AND {stop} > length({head}) * 0.7 THEN substr({head}, 1, {stop} + 1) ELSE {head} || '...' END"


def sentences(c: str) -> str:
    items = f"list_transform(string_split_regex({c}, {q(chr(10) + r'\s*(?:[-•*]\s+|\d+[.)]\s+)')}), lambda i: {strip('i')})"
    cut = f"regexp_replace(i, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    kept = f"list_filter(list_transform(flatten(list_transform({items}, lambda i: string_split({cut}, chr(1)))), lambda p: {strip('p')}), lambda p: {nwords('p')} >= 3)"
    return f"CASE WHEN {strip(c)} = '' THEN [] WHEN len({kept}) > 0 THEN {kept} ELSE [{strip(c)}] END"


def hits(c: str, pattern: str) -> str:
    """List of text and start of each match."""
    found, gaps = f"regexp_extract_all({c}, {q(pattern)})", f"string_split_regex({c}, {q(pattern)})"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda g: length(g))), 0)::INT"
    return f"list_transform(range(1, 1 + len({found})), lambda i: {{'text': {found}[i], 'start': {size(gaps + '[1:i]')} + {size(found + '[1:i - 1]')}}})"


def unnested(source: str, keep: str, items: str, name: str) -> str:
    """A row for each item of a list, with its place from 1."""
    return f"SELECT {keep}, unnest({items}) AS {name}, generate_subscripts({items}, 1) AS k FROM {source}"


def keyword_rows(own: list[str]) -> str:
    return values([(i, k) for i, k in enumerate(own)], "ord, keyword")


def table_rows(table: dict[str, list[str]], names: str) -> str:
    return values([(i, k, j, v) for i, (k, own) in enumerate(table.items()) for j, v in enumerate(own)], names)


def _rule(pattern: str, c: str, group: int) -> str:
    return f"regexp_extract_all({c}, {q(pattern)}, {group})"


def _rules() -> str:
    """A row for each match of a relation rule, with keys of its order."""
    out = []
    low, own = "lower(s)", "s"
    for p, pattern in enumerate(R.ALLERGY):
        out.append(f"SELECT report_id, sent, 0 AS rule, {p} AS pat, m.k, 'Patient' AS e1, 'ALLERGIC_TO' AS rel, {title(strip('m.x'))} AS e2, 0.95 AS conf, substr(s, 1, 100) AS evidence FROM rsent, LATERAL (SELECT unnest({_rule(pattern, low, 1)}) AS x, generate_subscripts({_rule(pattern, low, 1)}, 1) AS k) m WHERE length({title(strip('m.x'))}) > 2")
    for p, pattern in enumerate(R.TREATS):
        out.append(f"SELECT report_id, sent, 1, {p}, m.k, {strip('m.a')}, 'TREATS', {title(strip('m.b'))}, 0.88, substr(s, 1, 120) FROM rsent, LATERAL (SELECT unnest({_rule(pattern, own, 1)}) AS a, unnest({_rule(pattern, own, 2)}) AS b, generate_subscripts({_rule(pattern, own, 1)}, 1) AS k) m WHERE length({strip('m.a')}) > 3 AND length({strip('m.b')}) > 3")
    for r, (pattern, rel, conf) in ((2, (R.INDICATES, "INDICATES", 0.9)), (3, (R.SYMPTOM_OF, "SYMPTOM_OF", 0.85))):
        out.append(f"SELECT report_id, sent, {r}, 0, m.k, {title(strip('m.a'))}, '{rel}', {title(strip('m.b'))}, {conf}, substr(s, 1, 120) FROM rsent, LATERAL (SELECT unnest({_rule(pattern, low, 1)}) AS a, unnest({_rule(pattern, low, 2)}) AS b, generate_subscripts({_rule(pattern, low, 1)}, 1) AS k) m")
    for p, pattern in enumerate(R.DIAGNOSED):
        out.append(f"SELECT report_id, sent, 4, {p}, m.k, 'Patient', 'DIAGNOSED_WITH', {title(strip('m.x'))}, 0.92, substr(s, 1, 120) FROM rsent, LATERAL (SELECT unnest({_rule(pattern, low, 1)}) AS x, generate_subscripts({_rule(pattern, low, 1)}, 1) AS k) m WHERE length({strip('m.x')}) > 5 AND {nwords(strip('m.x'))} <= 5")
    return " UNION ALL ".join(out)


_SETS = [(i, c, " ".join(sorted(set(coding.tokens(t)) - set(lexicon.STOP_WORDS))), alias) for i, (c, t, alias) in enumerate((c, t, a) for c, d, _, own in lexicon.CODES for t, a in [(d, False), *((x, True) for x in own)]) if set(coding.tokens(t)) - set(lexicon.STOP_WORDS)]
_WORDS = "regexp_extract_all(lower(diagnosis), '\\b[a-z]+\\b')"
_CODE_TEXTS = [(i, c, d.lower() + " " + " ".join(a)) for i, (c, d, _, a) in enumerate(lexicon.CODES)]
_STOP = "[" + ", ".join(q(w) for w in lexicon.STOP_WORDS) + "]"


def coding_steps(source: str) -> dict[str, str]:
    """Steps that code the distinct diagnoses of a step with a column diagnosis."""
    own = strip(sub(f"regexp_replace({strip('lower(diagnosis)')}, '\\s+', ' ', 'g')", r",?\s*(unspecified|nos|nec|not otherwise specified)$", ""))
    tried = [f"SELECT diagnosis, {i + 1} AS step, replace(own, {q(x)}, '') AS alias FROM named" for i, x in enumerate(lexicon.QUALIFIERS)]
    return {
        "named": f"SELECT DISTINCT diagnosis, {own} AS own FROM {source}",
        "aliases": "SELECT * FROM " + values(list(lexicon.alias_codes().items()), "alias, code"),
        "tried": "SELECT diagnosis, 0 AS step, own AS alias FROM named UNION ALL " + " UNION ALL ".join(tried),
        "exact": "SELECT diagnosis, arg_min(code, step) AS code, CASE WHEN min(step) = 0 THEN 0.97 ELSE 0.90 END AS conf, CASE WHEN min(step) = 0 THEN 'exact' ELSE 'exact_trimmed' END AS kind FROM tried JOIN aliases USING (alias) GROUP BY diagnosis",
        "sets": "SELECT ord, code, string_split(words, ' ') AS words, is_alias FROM " + values(_SETS, "ord, code, words, is_alias"),
        "asked": f"SELECT diagnosis, list_filter(list_distinct({_WORDS}), lambda w: NOT list_contains({_STOP}, w)) AS own, {_WORDS} AS words FROM named",
        "jaccard": "SELECT diagnosis, ord, code, len(list_intersect(own, words2)) AS b, len(list_distinct(list_concat(own, words2))) AS u, is_alias AND len(list_intersect(own, words2)) = len(own) AS whole FROM (SELECT a.diagnosis, a.own, s.ord, s.code, s.words AS words2, s.is_alias FROM asked a, sets s WHERE len(a.own) > 0)",
        "scored": "SELECT diagnosis, ord, code, CASE WHEN whole THEN least(b::DOUBLE / u * 1.3, 1.0) ELSE b::DOUBLE / u END AS score FROM jaccard WHERE b > 0",
        "fuzzy": "SELECT diagnosis, code, round(least(0.65 + score * 0.23, 0.88), 3) AS conf, 'fuzzy' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY score DESC, ord) AS r FROM scored) WHERE r = 1 AND score >= 0.35",
        "texts": "SELECT ord, code, text, regexp_extract_all(text, '\\b[a-z]+\\b') AS words, list_distinct(string_split(text, ' ')) AS spaced FROM " + values(_CODE_TEXTS, "ord, code, text"),
        "tf": "SELECT ord, code, w, count(*)::DOUBLE / any_value(n) AS tf FROM (SELECT ord, code, unnest(words) AS w, len(words) AS n FROM texts) GROUP BY ord, code, w",
        "df": f"SELECT w, ln({len(_CODE_TEXTS) + 1}.0 / (count(t.ord) + 1)) + 1 AS idf FROM (SELECT DISTINCT w FROM tf) v LEFT JOIN (SELECT ord, unnest(spaced) AS s FROM texts) t ON t.s = v.w GROUP BY w",
        "weights": "SELECT ord, code, w, tf * idf AS x FROM tf JOIN df USING (w)",
        "norms": "SELECT ord, sqrt(sum(x * x)) AS norm FROM weights GROUP BY ord",
        "terms": "SELECT diagnosis, w, count(*)::DOUBLE / any_value(n) AS x FROM (SELECT diagnosis, unnest(words) AS w, len(words) AS n FROM asked) WHERE w IN (SELECT w FROM df) GROUP BY diagnosis, w",
        "qnorm": "SELECT diagnosis, sqrt(sum(x * x)) AS norm FROM terms GROUP BY diagnosis",
        "cosine": "SELECT t.diagnosis, w.ord, any_value(w.code) AS code, sum(t.x * w.x) / (any_value(qnorm.norm) * any_value(norms.norm)) AS score FROM terms t JOIN weights w USING (w) JOIN qnorm USING (diagnosis) JOIN norms ON norms.ord = w.ord GROUP BY t.diagnosis, w.ord",
        "semantic": "SELECT diagnosis, code, round(least(0.40 + score * 0.35, 0.78), 3) AS conf, 'semantic' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY score DESC, ord) AS r FROM cosine) WHERE r = 1 AND score >= 0.20",
        "info": "SELECT * FROM " + values([(c, d, k) for c, d, k, _ in lexicon.CODES], "code, description, category"),
        "best": "SELECT n.diagnosis, coalesce(e.code, f.code, s.code, '') AS icd_code, coalesce(e.conf, f.conf, s.conf, 0.0)::DOUBLE AS confidence, coalesce(e.kind, f.kind, s.kind, 'no_match') AS match_type FROM named n LEFT JOIN exact e USING (diagnosis) LEFT JOIN fuzzy f USING (diagnosis) LEFT JOIN semantic s USING (diagnosis)",
        "coded": "SELECT diagnosis, icd_code, confidence, match_type, coalesce(description, 'No mapping found') AS description, coalesce(category, 'Unknown') AS category FROM best LEFT JOIN info ON info.code = best.icd_code",
    }


_PRIORITY = values(list(lexicon.SECTION_PRIORITY.items()), "name, weight")
_KEYWORDS = " + ".join(f"contains(low, {q(k)})::INT" for k in lexicon.CLINICAL_KEYWORDS)
_LAB = [f"regexp_extract_all(text, {q(E.LAB)}, {g})" for g in range(4)]
_MED = [f"regexp_extract_all(text, {q(E.MEDICATION)}, {g})" for g in range(6)]
_UNIT = "CASE lower(unit) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lexicon.UNITS.items()) + " ELSE lower(unit) END"
_BOTH = "(contains({a}, {b}) OR contains({b}, {a}))"
_NOT = ", ".join(q(w) for w in lexicon.NOT_DRUGS)
_FIRST = ", ".join(q(w) for w in lexicon.NOT_FIRST)
_GAZ = [(0, "DISEASE", E.words_pattern(E.DISEASE_NAMES)), (1, "DRUG", E.words_pattern(E.DRUG_NAMES))]
_KEYS = "report_id, layer, k1, k2, k3, k4, k5"

STEPS = {
    "notes": f"SELECT doc_id AS report_id, {made_up_sql()} AS text FROM documents",
    "sents": f"SELECT report_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS position FROM (SELECT report_id, {sentences('text')} AS l FROM notes)",
    "heads": f"SELECT report_id, text, list_transform(regexp_extract_all(text, {q(PATTERN.replace('(?imd)', '(?im)'))}, 1), lambda h: lower({strip('h')})) AS names, list_transform(string_split_regex(text, {q(PATTERN.replace('(?imd)', '(?im)'))})[2:], lambda b: {strip('b')}) AS bodies FROM notes",
    "pairs": "SELECT report_id, unnest(names) AS name, unnest(bodies) AS body, generate_subscripts(names, 1) AS k FROM heads WHERE len(names) > 0",
    "merged": "SELECT report_id, name, min(k) AS first, arg_max(body, k) AS body FROM pairs WHERE body <> '' GROUP BY report_id, name",
    "secs": f"SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY first) - 1 AS ord, name, body FROM merged UNION ALL SELECT report_id, 0, 'full_report', {strip('text')} FROM heads WHERE len(names) = 0",
    "seclists": f"SELECT report_id, ord, name, body, {sentences('body')} AS l FROM secs",
    "secsents": "SELECT report_id, ord, name, len(l) AS total, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS position FROM seclists",
    "factors": f"SELECT report_id, ord, s.name, total, position, sentence, {nwords('sentence')}::DOUBLE AS n, position::DOUBLE / total AS place, lower(sentence) AS low, coalesce(p.weight, 0.5)::DOUBLE AS weight FROM secsents s LEFT JOIN {_PRIORITY} p ON p.name = s.name",
    "scores": f"SELECT report_id, ord, name, position, sentence, weight, round(least(({_KEYWORDS}) / 3.0::DOUBLE, 1.0) * 0.40::DOUBLE + least(len(regexp_extract_all(sentence, '\\d+\\.?\\d*')) / 5.0::DOUBLE, 1.0) * 0.20::DOUBLE + weight * 0.20::DOUBLE + CASE WHEN place <= 0.15 OR place >= 0.85 THEN 0.8 WHEN place <= 0.30 THEN 0.6 ELSE 0.3 END::DOUBLE * 0.10::DOUBLE + CASE WHEN n BETWEEN 8 AND 35 THEN 1.0 WHEN n < 8 THEN n / 8.0 ELSE greatest(0.3, 35.0 / n) END::DOUBLE * 0.10::DOUBLE, 4) AS score FROM factors WHERE n >= 5",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY report_id, ord ORDER BY score DESC, position) AS r, count(*) OVER (PARTITION BY report_id, ord) AS c FROM scores",
    "kept": "SELECT report_id, ord, name, weight, position, sentence FROM ranked WHERE r <= greatest(1, least(6, floor(c * CASE WHEN weight >= 0.8 THEN 0.5 ELSE 0.3 END)::INT))",
    "secsums": f"SELECT report_id, ord, name, weight, string_agg(sentence, ' ' ORDER BY position) AS summary FROM kept GROUP BY ALL UNION ALL SELECT report_id, ord, s.name, coalesce(p.weight, 0.5), l[1] FROM seclists s LEFT JOIN {_PRIORITY} p ON p.name = s.name WHERE len(l) > 0 AND len(list_filter(l, lambda x: {nwords('x')} >= 5)) = 0",
    "extracts": "SELECT n.report_id, n.text, coalesce(string_agg(summary, ' ' ORDER BY weight DESC, ord) FILTER (weight >= 0.5), '') AS extractive FROM notes n LEFT JOIN secsums USING (report_id) GROUP BY ALL",
    "symhits": f"SELECT report_id, 2 AS layer, ord AS k1, i AS k2, substr(text, 1 + s, length(keyword)) AS etext, 'SYMPTOM' AS label, s AS start, 0.9 AS conf, 'rule' AS source FROM (SELECT report_id, text, ord, keyword, i, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(keyword))::INT AS s FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT report_id, text, ord, keyword, string_split(lower(text), keyword) AS parts FROM notes, {keyword_rows(lexicon.SYMPTOMS)} k)))",
    "prochits": f"SELECT report_id, 3 AS layer, ord AS k1, 1 AS k2, substr(text, instr(lower(text), keyword), length(keyword)) AS etext, 'PROCEDURE' AS label, (instr(lower(text), keyword) - 1)::INT AS start, 0.9 AS conf, 'rule' AS source FROM notes, {keyword_rows(lexicon.PROCEDURES)} k WHERE contains(lower(text), keyword)",
    "datehits": f"SELECT report_id, 4 AS layer, 0 AS k1, k AS k2, x.text AS etext, 'DATE' AS label, x.start AS start, 0.95 AS conf, 'rule' AS source FROM ({unnested('notes', 'report_id', hits('text', E.DATES), 'x')})",
    "gazhits": " UNION ALL ".join(f"SELECT report_id, {i} AS layer, 0 AS k1, k AS k2, x.text AS etext, '{label}' AS label, x.start AS start, 0.85 AS conf, 'gazetteer' AS source FROM ({unnested('notes', 'report_id', hits('text', p), 'x')})" for i, label, p in _GAZ),
    "allhits": "SELECT * FROM gazhits UNION ALL SELECT * FROM symhits UNION ALL SELECT * FROM prochits UNION ALL SELECT * FROM datehits",
    "ents": f"SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY layer, k1, k2) - 1 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY report_id, lower({strip('etext')}), label ORDER BY layer, k1, k2) AS r FROM allhits WHERE length({strip('etext')}) > 1) WHERE r = 1",
    "diseases": "SELECT report_id, etext AS disease, row_number() OVER (PARTITION BY report_id ORDER BY seq) AS ord FROM ents WHERE label = 'DISEASE'",
    "drugs": f"SELECT report_id, etext AS drug, seq FROM ents WHERE label = 'DRUG' AND length(etext) > 2 AND lower(etext) NOT IN ({_NOT})",
    "symptoms": f"SELECT report_id, ord, {title('keyword')} AS symptom FROM notes, {keyword_rows(lexicon.SYMPTOMS)} k WHERE contains(lower(text), keyword)",
    "procs": f"SELECT report_id, ord, {title('keyword')} AS procedure FROM notes, {keyword_rows(lexicon.PROCEDURES)} k WHERE contains(lower(text), keyword)",
    "medrows": f"SELECT report_id, unnest({_MED[0]}) AS raw, unnest({_MED[1]}) AS name, unnest({_MED[2]}) AS dose, unnest({_MED[3]}) AS unit, unnest({_MED[4]}) AS frequency, unnest({_MED[5]}) AS route, generate_subscripts({_MED[0]}, 1) AS k FROM notes",
    "meds": f"SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY k) - 1 AS seq, name, dose || ' ' || {_UNIT} AS dosage, coalesce(frequency, '') AS frequency, coalesce(route, '') AS route, {strip('raw')} AS raw_text FROM (SELECT *, row_number() OVER (PARTITION BY report_id, lower(name) ORDER BY k) AS r FROM medrows WHERE lower(name) NOT IN ({_NOT}) AND length(name) >= 4 AND string_split_regex(lower(name), '\\s+')[1] NOT IN ({_FIRST})) WHERE r = 1",
    "labrows": f"SELECT report_id, unnest({_LAB[0]}) AS raw, unnest({_LAB[1]}) AS test_name, unnest({_LAB[2]}) AS value, unnest({_LAB[3]}) AS unit, generate_subscripts({_LAB[0]}, 1) AS k FROM notes",
    "labs": f"SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY k) - 1 AS seq, test_name, value, unit, {strip('raw')} AS raw_text FROM (SELECT *, row_number() OVER (PARTITION BY report_id, lower(test_name) ORDER BY k) AS r FROM labrows) WHERE r = 1",
    "rsent": f"SELECT report_id, x AS s, k AS sent FROM (SELECT report_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT report_id, list_filter(list_transform(string_split_regex(text, '[.!?\\n]'), lambda x: {strip('x')}), lambda x: {nwords('x')} >= 4) AS l FROM notes))",
    "rules": _rules(),
    "druglist": "SELECT report_id, name, min(o) AS ord FROM (SELECT report_id, name, seq AS o FROM meds UNION ALL SELECT report_id, drug, 100000 + seq FROM drugs) GROUP BY report_id, name",
    "kbtreats": f"SELECT report_id, 1 AS layer, d.ord AS k1, t.j AS k2, 0 AS k3, 0 AS k4, 0 AS k5, {title('d.name')} AS e1, 'TREATS' AS rel, {title('t.v')} AS e2, 0.80 AS conf, 'kb' AS source FROM druglist d JOIN {table_rows(lexicon.DRUG_DISEASES, 'i, key, j, v')} t ON t.key = lower({strip('d.name')})",
    "kbsym": f"SELECT s.report_id, 2 AS layer, s.ord AS k1, d.ord AS k2, t.j AS k3, 0 AS k4, 0 AS k5, {title('s.symptom')} AS e1, 'SYMPTOM_OF' AS rel, {title('d.disease')} AS e2, 0.85 AS conf, 'kb' AS source FROM symptoms s JOIN {table_rows(lexicon.SYMPTOM_DISEASES, 'i, key, j, v')} t ON t.key = lower(s.symptom) JOIN diseases d ON d.report_id = s.report_id AND {_BOTH.format(a='lower(t.v)', b='lower(d.disease)')}",
    "kblab": f"SELECT l.report_id, 3 AS layer, l.seq AS k1, t.i AS k2, t.j AS k3, 0 AS k4, 0 AS k5, {strip(chr(39).join(['l.test_name || ', ' ', ' || l.value || ', ' ', ' || l.unit']))} AS e1, 'INDICATES' AS rel, {title('t.v')} AS e2, 0.82 AS conf, 'kb' AS source FROM labs l JOIN {table_rows(lexicon.LAB_DISEASES, 'i, key, j, v')} t ON {_BOTH.format(a='t.key', b='lower(l.test_name)')}",
    "kbcomp": f"SELECT d.report_id, 4 AS layer, d.ord AS k1, t.i AS k2, t.j AS k3, 0 AS k4, 0 AS k5, {title('t.v')} AS e1, 'POTENTIAL_COMPLICATION_OF' AS rel, {title('d.disease')} AS e2, 0.65 AS conf, 'kb' AS source FROM diseases d JOIN {table_rows(lexicon.COMPLICATIONS, 'i, key, j, v')} t ON {_BOTH.format(a='t.key', b='lower(d.disease)')}",
    "allrels": "SELECT report_id, 0 AS layer, sent AS k1, rule AS k2, pat AS k3, k AS k4, 0 AS k5, e1, rel, e2, conf, 'rule' AS source FROM rules UNION ALL SELECT * FROM kbtreats UNION ALL SELECT * FROM kbsym UNION ALL SELECT * FROM kblab UNION ALL SELECT * FROM kbcomp",
    "rels": f"SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY conf DESC, layer, k1, k2, k3, k4) - 1 AS seq, e1 AS entity1, rel AS relation, e2 AS entity2, conf::DOUBLE AS confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY report_id, lower(e1), rel, lower(e2) ORDER BY layer, k1, k2, k3, k4) AS r FROM allrels WHERE lower(e1) <> lower(e2)) WHERE r = 1",
}


def query(select: str, more: dict[str, str] | None = None) -> str:
    steps = STEPS | (more or {})
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in steps.items()) + "\n" + select
