"""Relations by sentence rules and by a knowledge base, made in the row: no shuffle.

The knowledge base is a constant of some two hundred pairs, folded into literals; names meet it by
equality or by one containing the other, inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from medloom.functions import lexicon, text as T
from medloom.operators.coding import literal
from medloom.operators.entities import first_of_each

RELATION = "struct<entity1:string,relation:string,entity2:string,confidence:double,source:string,evidence:string,entity1_type:string,entity2_type:string>"
FIELDS = ["entity1", "relation", "entity2", "confidence", "source", "evidence", "entity1_type", "entity2_type"]
# The patterns of the sentence rules.
END = r"(?:\.|,|;|$)"
ALLERGY = [r"allerg(?:ic to|y to|ies to|y:)\s+([A-Za-z\s,]+?)(?:\s*[\(\[]|\.|\,|\;|$)", r"(?:intolerant of|intolerance to)\s+([A-Za-z\s]+?)(?:\.|\,|\;|$)"]
TREATS = [
    r"(?:started|initiated|prescribed|given|administered)\s+(?:on\s+)?([A-Z][a-zA-Z]+)\s+(?:\d+\s*\w+\s+)?(?:for|to treat)\s+([a-z][a-z\s]+?)" + END,
    r"([A-Z][a-zA-Z]+)\s+(?:\d+\s*\w+\s+)?(?:for|indicated for|used for)\s+([a-z][a-z\s]+?)" + END,
    r"continue\s+([A-Z][a-zA-Z]+).*?(?:for|to control|to manage)\s+([a-z][a-z\s]+?)" + END,
]
INDICATES = (
    r"(troponin|hba1c|hemoglobin a1c|bnp|creatinine|wbc|glucose|ldl)\s+(?:was\s+)?(?:critically\s+)?(?:elevated|raised|high|increased|abnormal|of\s+[\d\.]+\s*\w+)\s+"
    r"(?:indicating|consistent with|confirming|suggesting)\s+([a-z][a-z\s]+?)" + END
)
SYMPTOM_OF = (
    r"(chest pain|shortness of breath|dyspnea|nausea|diaphoresis|palpitations|syncope|fatigue|weakness|edema|fever|cough|headache)\s+"
    r"(?:due to|secondary to|caused by|in the setting of|consistent with|related to)\s+([a-z][a-z\s]+?)" + END
)
DIAGNOSED = [r"(?:diagnosed with|diagnosis of|confirmed)\s+([a-z][a-z\s]+?)" + END, r"([a-z][a-z\s]+?)\s+(?:was confirmed|was diagnosed|is confirmed)"]


def rule_sentences(c: Column) -> Column:
    """Sentences for the rules: cut at every end sign, decimals too; of four words or more."""
    return F.filter(F.transform(F.split(c, r"[.!?\n]"), T.strip), lambda s: T.count_words(s) >= 4)


def relation(one, name: str, two, confidence: float, source: str, evidence, kinds=("", "")) -> Column:
    return F.struct(one.alias("entity1"), F.lit(name).alias("relation"), two.alias("entity2"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), evidence.alias("evidence"), F.lit(kinds[0]).alias("entity1_type"), F.lit(kinds[1]).alias("entity2_type")).cast(RELATION)


def _pairs(s: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(s, F.lit(pattern), F.lit(2)).alias("b"))


def allergies(s: Column) -> Column:
    low = F.lower(s)
    hits = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in ALLERGY])
    names = F.filter(F.transform(hits, lambda h: T.title(T.strip(h))), lambda n: F.length(n) > 2)
    return F.transform(names, lambda n: relation(F.lit("Patient"), "ALLERGIC_TO", n, 0.95, "rule", F.substring(s, 1, 100)))


def treatments(s: Column) -> Column:
    hits = F.concat(*[_pairs(s, p) for p in TREATS])
    kept = F.filter(hits, lambda h: (F.length(T.strip(h["a"])) > 3) & (F.length(T.strip(h["b"])) > 3))
    return F.transform(kept, lambda h: relation(T.strip(h["a"]), "TREATS", T.title(T.strip(h["b"])), 0.88, "rule", F.substring(s, 1, 120)))


def lab_indications(s: Column) -> Column:
    return F.transform(_pairs(F.lower(s), INDICATES), lambda h: relation(T.title(T.strip(h["a"])), "INDICATES", T.title(T.strip(h["b"])), 0.90, "rule", F.substring(s, 1, 120)))


def symptom_causes(s: Column) -> Column:
    return F.transform(_pairs(F.lower(s), SYMPTOM_OF), lambda h: relation(T.title(T.strip(h["a"])), "SYMPTOM_OF", T.title(T.strip(h["b"])), 0.85, "rule", F.substring(s, 1, 120)))


def diagnoses(s: Column) -> Column:
    low = F.lower(s)
    hits = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in DIAGNOSED])
    names = F.filter(F.transform(hits, lambda h: T.title(T.strip(h))), lambda n: (F.length(n) > 5) & (T.count_words(n) <= 5))
    return F.transform(names, lambda n: relation(F.lit("Patient"), "DIAGNOSED_WITH", n, 0.92, "rule", F.substring(s, 1, 120)))


RULES = {"allergic": allergies, "treats": treatments, "indicates": lab_indications, "symptom_of": symptom_causes, "diagnosed": diagnoses}


def by_rules(c: Column) -> Column:
    """Relations of all rules, sentence by sentence."""
    return F.flatten(F.transform(rule_sentences(c), lambda s: F.concat(*[f(s) for f in RULES.values()])))


def _contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _known(table: dict[str, list[str]]) -> Column:
    return literal([{"key": k, "values": v} for k, v in table.items()], "array<struct<key:string,values:array<string>>>")


def kb_treats(names: Column) -> Column:
    """Drugs by name and the diseases they treat."""
    table = literal(lexicon.DRUG_DISEASES, "map<string,array<string>>")
    own = F.array_distinct(names)
    each = lambda n: F.transform(F.coalesce(F.element_at(table, T.strip(F.lower(n))), F.array().cast("array<string>")), lambda d: relation(T.title(n), "TREATS", T.title(d), 0.80, "kb", F.lit(""), ("DRUG", "DISEASE")))
    return F.flatten(F.transform(own, each))


def kb_symptoms(symptoms: Column, diseases: Column) -> Column:
    """Symptoms and those of the report's diseases that they speak for."""
    table = literal(lexicon.SYMPTOM_DISEASES, "map<string,array<string>>")

    def each(s):
        known = F.coalesce(F.element_at(table, T.strip(F.lower(s))), F.array().cast("array<string>"))
        pairs = F.transform(diseases, lambda d: F.transform(F.filter(known, lambda k: _contains(F.lower(k), F.lower(d))), lambda k: relation(T.title(s), "SYMPTOM_OF", T.title(d), 0.85, "kb", F.lit(""), ("SYMPTOM", "DISEASE"))))
        return F.flatten(pairs)

    return F.flatten(F.transform(symptoms, each))


def kb_labs(labs: Column) -> Column:
    """Laboratory values and what their tests indicate."""

    def each(lab):
        value = T.strip(F.concat_ws(" ", lab["test_name"], lab["value"], lab["unit"]))
        rows = F.filter(_known(lexicon.LAB_DISEASES), lambda r: _contains(r["key"], T.strip(F.lower(lab["test_name"]))))
        return F.flatten(F.transform(rows, lambda r: F.transform(r["values"], lambda d: relation(value, "INDICATES", T.title(d), 0.82, "kb", F.lit(""), ("LAB_VALUE", "DISEASE")))))

    return F.flatten(F.transform(labs, each))


def kb_complications(diseases: Column) -> Column:
    """Possible complications of the report's diseases, mentioned or not."""

    def each(disease):
        rows = F.filter(_known(lexicon.COMPLICATIONS), lambda r: _contains(r["key"], T.strip(F.lower(disease))))
        return F.flatten(F.transform(rows, lambda r: F.transform(r["values"], lambda x: relation(T.title(x), "POTENTIAL_COMPLICATION_OF", T.title(disease), 0.65, "kb", F.lit(""), ("DISEASE", "DISEASE")))))

    return F.flatten(F.transform(diseases, each))


def deduplicate(found: Column) -> Column:
    """The first of equal triples; none from a thing to itself."""
    key = lambda r: F.struct(F.lower(r["entity1"]), r["relation"], F.lower(r["entity2"]))
    return F.filter(first_of_each(found, key), lambda r: F.lower(r["entity1"]) != F.lower(r["entity2"]))


def extract(found: DataFrame, parsed: Column | None = None) -> DataFrame:
    """report_id and relations of recognised reports, the surest first and then as found. `parsed`
    may hold the relations of a dependency parser; they come after the rules'."""
    names = F.concat(F.transform("medications", lambda m: m["name"]), F.col("drugs"))
    layers = [by_rules(F.col("text")), kb_treats(names), kb_symptoms(F.col("symptoms"), F.col("diseases")), kb_labs(F.col("labs")), kb_complications(F.col("diseases"))]
    if parsed is not None:
        layers.insert(1, parsed.cast(f"array<{RELATION}>"))
    order = lambda own: F.array_sort(F.transform(own, lambda r, i: F.struct((-r["confidence"]).alias("k"), i.alias("i"), r.alias("r"))))
    return found.select("report_id", F.transform(T.let(deduplicate(F.concat(*layers)), order), lambda x: x["r"]).alias("relations"))


def relation_rows(extracted: DataFrame) -> DataFrame:
    # inline keeps the optimizer from computing the array once for each field that is read
    return extracted.select("report_id", F.inline(F.transform("relations", lambda r, i: F.struct(i.alias("seq"), *[r[c].alias(c) for c in FIELDS]))))


def bucket(name: Column) -> Column:
    """The group of a relation in a report's result; diagnoses have none."""
    own = {"SYMPTOM_OF": "symptom_of", "TREATS": "treats", "TREATED_BY": "treated_by", "INDICATES": "indicates", "CAUSED_BY": "caused_by", "COMPLICATION_OF": "complication_of", "POTENTIAL_COMPLICATION_OF": "complication_of", "MONITORS": "monitors", "ALLERGIC_TO": "allergic_to", "CONTRAINDICATES": "contraindicates"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), name)


def triplets(rows: DataFrame) -> DataFrame:
    """Display form: rounded confidence, colour, arrow."""
    colours = F.create_map(*[F.lit(x) for kv in lexicon.COLOURS.items() for x in kv])
    return rows.select("report_id", "seq", F.round("confidence", 2).alias("confidence"), F.coalesce(F.element_at(colours, F.col("relation")), F.lit("#CCCCCC")).alias("colour"), F.concat("entity1", F.lit("  ──["), "relation", F.lit("]──►  "), "entity2").alias("arrow"))


def top(extracted: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` relations of each kind, then each pair of names once."""

    def of_kind(k):
        own = F.slice(F.filter("relations", lambda r: r["relation"] == k), 1, most)
        return first_of_each(own, lambda r: F.struct(F.lower(r["entity1"]), F.lower(r["entity2"])))

    kinds = F.array_distinct(F.transform("relations", lambda r: r["relation"]))
    return extracted.select("report_id", F.explode(F.flatten(F.transform(kinds, of_kind))).alias("r")).select("report_id", "r.relation", "r.entity1", "r.entity2", "r.confidence", "r.source")
