"""Scalar text functions as column expressions: cleaning, abbreviations, normal forms, counts.

Every function takes and returns Spark columns, so a chain of them stays in one projection. Java's
`(?U)` gives Unicode word and space classes. A null gives null.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from medloom.functions import lexicon

# These patterns decide what is cleaned, so they must be as they are.
ARTIFACTS = r"(?i)Page\s+\d+\s+of\s+\d+|CONFIDENTIAL|[-=_]{4,}|\[\s*\]|\*{3,}"
UNIT_VALUES = r"\d+\.?\d*\s*(?:ng|pg|µg|ug|mEq|mIU|mcg|IU)\s*/\s*(?:mL|L|dL|uL|kg)"
EDGES = r"(?U)^\s+|\s+$"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, wherever and how often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts_of(pieces: Column, stretch: int = 256) -> Column:
    """The place where each match starts, from structs of the length g of the text before it and its
    own length h. Sums run over stretches, so the work stays in proportion to the matches."""

    def step(state, x):
        return F.struct((state["at"] + x["g"] + x["h"]).alias("at"), F.array_append(state["found"], state["at"] + x["g"]).alias("found"))

    def each(state, own):
        found = F.aggregate(own, F.struct(state["at"].alias("at"), F.array().cast("array<int>").alias("found")), step)
        return let(found, lambda f: F.struct(f["at"].alias("at"), F.array_append(state["found"], f["found"]).alias("found")))

    def placed(own):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / stretch).cast("int")), lambda j: F.slice(own, j * stretch + 1, F.lit(stretch)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("found"))
        return F.when(F.size(own) > 0, F.flatten(F.aggregate(parts, start, each, lambda s: s["found"]))).otherwise(F.array().cast("array<int>"))

    return let(pieces, placed)


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, EDGES, "")


def words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(words(c))


def count_sentences(c: Column) -> Column:
    """Runs of sentence ends."""
    return F.regexp_count(c, F.lit("[.!?]+"))


def report_id(c: Column, size: int = 10) -> Column:
    """The first hexadecimal digits of the text's MD5, in upper case."""
    return F.upper(F.substring(F.md5(c.cast("binary")), 1, size))


def remove_artifacts(c: Column) -> Column:
    """Page numbers, dividers, empty boxes and the like become spaces."""
    return F.regexp_replace(c, ARTIFACTS, " ")


def fix_ocr(c: Column) -> Column:
    """Vertical bars are misread capital letters."""
    return F.replace(c, F.lit("|"), F.lit("I"))


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_whitespace(c: Column) -> Column:
    """At most one empty line, single spaces, then tabs to spaces, then stripped."""
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, " {2,}", " ")
    return strip(F.replace(c, F.lit("\t"), F.lit(" ")))


def basic_clean(c: Column) -> Column:
    return clean_whitespace(unix_lines(fix_ocr(remove_artifacts(c))))


def any_of(names) -> str:
    """A pattern for any of the names, the longest first, as a tree by characters: a match tries one
    branch for each character rather than every name."""
    tree: dict = {}
    for name in names:
        node = tree
        for c in name.lower():
            node = node.setdefault(c, {})
        node[""] = {}

    def shown(node: dict) -> str:
        own = [re.escape(c).replace("\\ ", " ") + shown(below) for c, below in sorted(node.items()) if c]
        if not own:
            return ""
        inner = own[0] if len(own) == 1 and "" not in node else "(?:" + "|".join(own) + ")"
        return inner + "?" if "" in node else inner

    return shown(tree)


def abbreviation_pattern(table: dict[str, str]) -> str:
    """One pattern for the whole table, longest first; values with units come first and stay."""
    return rf"(?i){UNIT_VALUES}|\b{any_of(table)}\b"


def expand(c: Column, table: dict[str, str] = lexicon.ABBREVIATIONS) -> Column:
    """Struct of the text with abbreviations written out, in a single pass, and their number.

    It differs from one replacement after another where two abbreviations overlap: the first
    place in the text wins."""
    pattern = abbreviation_pattern(table)
    known = F.from_json(F.lit(json.dumps({k.lower(): v for k, v in table.items()})), "map<string,string>")

    def written(hits):
        full = F.transform(hits, lambda h: F.coalesce(F.element_at(known, F.lower(h)), h))
        text = F.array_join(F.zip_with(F.split(c, pattern, -1), F.concat(full, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        count = F.size(F.filter(hits, lambda h: F.element_at(known, F.lower(h)).isNotNull()))
        some = F.size(hits) > 0
        return F.struct(F.when(some, text).otherwise(c).alias("text"), F.when(some, count).otherwise(F.lit(0)).alias("expanded"))

    return let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), written)


def normalize_vitals(c: Column) -> Column:
    """A blood pressure gets its unit, an oxygen saturation its percent sign."""
    c = F.regexp_replace(c, r"(?i)\bblood pressure\s+(\d{2,3})\s*/\s*(\d{2,3})(?!\s*mmHg)", "blood pressure $1/$2 mmHg")
    # what follows the number up to white space goes, unless it starts with the sign
    return F.regexp_replace(c, r"(?i)\boxygen saturation\s+(\d{2,3}+)(?!%)\S*", "oxygen saturation $1%")


# Laboratory symbols and signs with what they are written out as.
SYMBOLS = [(r"\bNa\+?\b", "Sodium"), (r"\bK\+?\b", "Potassium"), (r"\bCl-?\b", "Chloride"), (r"\bHgb\b", "Hemoglobin"), (r"\bHct\b", "Hematocrit"), (r"\bPlt\b", "Platelets")]
SIGNS = [(r"\b\(\+\)", "(positive)"), (r"\b\(-\)", "(negative)"), (r"(?i)\b\+ve\b", "positive"), (r"(?i)\b-ve\b", "negative")]


def space_doses(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(\d+(?:\.\d+)?)(mg|mcg|g|ml|mEq|IU|mmol)", "$1 $2")


def normalize_temperature(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\w)(\d+\.?\d*)\s*°?\s*([FC])\b(?!\w)", "$1°$2")


def normalize_percent(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(\d+)\s+percent\b(?!\s*%)", "$1%")


def normalize(c: Column) -> Column:
    """Vitals, doses, temperatures, percentages, laboratory symbols and signs in one form."""
    c = normalize_percent(normalize_temperature(space_doses(normalize_vitals(c))))
    for pattern, full in SYMBOLS + SIGNS:
        c = F.regexp_replace(c, pattern, full)
    return c


def truncate(c: Column, most: int = 512) -> Column:
    """The first words, up to the last full stop if more than seven tenths come before it. Those are
    compared as whole numbers: as a double, 0.7 of 350 is under 245."""

    def cut(head):
        stop = F.length(head) - F.instr(F.reverse(head), ".")  # place of the last full stop, from 0
        return F.when((F.instr(head, ".") > 0) & (stop.cast("bigint") * 10 > F.length(head).cast("bigint") * 7), F.substring(head, F.lit(1), stop + 1)).otherwise(F.concat(head, F.lit("...")))

    return let(words(c), lambda own: F.when(F.size(own) <= most, c).otherwise(let(F.array_join(F.slice(own, 1, most), " "), cut)))


def remove_special(c: Column, keep_medical: bool = True) -> Column:
    """Characters beyond words and punctuation become spaces."""
    kept = r"(?U)[^\w\s.,:;!?\-/%+=<>()\[\]]" if keep_medical else r"(?U)[^\w\s.,!?]"
    return clean_whitespace(F.regexp_replace(c, kept, " "))


def is_medical(c: Column, least: int = 20) -> Column:
    """Enough words, and two words that speak for a medical text."""
    low = F.lower(c)
    hits = sum((low.contains(w).cast("int") for w in lexicon.INDICATORS[1:]), low.contains(lexicon.INDICATORS[0]).cast("int"))
    return (count_words(c) >= least) & (hits >= 2)


def title(c: Column) -> Column:
    """Each run of letters with a capital first, as in "Crohn'S" and "Hba1C"."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[^\W\d_]+|[\W\d_]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def split_sentences(c: Column) -> Column:
    """Bulleted items, then sentences that a capital follows, of three words or more; the whole
    text if there are none; nothing for blank texts."""
    items = F.transform(F.split(c, "\n\\s*(?:[-•*]\\s+|\\d+[.)]\\s+)"), strip)
    parts = F.flatten(F.transform(items, lambda i: F.split(i, r"(?<=[.!?])\s+(?=[A-Z])")))
    kept = F.filter(F.transform(parts, strip), lambda p: count_words(p) >= 3)
    return F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(strip(c)))))
