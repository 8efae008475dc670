"""Answers cut into units: blocks, list lines, records and sentences, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "inc", "ltd", "corp", "co", "dr", "mr", "mrs", "ms", "st", "no", "approx", "u.s")
_MARK = "\x1e"


def sentences(text: Column) -> Column:
    """Units that end in . ! ? or ; before a space; not after an abbreviation, and not before a lower-case word (but after ;)."""
    guarded = F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.(?=\s)", f"$1{_MARK}")
    cut = F.regexp_replace(F.regexp_replace(guarded, r"([.!?][\"')\]]*)\s+(?=[^a-z\s])", "$1\n"), r";\s+", ";\n")
    return _clean(F.split(F.replace(cut, F.lit(_MARK), F.lit(".")), "\n"))


def _clean(units: Column) -> Column:
    trimmed = F.transform(units, lambda u: F.trim(F.regexp_replace(F.regexp_replace(u, r"\s+", " "), r"^(?:[-*•]\s+|\d+[.)]\s+)", "")))
    return F.filter(trimmed, lambda u: F.regexp_replace(u, r"[\s;,.]+", "") != "")


def records(line: Column) -> Column:
    """A line of several records with | inside, between semicolons or brackets; else null."""
    body = F.regexp_replace(line, r"^\[|\]$", "")
    parts = _clean(F.split(body, r"\s*;\s*|\]\s*,?\s*\["))
    return F.when((F.size(parts) >= 2) & (F.size(F.filter(parts, lambda p: F.contains(p, F.lit("|")))) >= 2), parts)


def units(text: Column) -> Column:
    """array<string>: blocks split at blank lines; in a block, list lines are units, lines of records are split into them, the rest becomes sentences. Null and blank: none."""
    blocks = F.split(F.coalesce(text, F.lit("")), r"\n\s*\n")
    lines = F.flatten(F.transform(blocks, lambda b: F.split(b, "\n")))
    each = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.coalesce(records(x), F.when(x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+"), _clean(F.array(x))).otherwise(sentences(x))))
    return F.flatten(each)
