"""States, counties, cities and head counts from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_NAMES = sorted(fixed.STATES.values(), key=lambda s: (-len(s), s))


def state(text: Column) -> Column:
    """The state that a text is, names (longest first) or abbreviates before a zip code or the end; else ""."""
    flat = F.trim(F.coalesce(text, F.lit("")))
    exact = F.create_map(*[F.lit(x) for a, n in fixed.STATES.items() for x in (a.lower(), n)], *[F.lit(x) for n in _NAMES for x in (n.lower(), n)])
    named = F.regexp_extract(F.lower(flat), r"\b(" + "|".join(n.lower() for n in _NAMES) + r")\b(?!\s+county)", 1)
    short = F.regexp_extract(flat, r"\b(" + "|".join(fixed.STATES) + r")\b(?=\s*(?:\d{5}(?:-\d{4})?)?\s*(?:,|$))", 1)
    return F.coalesce(F.try_element_at(exact, F.lower(flat)), F.try_element_at(exact, F.nullif(named, F.lit(""))), F.try_element_at(exact, F.nullif(F.lower(short), F.lit(""))), F.lit(""))


def infer_state(*texts: Column) -> Column:
    """The first of the texts that yields a state."""
    return F.coalesce(*[F.nullif(state(t), F.lit("")) for t in texts], F.lit(""))


def preferred(updated: Column, plain: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(updated), blank(plain), F.lit(""))


def city(location: Column) -> Column:
    """What stands before the first comma, unless the text is a county, a state or has no comma."""
    return F.when(F.contains(location, F.lit(",")), F.trim(F.split(location, ",", 2)[0])).otherwise("")


def county_of_location(location: Column) -> Column:
    """What stands after the first comma, or the text itself if it is a county; else ""."""
    after = F.trim(F.get(F.split(location, ",", 2), F.lit(1)))
    return F.when(F.contains(location, F.lit(",")), F.coalesce(after, F.lit(""))).when(F.contains(F.lower(location), F.lit("county")), F.trim(location)).otherwise("")


def county(location: Column) -> Column:
    """The last "... County" in a text; a bare state is Statewide / Unspecified, blank is Unknown, else the text."""
    flat = F.trim(F.coalesce(location, F.lit("")))
    found = F.regexp_extract_all(flat, F.lit(r"([A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*)*\s+County)"), 1)
    return F.when(flat == "", "Unknown").when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).when(F.lower(flat).isin(*[n.lower() for n in _NAMES]), "Statewide / Unspecified").otherwise(flat)


def head_count(text: Column) -> Column:
    """All digits of a text as one number; none: null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "").try_cast("bigint")
