"""Compact context: a fold over each question's hits that selects, renders the pinned summary first and stops when the budget is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .context import LEAST, compact_priority

#: Share of the budget that a summary gets when other blocks follow, and characters that a budget and a block's body have at least.
SUMMARY_SHARE, LEAST_BUDGET, LEAST_BODY = 0.45, 600, 120
FIELDS = tuple(c for c in fixed.DISPLAY if c not in ("county", "city"))
STRINGS = "array<string>"
#: Views of a company of which one is enough, and rows that are shown whole.
VIEWS = ("row_full", "company_profile", "supply_chain_theme", "location_theme")


def _any(hay: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(hay, F.lit(w)) for w in words))


def _cut(t: Column, most: Column) -> Column:
    """t, or its beginning and three dots, in most characters."""
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, F.lit(1), F.greatest(most - 3, F.lit(0)).cast("int"))), F.lit("..."))).otherwise(t)


def flags(questions: DataFrame) -> DataFrame:
    """q_id, n (normal form) and what a question's words say of its context: broad, linked, several, analytic, definition, listing, and fields, those that its lines show."""
    n = text.normalized(F.coalesce(F.col("question"), F.lit("")))
    q = questions.select("q_id", n.alias("n")).withColumn("_p", F.concat(F.lit(" "), "n", F.lit(" ")))
    p, plain = F.col("_p"), F.col("n")
    linked = _any(p, fixed.COMPACT_LINKED_WORDS)
    broad = _any(p, fixed.COMPACT_BROAD_WORDS)
    asked = F.array_compact(F.array(*[F.when(_any(plain, words), F.lit(c)) for words, c in fixed.COMPACT_FIELDS]))
    named = lambda names: F.array(*map(F.lit, names))
    fields = F.array_distinct(F.concat(asked, F.when(linked, named(fixed.COMPACT_LINKED_FIELDS)).otherwise(F.array().cast(STRINGS)), named(fixed.COMPACT_CORE_FIELDS)))
    return q.withColumns({
        "broad": broad, "linked": linked, "several": broad | linked | _any(plain, fixed.COMPACT_SEVERAL_WORDS), "analytic": _any(plain, fixed.COMPACT_ANALYTIC_WORDS),
        "definition": _any(plain, fixed.COMPACT_DEFINITION_WORDS), "listing": F.contains(plain, F.lit("ev supply chain role")) & F.contains(plain, F.lit("group")) & _any(plain, fixed.COMPACT_LISTING_WORDS),
        "fields": fields,
    }).drop("_p")


def _bodies(hits: DataFrame) -> DataFrame:
    """hits with head (without its number) and body, both before any budget."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    have = lambda c: c in hits.columns
    kind = F.coalesce(F.nullif(F.trim("chunk_type"), F.lit("")), F.lit("retrieved_chunk"))
    row = F.when(blank("row_number") != "", F.concat(F.lit(" row="), blank("row_number"))).otherwise("") if have("row_number") else F.lit("")
    source = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) if have(c) else F.lit(x) for c, x in (("source_file", "None"), ("", "::"), ("sheet_name", "None"))])
    head = F.concat(F.lit("type="), kind, F.lit(" company="), F.coalesce(F.nullif(blank("company"), F.lit("")), F.lit("n/a")), F.lit(" source="), source, row)
    more = F.when(kind == "identity_theme", F.array(*map(F.lit, fixed.COMPACT_IDENTITY_FIELDS))).otherwise(F.array().cast(STRINGS))
    values = F.create_map(*[x for c in FIELDS for x in (F.lit(c), F.when(blank(c) != "", F.concat(F.lit(f"{fixed.DISPLAY[c]}: "), blank(c))) if have(c) else F.lit(None).cast("string"))])
    shown = F.filter(F.transform(F.array_distinct(F.concat("fields", more)), lambda f: F.element_at(values, f)), lambda v: v.isNotNull())
    line = F.array_join(F.array_distinct(F.concat(F.when(blank("company") != "", F.array(F.concat(F.lit("Company: "), blank("company")))).otherwise(F.array().cast(STRINGS)), shown)), " | ")
    whole = F.coalesce(F.nullif(blank("row_summary"), F.lit("")), F.col("text")) if have("row_summary") else F.col("text")
    rich = (kind == "structured_row_match") | (F.col("linked") & kind.isin(*VIEWS)) | (F.col("several") & kind.isin("row_full", "company_profile", "location_theme"))
    body = F.when(kind == "note_reference", F.col("text")).when(rich, whole).otherwise(line)
    told = F.filter(F.transform(F.split(body, r"\|"), F.trim), lambda x: (x != "") & ~F.startswith(F.lower(x), F.lit("company:")))
    body = F.when(F.size(told) == 0, whole).otherwise(body)
    return hits.withColumns({"_kind": kind, "_head": head, "_body": F.coalesce(body, F.lit("")), "_company": blank("company"), "_row": blank("row_key") if have("row_key") else F.lit("")})


def segments(questions: DataFrame, hits: DataFrame, *, most: int = 5, chars: int = 4200) -> DataFrame:
    """q_id, blocks, context: the evidence blocks of each question's compact context, and these with their marks [E n], joined by blank lines.

    questions: q_id (unique), question. hits: q_id, chunk_id, chunk_type, text, company, final_score and what there is of rank (ties go to the least), row_key, row_summary, source_file, sheet_name, row_number, primary_oems and the fields of a row; a question's hits are the few
    that a search selected. By priority, then score: notes for definitions only and one alone; of a row_key the first; of a company that has a block no further view unless
    several records are asked for; most blocks, 15 at least for broad and relationship questions. A structured summary is
    pinned first: it gets all of the budget if it is alone, else a share, and whole lines of it. A block begins only if LEAST characters are left and is cut to what is left. Questions without hits have one block that says so.
    """
    q = flags(questions)
    rows = _bodies(hits.join(q, "q_id"))
    oem = F.trim(F.coalesce(F.col("primary_oems"), F.lit(""))) != "" if "primary_oems" in hits.columns else F.lit(False)
    place = F.col("rank").cast("long") if "rank" in hits.columns else F.lit(0).cast("long")
    item = F.struct((-compact_priority(F.col("_kind"), F.col("definition"), F.col("linked"), oem)).alias("p"), (-F.col("final_score").cast("double")).alias("s"), place.alias("r"), F.col("chunk_id").cast("string").alias("c"),
        F.col("_kind").alias("kind"), F.col("_head").alias("head"), F.col("_body").alias("body"), F.col("_company").alias("company"), F.col("_row").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy("q_id").agg(F.array_sort(F.collect_list(item)).alias("_hits"))
    out = q.join(listed, "q_id", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(listed.schema["_hits"].dataType)))
    wide = F.col("broad") | F.col("linked")
    top = F.when(wide, F.lit(max(most, fixed.COMPACT_BROAD))).otherwise(F.lit(most))
    summary = F.get(F.filter("_hits", lambda h: h["kind"] == "structured_match_summary"), F.lit(0))
    suffices = (F.col("analytic") | F.col("listing")) & F.coalesce(_any(F.lower(summary["text"]), fixed.SUFFICES), F.lit(False))
    limit = F.when(~wide & suffices, F.greatest(top, F.lit(5))).otherwise(top)
    out = out.withColumns({"_top": top, "_limit": limit})

    # first fold: which hits are taken; it carries the rows and companies seen and whether a note was
    kind = listed.schema["_hits"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("taken"), F.array().cast(STRINGS).alias("rows"), F.array().cast(STRINGS).alias("firms"), F.lit(False).alias("note"))

    def take(state: Column, h: Column) -> Column:
        note = h["kind"] == "note_reference"
        skip = (F.size(state["taken"]) >= F.col("_limit")) | (note & (~F.col("definition") | state["note"])) | ((h["row"] != "") & F.array_contains(state["rows"], h["row"]))
        skip = skip | ((h["company"] != "") & F.array_contains(state["firms"], h["company"]) & h["kind"].isin(*VIEWS) & ~F.col("several"))
        return F.when(skip, state).otherwise(F.struct(F.array_append(state["taken"], h).alias("taken"), F.array_append(state["rows"], h["row"]).alias("rows"), F.array_append(state["firms"], h["company"]).alias("firms"), (state["note"] | note).alias("note")))

    out = out.withColumn("_taken", F.aggregate("_hits", start, take, lambda s: s["taken"]))
    numbered = F.transform("_taken", lambda h, k: F.struct((k + 1).alias("k"), F.concat(F.lit("[Evidence "), (k + 1).cast("string"), F.lit("] "), h["head"]).alias("head"), h["body"].alias("body"), h["text"].alias("text"), ((k == 0) & (h["kind"] == "structured_match_summary")).alias("pinned")))

    # second fold: blocks within the budget; it carries the characters used
    budget = max(LEAST_BUDGET, chars)
    begin = F.struct(F.array().cast(STRINGS).alias("blocks"), F.lit(0).alias("used"))
    alone = F.size("_taken") == 1

    def pinned(h: Column, left: Column) -> Column:
        room = F.when(alone, left).otherwise(F.least(left, F.lit(int(budget * SUMMARY_SHARE))))
        lines = F.filter(F.transform(F.split(h["text"], r"\r?\n"), F.rtrim), lambda x: F.trim(x) != "")
        none = F.struct(F.array().cast(STRINGS).alias("kept"), (F.length(h["head"]) + 1).alias("total"), F.lit(True).alias("open"))
        add = lambda s, x: F.when(s["open"] & (s["total"] + F.length(x) + 1 <= room), F.struct(F.array_append(s["kept"], x).alias("kept"), (s["total"] + F.length(x) + 1).alias("total"), F.lit(True).alias("open"))).otherwise(F.struct(s["kept"].alias("kept"), s["total"].alias("total"), F.lit(False).alias("open")))
        kept = F.aggregate(lines, none, add, lambda s: s["kept"])
        short = F.concat(F.rtrim(F.substring(h["text"], F.lit(1), F.greatest(room - F.length(h["head"]) - 5, F.lit(0)).cast("int"))), F.lit("..."))
        told = F.when(F.size(kept) == 0, short).when(F.size(kept) < F.size(lines), F.concat(F.array_join(kept, "\n"), F.lit("\n..."))).otherwise(F.array_join(kept, "\n"))
        return F.concat(h["head"], F.lit("\n"), told)

    def add(state: Column, h: Column) -> Column:
        left = F.lit(budget) - state["used"]
        body = F.concat(h["head"], F.lit("\n"), _cut(h["body"], F.greatest(F.lit(LEAST_BODY), left - F.length(h["head"]) - 1)))
        block = _cut(F.when(h["pinned"], pinned(h, left)).otherwise(body), left)
        full = (left < LEAST) | (F.size(state["blocks"]) >= F.col("_top"))
        return F.when(full, state).otherwise(F.struct(F.array_append(state["blocks"], block).alias("blocks"), (state["used"] + F.length(block)).alias("used")))

    blocks = F.aggregate(numbered, begin, add, lambda s: s["blocks"])
    out = out.select("q_id", blocks.alias("blocks")).withColumn("blocks", F.when(F.size("blocks") == 0, F.array(F.lit("No retrieved evidence."))).otherwise(F.col("blocks")))
    marked = F.transform("blocks", lambda b, k: F.concat(F.lit("[E"), (k + 1).cast("string"), F.lit("] "), b))
    empty = F.get("blocks", F.lit(0)) == "No retrieved evidence."
    return out.withColumn("context", F.when(empty, F.lit("No retrieved evidence.")).otherwise(F.array_join(marked, "\n\n")))
