"""Bounded context for prompts, built for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

#: A block begins only if so many characters are left for it.
LEAST = 180


def token_budget(blocks: DataFrame, budget: int, *, key: str = "q_id", rank: str = "rank", body: str = "text") -> DataFrame:
    """Blocks in rank order as far as the token budget reaches: whole ones, then the first that overflows cut to what is left, and no more.

    Adds tokens (used), used_before and body, cut. A block's tokens are estimated as a quarter of its characters.
    """
    own = text.token_estimate(F.col(body))
    order = Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("_own", own).withColumn("used_before", F.coalesce(F.sum("_own").over(order), F.lit(0)))
    left = F.lit(budget) - F.col("used_before")
    rows = rows.where(left > 0)
    return rows.withColumn(body, F.when(F.col("_own") <= left, F.col(body)).otherwise(F.substring(F.col(body), F.lit(1), (left * 4).cast("int")))).withColumn("tokens", F.least("_own", left)).drop("_own")


def compact(blocks: DataFrame, most: int, *, key: str = "q_id", rank: str = "rank", body: str = "text") -> DataFrame:
    """One row per key: context. Blocks in rank order, joined by blank lines; a block that doesn't fit is cut, and nothing follows once less than LEAST characters are left.

    The fold runs inside one aggregate over the key's (few, already limited) blocks.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(body).alias("t"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(most).alias("left"))

    def add(state: Column, block: Column) -> Column:
        piece = F.rtrim(F.substring(block["t"], F.lit(1), state["left"]))
        more = F.struct(F.array_append(state["parts"], piece).alias("parts"), (state["left"] - F.length(piece) - 2).alias("left"))
        return F.when(state["left"] < LEAST, state).otherwise(more)

    return blocks.groupBy(key).agg(F.aggregate(ordered, start, add, lambda s: F.array_join(s["parts"], "\n\n")).alias("context"))


def numbered(blocks: DataFrame, *, rank: str = "rank", body: str = "text", into: str = "text") -> DataFrame:
    """Blocks with their evidence mark [E n] in front."""
    return blocks.withColumn(into, F.concat(F.lit("[E"), F.col(rank).cast("string"), F.lit("] "), F.col(body)))


def split_budget(local: DataFrame, web: DataFrame, budget: int, web_needed: str = "web_needed", share: float = 0.45) -> DataFrame:
    """Local and web blocks of each question under one token budget: where the web is needed, local gets share of it and the web the rest; else local gets all."""
    part = lambda rows, needed, tokens: token_budget(rows.where(F.col(web_needed) if needed else ~F.col(web_needed)), tokens)
    own = part(local, True, int(budget * share)).unionByName(part(local, False, budget)).withColumn("source_kind", F.lit("local"))
    return own.unionByName(part(web, True, budget - int(budget * share)).withColumn("source_kind", F.lit("web")))


def _table(kind: Column, values: dict[str, float], other: float | None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), kind), F.lit(other))


def priority(chunk_type: Column, intent: Column, relationship: Column, of_oem: Column) -> Column:
    """The priority of a chunk in the selection of context. of_oem: the row names primary OEMs, or its category is OEM."""
    linked = F.when(of_oem & chunk_type.isin("company_profile", "row_full"), fixed.SELECTION_OEM_ROW).otherwise(_table(chunk_type, fixed.SELECTION_LINKED, None))
    return (
        F.when((chunk_type == "derived_analytic_summary") & intent.isin("aggregation", "comparison"), fixed.SELECTION_ANALYTIC_SUMMARY)
        .when((chunk_type == "note_reference") & (intent == "definition"), fixed.SELECTION_DEFINITION_NOTE)
        .otherwise(F.coalesce(F.when(relationship, linked), _table(chunk_type, fixed.SELECTION_PRIORITY, 0.0)))
    )


def compact_priority(chunk_type: Column, definition: Column, relationship: Column, of_oem: Column) -> Column:
    """The priority of a chunk in compact context. of_oem: the row names primary OEMs."""
    linked = F.when(of_oem & chunk_type.isin("company_profile", "row_full"), fixed.COMPACT_OEM_ROW).otherwise(_table(chunk_type, fixed.COMPACT_LINKED, None))
    return F.when((chunk_type == "note_reference") & definition, fixed.COMPACT_DEFINITION_NOTE).otherwise(F.coalesce(F.when(relationship, linked), _table(chunk_type, fixed.COMPACT_PRIORITY, fixed.COMPACT_OTHER)))


def compact_selection(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Which chunks go into each question's compact context; rank from 1.

    hits: q_id, chunk_id, chunk_type, row_key, company, final_score, priority, and of the question definition, several
    (it asks for several records) and broad (it is broad or about relationships: at least COMPACT_BROAD chunks). By
    priority, then score, then chunk_id: notes for definitions only, the first alone; of a company's rows and views only the
    first unless several are asked for; of a row_key the first of what is left.
    """
    order = [F.desc("priority"), F.desc("final_score"), F.col("chunk_id")]
    place = lambda *keys: F.row_number().over(Window.partitionBy("q_id", *keys).orderBy(*order))
    there = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    note = F.col("chunk_type") == "note_reference"
    rows = hits.where(~note | F.col("definition")).withColumn("_note", F.when(note, place("chunk_type"))).where("_note is null or _note = 1")
    view = F.col("chunk_type").isin("row_full", "company_profile", "supply_chain_theme", "location_theme")
    rows = rows.withColumn("_company", place("company")).where(~(there("company") & view & ~F.col("several") & (F.col("_company") > 1)))
    rows = rows.withColumn("_row", place("row_key")).where(~there("row_key") | (F.col("_row") == 1))
    most = F.when(F.col("broad"), F.greatest(F.lit(limit), F.lit(fixed.COMPACT_BROAD))).otherwise(limit)
    return rows.withColumn("rank", place()).where(F.col("rank") <= most).drop("_note", "_company", "_row")


def rag_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the evidence below and cite it as [E n]. If it does not suffice, begin with \"Insufficient evidence:\".\n\nEvidence:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def plain_prompt(question: Column) -> Column:
    return F.concat(F.lit("Answer the question briefly and to the point.\n\nQuestion: "), question, F.lit("\nAnswer:"))
