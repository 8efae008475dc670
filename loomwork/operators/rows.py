"""Canonical rows and the chunks that texts and rows are searched by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, places, text

#: Columns of a sheet -> columns of the canonical row.
CANONICAL = {
    "Company": "company", "Category": "category", "Industry Group": "industry_group", "EV Supply Chain Role": "ev_supply_chain_role",
    "Product / Service": "product_service", "Primary OEMs": "primary_oems", "Primary Facility Type": "primary_facility_type",
    "Supplier or Affiliation Type": "supplier_or_affiliation_type", "Classification Method": "classification_method",
    "Employment": "employment", "EV / Battery Relevant": "ev_battery_relevant",
}
#: Head counts above this are outliers (whole groups' figures in one row).
OUTLIER = 100_000


def value(name: str, values: str = "values") -> Column:
    return F.coalesce(F.try_element_at(F.col(values), F.lit(name)), F.lit(""))


def wide_rows(rows: DataFrame) -> DataFrame:
    """rows (source_file, sheet_name, row_number, values map) as one wide row each; blanks stay "".

    The first row of each row_key wins. Numbers, places and the outlier flag are derived; employment_num is null without digits.
    """
    location = places.preferred(value("Updated Location"), value("Location"))
    state = places.infer_state(*[value(n) for n in ("State", "Updated State", "Address", "Updated Location", "Location")])
    key = F.concat_ws("::", "source_file", "sheet_name", F.col("row_number").cast("string"))
    out = rows.select(key.alias("row_key"), "source_file", "sheet_name", "row_number", *[value(n).alias(c) for n, c in CANONICAL.items()], location.alias("location"), state.alias("state"), labelled("values", fixed.SUMMARY_COLUMNS).alias("row_summary"))
    return derived(out.dropDuplicates(["row_key"]))


def derived(rows: DataFrame) -> DataFrame:
    """Adds employment_num, is_global_outlier, city, county."""
    n = places.head_count(F.col("employment"))
    return rows.withColumns({"employment_num": n, "is_global_outlier": F.coalesce(n > OUTLIER, F.lit(False)), "city": places.city(F.col("location")), "county": places.county(F.col("location"))})


def labelled(values: str, names: tuple[str, ...]) -> Column:
    """name: value of those that aren't blank, joined by |."""
    return F.concat_ws(" | ", *[F.when(F.trim(value(n, values)) != "", F.concat(F.lit(f"{n}: "), value(n, values))) for n in names])


def ordered_names(values: str = "values") -> Column:
    """The canonical columns first, then the row's others as they come."""
    first = F.array_intersect(F.array(*map(F.lit, fixed.ROW_COLUMNS)), F.map_keys(values))
    return F.array_union(first, F.map_keys(values))


def row_chunks(rows: DataFrame) -> DataFrame:
    """Up to six views of each row: chunk_id, text, chunk_type, row_key, source_file, sheet_name, row_number, tokens.

    A themed view needs two of its columns. Identifiers come from file, sheet, row, type and text, so the same row in two files has two of them.
    """
    every = F.concat_ws(" | ", F.transform(ordered_names(), lambda n: F.concat(n, F.lit(": "), F.try_element_at("values", n))))
    rest = F.slice(F.array_except(ordered_names(), F.array(*map(F.lit, fixed.PROFILE_COLUMNS))), 1, 4)
    profile = F.concat_ws(" | ", F.nullif(labelled("values", fixed.PROFILE_COLUMNS), F.lit("")), F.nullif(F.concat_ws(" | ", F.transform(rest, lambda n: F.concat(n, F.lit(": "), F.try_element_at("values", n)))), F.lit("")))
    there = lambda names: sum((F.when(F.trim(value(n)) != "", 1).otherwise(0) for n in names), F.lit(0))
    views = [("row_full", every), ("company_profile", profile)] + [(t, F.when(there(names) >= 2, labelled("values", names))) for t, names in fixed.THEMES.items()]
    view = F.explode(F.array(*[F.struct(F.lit(t).alias("chunk_type"), c.alias("text")) for t, c in views]))
    key = F.concat_ws("::", "source_file", "sheet_name", F.col("row_number").cast("string"))
    out = rows.select("source_file", "sheet_name", "row_number", key.alias("row_key"), view.alias("view")).select("*", "view.*").drop("view").where("text is not null and text <> ''")
    return _identified(out, F.concat_ws("::", "row_key", "chunk_type", "text"))


def _identified(chunks: DataFrame, seed: Column) -> DataFrame:
    return chunks.withColumn("chunk_id", text.chunk_id(seed)).withColumn("tokens", text.tokens(F.col("text")))


def note_chunks(notes: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Windows of note sheets (source_file, sheet_name, text)."""
    out = notes.select("source_file", "sheet_name", F.explode(text.windows(F.col("text"), size, overlap)).alias("w"))
    out = out.select("source_file", "sheet_name", F.col("w.chunk_index").alias("chunk_index"), F.col("w.chunk").alias("text"), F.lit("note_reference").alias("chunk_type"))
    return _identified(out, F.concat_ws("::", "source_file", "sheet_name", "chunk_index", "text"))


def document_chunks(documents: DataFrame, source: str = "canonical_source", body: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """Windows of documents: source, chunk_index, text, chunk_id (sha1 of source::index), tokens."""
    out = documents.select(F.col(source).cast("string").alias("source"), F.explode(text.windows(F.col(body), size, overlap)).alias("w"))
    out = out.select("source", F.col("w.chunk_index").alias("chunk_index"), F.col("w.chunk").alias("text"), F.lit("document_chunk").alias("chunk_type"))
    return out.withColumn("chunk_id", F.sha1(F.encode(F.concat_ws("::", "source", "chunk_index"), "UTF-8"))).withColumn("tokens", text.tokens(F.col("text")))


def all_chunks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fingerprint(chunks: DataFrame, model: str, body: str = "text", key: str = "chunk_id") -> DataFrame:
    """One row, fingerprint: changes when a chunk comes, goes or changes, whatever the order. Digests are summed, so any number of chunks takes one pass."""
    part = F.conv(F.substring(F.sha1(F.encode(F.concat_ws("\x1f", F.col(key), F.col(body)), "UTF-8")), 1, 12), 16, 10).cast("decimal(38,0)")
    total = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("s"))
    return total.select(F.substring(F.sha1(F.encode(F.concat_ws("|", F.lit(model), "n", "s"), "UTF-8")), 1, 12).alias("fingerprint"))
