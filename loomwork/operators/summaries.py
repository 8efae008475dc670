"""Five derived tables over canonical rows, for all of them and for each state at once, and the chunks that show them.

Each table is one aggregation keyed by scope as well: a row takes part in scope "" (all) and in its state's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import analytics, filters

TITLES = {
    "county_cluster": "County clusters by companies and employment",
    "role_concentration": "Supply chain roles by concentration",
    "capability_index": "Capabilities by keyword",
    "oem_linkage": "Suppliers by primary OEM",
    "battery_ecosystem": "Battery ecosystem by theme",
}
TOP = 15


def scoped(rows: DataFrame, state: str = "state") -> DataFrame:
    """Every row under scope "" and, if it has a state, under that."""
    scopes = F.array_compact(F.array(F.lit(""), F.nullif(F.trim(F.coalesce(F.col(state), F.lit(""))), F.lit(""))))
    return rows.withColumn("scope", F.explode(scopes))


def _mix(rows: DataFrame, keys: list[str], label: str, most: int = 3, blank: str = "Unspecified") -> DataFrame:
    key = F.struct(*keys).alias("_key")
    out = analytics.mix(rows.select(key, label), "_key", label, most, blank)
    return out.select("_key.*", f"{label}_mix")


def _samples(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    key = F.struct(*keys).alias("_key")
    return analytics.samples(rows.select(key, "company", *[c for c in order if c != "company"]), "_key", "company", order, most).select("_key.*", "samples")


def _first(rows: DataFrame, *order: Column, most: int = TOP) -> DataFrame:
    """The first rows of each scope with their place, from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(*order))).where(F.col("place") <= most)


def county_cluster(rows: DataFrame) -> DataFrame:
    rows = scoped(rows).where(analytics.filled("county") & (F.col("county") != "Unknown"))
    out = rows.groupBy("scope", "county").agg(
        F.count("*").alias("companies"), F.coalesce(F.sum(F.when(filters.not_outlier(), F.col("employment_num"))), F.lit(0)).alias("employment"),
        F.count_if(filters.relevance("yes")).alias("ev_yes"), F.count_if(filters.relevance("indirect")).alias("ev_indirect"),
    )
    return _first(out, F.desc("companies"), F.desc("employment"), F.col("county"))


def role_concentration(rows: DataFrame) -> DataFrame:
    """Per role its rows, counties, the most frequent county and its share, and the categories."""
    role = F.when(analytics.filled("ev_supply_chain_role"), F.col("ev_supply_chain_role")).otherwise("Unspecified").alias("role")
    rows = scoped(rows).select("scope", role, "county", "category")
    keyed = rows.select(F.struct("scope", "role").alias("_key"), "county")
    out = analytics.concentration(keyed, "_key", "county").select("_key.*", F.col("n").alias("companies"), F.col("parts").alias("counties"), F.col("top").alias("top_county"), F.round("share", 4).alias("share"))
    return _first(out.join(_mix(rows, ["scope", "role"], "category"), ["scope", "role"]), F.desc("companies"), F.desc("share"), F.col("role"))


def _searched() -> Column:
    return F.concat_ws(" | ", "company", "product_service", "ev_supply_chain_role", "industry_group")


def _every_rule(found: DataFrame, rows: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rules without a row stay, with 0; in the rules' order."""
    names = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(r).alias("rule")) for k, r in enumerate(rules, 1)])
    every = rows.select("scope").distinct().withColumn("r", F.explode(names)).select("scope", "r.*")
    return every.join(found, ["scope", "rule"], "left").withColumn("companies", F.coalesce("companies", F.lit(0)))


def capability_index(rows: DataFrame) -> DataFrame:
    rows = scoped(rows)
    tagged = filters.tagged(rows, _searched(), fixed.CAPABILITIES)
    found = tagged.groupBy("scope", "rule").agg(F.count("*").alias("companies"))
    found = found.join(_mix(tagged, ["scope", "rule"], "category"), ["scope", "rule"]).join(_samples(tagged, ["scope", "rule"], ["category"], 4), ["scope", "rule"])
    return _every_rule(found, rows, fixed.CAPABILITIES)


def oem_linkage(rows: DataFrame) -> DataFrame:
    oem = F.when(analytics.filled("primary_oems"), F.col("primary_oems")).otherwise("Unspecified OEM")
    rows = scoped(rows).withColumn("oem", oem)
    keys = ["scope", "oem"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("suppliers"))
    out = out.join(_mix(rows, keys, "category"), keys).join(_mix(rows, keys, "ev_supply_chain_role"), keys).join(_samples(rows, keys, [], 3), keys)
    return _first(out, F.desc("suppliers"), F.col("oem"))


def battery_ecosystem(rows: DataFrame) -> DataFrame:
    """Rows that a theme's keywords name, and all rows of relevance yes."""
    rows = scoped(rows)
    tagged = filters.tagged(rows, _searched(), fixed.ECOSYSTEM, filters.relevance("yes"))
    found = tagged.groupBy("scope", "rule").agg(F.count("*").alias("companies"))
    found = found.join(_mix(tagged, ["scope", "rule"], "county"), ["scope", "rule"]).join(_samples(tagged, ["scope", "rule"], [], 4), ["scope", "rule"])
    return _every_rule(found, rows, fixed.ECOSYSTEM)


TABLES = {"county_cluster": county_cluster, "role_concentration": role_concentration, "capability_index": capability_index, "oem_linkage": oem_linkage, "battery_ecosystem": battery_ecosystem}


def chunks(rows: DataFrame) -> DataFrame:
    """A chunk for every table and scope that has rows: source_file, chunk_id, text, tokens, state, analysis_type, analysis_title, chunk_type. At most TOP lines a table meet in a row."""
    out = None
    source = rows.agg(F.min("source_file").alias("source_file"))  # one row
    for name, make in TABLES.items():
        t = make(rows)
        shown = [c for c in t.columns if c not in ("scope", "place")]
        line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in shown])
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "\n")
        title = F.concat(F.lit(TITLES[name]), F.when(F.col("scope") == "", "").otherwise(F.concat(F.lit(" ("), F.col("scope"), F.lit(")"))))
        one = t.groupBy("scope").agg(body.alias("body")).withColumn("analysis_type", F.lit(name)).withColumn("analysis_title", title).withColumn("head", F.lit(" | ".join(shown)))
        out = one if out is None else out.unionByName(one)
    scope = F.when(F.col("scope") == "", "all states").otherwise(F.col("scope"))
    out = out.join(F.broadcast(source)).withColumn("text", F.concat_ws("\n", "analysis_title", F.concat(F.lit("Scope: "), scope), F.lit(""), "head", "body"))
    key = F.concat_ws(":", "source_file", F.when(F.col("scope") == "", "global").otherwise(F.col("scope")), "analysis_type")
    return out.select("source_file", text.uuid5(key).alias("chunk_id"), "text", text.tokens(F.col("text")).alias("tokens"), F.col("scope").alias("state"), "analysis_type", "analysis_title", F.lit("derived_analytic_summary").alias("chunk_type"))
