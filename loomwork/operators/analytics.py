"""Grouped answers over rows: counts, sums, concentration, indexes. Values only; rendering is a step of its own (lines())."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters
from .quantiles import quantile


def filled(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != ""


def group_count(rows: DataFrame, key: str, member: str | None = None, *, ascending: bool = False, only_one: bool = False, limit: int | None = 5) -> DataFrame:
    """Rows per key (blank keys don't count): key, n and, with member, the sorted distinct members. Most (or fewest) first, then by key."""
    more = [F.array_sort(F.collect_set(member)).alias("members")] if member else []
    out = rows.where(filled(key)).groupBy(key).agg(F.count("*").alias("n"), *more)
    if only_one:
        out = out.where("n = 1")
    out = out.orderBy(F.asc("n") if ascending else F.desc("n"), key)
    return out.limit(limit) if limit else out


def group_number(rows: DataFrame, key: str, number: str, how: str = "sum", limit: int | None = 3) -> DataFrame:
    """Sum or mean of a number per key; null numbers don't count. The largest first, then by key."""
    agg = {"sum": F.sum, "mean": F.avg}[how](F.col(number)).alias(f"{how}_{number}")
    out = rows.where(filled(key) & F.col(number).isNotNull()).groupBy(key).agg(agg).orderBy(F.desc(f"{how}_{number}"), key)
    return out.limit(limit) if limit else out


def median(rows: DataFrame, number: str, *keys: str) -> DataFrame:
    """keys, median: exact, for groups of any size; nulls don't count."""
    return quantile(rows, number, 0.5, keys, into="median")


def extremes(rows: DataFrame, number: str, label: str, *keys: str) -> DataFrame:
    """The least and the greatest number with their labels; ties: the first label."""
    rows = rows.where(F.col(number).isNotNull())
    low, high = F.struct(number, label), F.struct(-F.col(number), label)
    return rows.groupBy(*keys).agg(F.min(number).alias("low"), F.min_by(label, low).alias("low_label"), F.max(number).alias("high"), F.min_by(label, high).alias("high_label"))


def listing(rows: DataFrame, key: str, member: str, least: int = 1, blank_as: str | None = None) -> DataFrame:
    """Keys with at least so many distinct members: key, members (sorted), n."""
    if blank_as:
        rows = rows.withColumn(key, F.when(filled(key), F.col(key)).otherwise(blank_as))
    out = rows.where(filled(key) & filled(member)).groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return out.withColumn("n", F.size("members")).where(F.col("n") >= least)


def preview_of(members: Column, most: int) -> Column:
    """The first members and how many more there are."""
    more = F.size(members) - most
    return F.concat(F.array_join(F.slice(members, 1, most), "; "), F.when(more > 0, F.concat(F.lit("; "), more.cast("string"), F.lit(" more"))).otherwise(""))


def having_all(rows: DataFrame, key: str, label: str, wanted: Sequence[str]) -> DataFrame:
    """Keys that occur with every wanted label."""
    some = rows.where(filled(key) & F.col(label).isin(*wanted))
    return some.groupBy(key).agg(F.count_distinct(label).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def concentration(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Per key its most frequent part (ties: the first), that part's share, and the number of rows and of parts."""
    counts = rows.where(filled(key) & filled(part)).groupBy(key, part).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy(F.desc("c"), part)
    ranked = counts.withColumn("at", F.row_number().over(order))
    first = F.max(F.when(F.col("at") == 1, F.struct(F.col(part).alias("top"), F.col("c").alias("top_n"))))
    out = ranked.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("parts"), first.alias("f"))
    return out.select(key, "n", "parts", "f.top", (F.col("f.top_n") / F.col("n")).alias("share"))


def most_concentrated(rows: DataFrame, key: str, part: str) -> DataFrame:
    """The one (key, part) with the largest share; ties: the first key, then part."""
    return concentration(rows, key, part).orderBy(F.desc("share"), key, "top").limit(1)


def mix(rows: DataFrame, key: str, label: str, most: int = 3, blank_as: str = "Unspecified", first: str | None = None) -> DataFrame:
    """Per key its labels as "label: n; ...", the most frequent first, then by label, or by the least value of first (say an ordinal: by first appearance). Counted before ranking, so a hot key ranks its labels, not its rows."""
    name = F.when(filled(label), F.col(label).cast("string")).otherwise(blank_as)
    counts = rows.groupBy(key, name.alias("_label")).agg(F.count("*").alias("_n"), (F.min(first) if first else F.lit(0)).alias("_first"))
    counts = counts.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), "_first", "_label"))).where(F.col("_at") <= most)
    items = F.array_sort(F.collect_list(F.struct("_at", F.concat_ws(": ", "_label", F.col("_n").cast("string")).alias("t"))))
    return counts.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t"]), "; ").alias(f"{label}_mix"))


def samples(rows: DataFrame, key: str, member: str, order: Sequence[str], most: int = 4) -> DataFrame:
    """Per key its first members in order, joined."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order, member))
    first = rows.withColumn("_at", at).where(F.col("_at") <= most)  # a top-k that Spark cuts before the shuffle
    items = F.array_sort(F.collect_list(F.struct("_at", F.col(member).cast("string").alias("t"))))
    return first.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t"]), "; ").alias("samples"))


def clusters(rows: DataFrame, key: str, number: str, yes: Column, indirect: Column, limit: int | None = 15) -> DataFrame:
    """Per key: rows, sum of a number, rows of two kinds. Most rows first, then the larger sum, then by key."""
    out = rows.where(filled(key) & (F.col(key) != "Unknown")).groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).alias("total"), F.count_if(yes).alias("yes"), F.count_if(indirect).alias("indirect"))
    out = out.orderBy(F.desc("n"), F.desc("total"), key)
    return out.limit(limit) if limit else out


def keyword_index(rows: DataFrame, body: Column, rules: dict[str, tuple[str, ...]], also: Column | None = None) -> DataFrame:
    """Rows per rule; rules without a row stay, with 0."""
    found = filters.tagged(rows, body, rules, also).groupBy("rule").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return every.join(F.broadcast(found), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))  # one row a rule


def rollup(rows: DataFrame, scope: str, *aggs: Column) -> DataFrame:
    """The same aggregates over all rows (scope All) and for each scope, from one pass."""
    out = rows.groupingSets([[], [F.col(scope)]], F.col(scope)).agg(F.grouping(scope).alias("_g"), *aggs)
    return out.withColumn("scope", F.when(F.col("_g") == 1, "All").otherwise(F.col(scope))).where("scope is not null").drop("_g", scope)


def top(rows: DataFrame, number: str, label: str, n: int = 10, bottom: bool = False) -> DataFrame:
    return rows.where(F.col(number).isNotNull()).orderBy(F.asc(number) if bottom else F.desc(number), label).limit(n)


def lines(out: DataFrame, *columns: str) -> DataFrame:
    """Rows as lines of text: - a: b | c."""
    first, *rest = columns
    return out.select(F.concat(F.lit("- "), F.col(first).cast("string"), F.lit(": "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in rest])).alias("line"))
