"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Hex digits of the hash that make a document's draw.
DIGITS = 12
#: The most sources that are broadcast.
BROADCAST = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size): one row per source. Adds target and rate.

    Weights repeat over the sources by code point, null last. Together the targets are share times all
    sizes; a target stops at most times its source's size and the excess is dealt out anew by weight until
    none is above: target = min(most * size, level * weight), whose level follows from one sort by the
    level at which each source is full. The sort sees one row per source, never documents.
    A source of size 0 gets target and rate 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w.cast("double")).withColumn("_cap", most * F.col("source_size"))
    rows = rows.withColumn("_full", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_full", F.col("source").isNull(), "source")
    before, after, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rows = rows.withColumn("_total", share * F.sum("source_size").over(every))
    # with all earlier sources full, the rest reach this level
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    rows = rows.withColumn("_level", level).withColumn("_open", F.when(F.col("_level") <= F.col("_full"), F.col("_level")))
    rows = rows.withColumn("_level", F.max("_open").over(every))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the hash of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def goals(docs: DataFrame, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """_source, source_size, target, rate of every source, to be joined to documents.

    The sizes are summed before the shuffle. The table is written and counted; up to BROADCAST sources are
    broadcast, more are joined by shuffle, where adaptive execution splits a hot source.
    """
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    found = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    found = written(found.withColumnRenamed("source", "_source"), "goals")
    return F.broadcast(found) if found.count() <= BROADCAST else found


def key_of(id_: Column, text: Column) -> Column:
    """What a document's draw comes from: its id, or its text where the id is null."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate), and one more if the key's draw is below the rest."""
    return (F.floor(rate) + (draw(seed, key) < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    A document is emitted floor(rate) times, plus once more if its draw is below the rate's fraction.
    Size is the number of words (null or empty text: 0). Null is a source of its own. Documents with one id
    draw alike, those with a null id if their texts are equal. No documents: no rows.
    """
    found = goals(docs, text_col, source_col, weights, share, most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key_of(F.col(id_col), F.col(text_col)).alias("_key"))
    rows = rows.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies(F.col("rate"), F.col("_key"), seed).alias("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: docs, each row as often as mix() says."""
    found = goals(docs, text_col, source_col, weights, share, most).select("_source", F.col("rate").alias("_rate"))
    rows = docs.join(found, docs[source_col].eqNullSafe(found["_source"]), "left")
    times = copies(F.col("_rate"), key_of(docs[id_col], docs[text_col]), seed).cast("int")
    again = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return rows.select(*[docs[c] for c in docs.columns], again.alias("_copy")).drop("_copy")
