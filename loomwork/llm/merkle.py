"""A Merkle manifest of a table: a tree of hashes per group, a tree over the groups, a proof for every row.

Levels are windows: a level's nodes are partitioned by group and parent, and the ordered full-frame collect_list of a run's
digests is at once the parent's preimage and its nodes' siblings. A parent counts once on the next level: of the rows below it the first one alone
puts its digest into the list. FAN levels of a block of 2^FAN aligned nodes pass within one shuffle by (group, block), then the blocks' roots are the next tier's
nodes, so a group of any size is dealt over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Levels of a tier.
FAN = 10


def leaf(values: list[Column]) -> Column:
    """SHA-256 of a row: each value is `-` if null, else its UTF-8 byte count, a colon and the value as a string."""
    text = [v.cast("string") for v in values]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*told), 256)


def in_order(df: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """df with each row's place in its group (idx, from 0) and the group's rows (n). df is written first.

    Rows are dealt in ranges of (group, order, place read), sorted and written with their place in the range; where a range's part of a group starts comes from
    counts of the ranges. Only these are gathered by group.
    """
    keys = [F.col(group), *order, F.col("_own")]
    rows = written(df, label).withColumn("_own", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own").withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, f"{label}-sorted")
    part = F.shiftright("_at", 33).alias("_part")
    own = Window.partitionBy(group)
    starts = (
        rows.groupBy(group, part).agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"))
        .select(group, "_part", "_lo", F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("n"))
    )
    rows = rows.withColumn("_part", part).join(starts, [group, "_part"])
    return rows.withColumn("idx", (F.col("_at") - F.col("_lo") + F.col("_before")).cast("long")).drop("_at", "_part", "_lo", "_before")


def levels(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes (g, idx, n, digest, more columns) with block, steps (a string per level passed: the sibling after `<` or `>` for its side, empty for a lone node) and top, the digest of the node above at the last level passed."""
    rows = nodes.withColumn("block", F.shiftright("idx", fan)).repartition("g", "block").withColumn("steps", F.array().cast("array<string>")).withColumn("top", F.col("digest"))
    for k in range(fan):
        run_of = Window.partitionBy("g", "block", F.shiftright("idx", k + 1)).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.col("idx").bitwiseAND(F.lit((1 << k) - 1)) == 0
        rows = rows.withColumn("_run", F.collect_list(F.when(first, F.col("top"))).over(run_of))
        odd = F.shiftright("idx", k).bitwiseAND(F.lit(1)) == 1
        step = F.when(F.size("_run") < 2, F.lit("")).when(odd, F.concat(F.lit("<"), F.element_at("_run", 1))).otherwise(F.concat(F.lit(">"), F.try_element_at("_run", F.lit(2))))
        more = F.col("n") > (1 << k)
        rows = rows.withColumn("steps", F.when(more, F.concat("steps", F.array(step))).otherwise(F.col("steps")))
        rows = rows.withColumn("top", F.when(more, F.sha2(F.concat_ws("", "_run"), 256)).otherwise(F.col("top"))).drop("_run")
    return rows


def climb(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """The tiers from the nodes up to where each group is one block; most: the rows of the largest group."""
    rows = written(levels(nodes, fan), "merkle-tier")
    if most <= 1 << fan:
        return [rows]
    above = rows.where(F.col("idx").bitwiseAND(F.lit((1 << fan) - 1)) == 0)
    above = above.select("g", F.col("block").alias("idx"), (F.shiftright(F.col("n") - 1, fan) + 1).alias("n"), F.col("top").alias("digest"))
    return [rows, *climb(above, -(-most >> fan), fan)]


def descend(tiers: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The lowest tier's rows with all their steps; upper: g, steps above a group's root, and columns to pass on."""
    passed = [c for c in upper.columns if c not in ("g", "steps")]
    own = [c for c in tiers[0].columns if c not in ("steps", "block", "n", "digest", "top")]
    above = tiers[-1].join(upper.withColumnRenamed("steps", "_more"), "g").withColumn("steps", F.concat("steps", "_more"))
    for rows in tiers[-2::-1]:
        up = above.select("g", F.col("idx").alias("block"), F.col("steps").alias("_more"), *passed)
        above = rows.join(up, ["g", "block"]).withColumn("steps", F.concat("steps", "_more"))
    return above.select(*own, "steps", *passed)


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    sibling = lambda s: F.substring(s, 2, 64)
    pair = lambda d, s: F.when(s.startswith("<"), F.concat(sibling(s), d)).when(s.startswith(">"), F.concat(d, sibling(s))).otherwise(d)
    return F.aggregate(steps, digest, lambda d, s: F.sha2(pair(d, s), 256))


def proof(steps: Column) -> Column:
    """The siblings of steps, one after the other."""
    return F.array_join(F.transform(steps, lambda s: F.substring(s, 2, 64)), "")


def manifest(docs: DataFrame, fields: list[str], *, group_col: str = "lang", id_col: str = "doc_id", also: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """One row per document: its id, leaf, subroot, root, steps (for fold() and proof()) and the columns of also (expressions over docs).

    A group's leaves ascend by id (null first), rows of one id by leaf; equal rows count each. While a level has several nodes, every two consecutive
    ones, the last maybe alone, become the hash of their digests one after the other; groups (null first, then bytewise by UTF-8) likewise make
    the root. A lone leaf is its subroot, a lone subroot the root. No documents: no rows. docs' other columns don't matter.
    """
    named = {f"_also_{k}": v for k, v in (also or {}).items()}
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), F.col(id_col).alias("_id"), leaf([F.col(c) for c in fields]).alias("digest"), *[v.alias(k) for k, v in named.items()])
    rows = in_order(rows, "g", [F.col("_id").asc_nulls_first(), F.col("digest")], "merkle-leaves")
    tiers = climb(rows.withColumn("_leaf", F.col("digest")), rows.agg(F.max("n")).first()[0] or 0, fan)

    roots = tiers[-1].where("idx = 0").select(F.lit("").alias("all"), F.col("g").alias("_group"), F.col("top").alias("digest"))
    roots = in_order(roots, "all", [F.col("_group")], "merkle-groups").withColumnRenamed("all", "g").withColumn("_subroot", F.col("digest"))
    over = climb(roots, roots.agg(F.max("n")).first()[0] or 0, fan)
    upper = over[-1].where("idx = 0").select("g", F.array().cast("array<string>").alias("steps"), F.col("top").alias("root"))
    groups = descend(over, upper).select(F.col("_group").alias("g"), "steps", F.col("_subroot").alias("subroot"), "root")

    out = descend(tiers, groups)
    return out.select(F.col("_id").alias(id_col), F.col("_leaf").alias("leaf"), "subroot", "root", "steps", *[F.col(k).alias(k[6:]) for k in named])
