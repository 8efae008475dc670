"""What the operators share: reading, written checkpoints, distributed ranks and interval plans."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; an own temporary one only where a local session names none. A cluster's session must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and reread: lineage ends here, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def block_of(key: Column, blocks: int) -> Column:
    """The block of a blocked Bloom filter that a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column, bits: int = 6) -> Column:
    """The key's bits within its block of 64, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    out = bit(0)
    for i in range(1, bits):
        out = out.bitwiseOR(bit(i))
    return out


def bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row, _bloom: the blocks (64 bits each) of a Bloom filter of a column's values. Its size follows from blocks alone, so it may be broadcast."""
    found = keys.groupBy(block_of(F.col(column), blocks).alias("id")).agg(F.bit_or(bits_of(F.col(column))).alias("bits"))
    every = keys.sparkSession.range(blocks).join(found, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["bits"]).alias("_bloom"))


def may_hold(filter_: Column, key: Column, blocks: int) -> Column:
    """Whether a filter of bloom() may hold the key; never false for one that it holds."""
    mask = bits_of(key)
    return F.element_at(filter_, (block_of(key, blocks) + 1).cast("int")).bitwiseAND(mask) == mask


def running(df: DataFrame, order: str, size: str, into: str, shift: int) -> DataFrame:
    """df with the sum of size over all rows of lesser order (a column of distinct non-negative longs).

    In two levels: rows whose orders agree but for the last shift bits are summed within a task, and only their totals
    meet in one. df is read twice and must give the same rows.
    """
    block = F.shiftright(F.col(order), shift)
    totals = df.groupBy(block.alias("_block")).agg(F.sum(size).alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_block", block).join(totals, "_block")
    return out.withColumn(into, F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("_block", "_before")


#: Rows of a group that are ranked in one part.
RANKED = 100_000


def ranked(df: DataFrame, group: str, counts: dict[int, int], bucket: Column, order: list[Column], salt: Column, rank: str = "rank") -> DataFrame:
    """Adds each row's place (from 0) within its group, ordered by bucket, then by part, then by order.

    counts: the rows of every group; their number must not depend on that of the rows, as they are broadcast. A group is
    sorted bucket by bucket, and a bucket of a group of many rows in so many parts (by hash of salt) that one holds about RANKED of
    its rows, so that a group holding a third of all rows is dealt over as many tasks as it needs; where a part starts
    comes from counts of the parts. df must give the same rows when read twice, as a written table does.
    """
    spark = df.sparkSession
    parts = spark.createDataFrame([(g, -(-n // RANKED)) for g, n in counts.items()], "_g long, _parts long")
    rows = df.join(F.broadcast(parts), F.col(group) == F.col("_g")).drop("_g")
    rows = rows.withColumn("_bucket", bucket.cast("long")).withColumn("_part", F.pmod(F.xxhash64(salt), F.col("_parts")))
    before = Window.partitionBy("_group").orderBy("_b", "_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
        .select("_group", "_b", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    own = Window.partitionBy(group, "_bucket", "_part").orderBy(*order)
    rows = rows.withColumn("_own", F.row_number().over(own))
    return (
        rows.join(starts, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b")) & (F.col("_part") == F.col("_p")))
        .withColumn(rank, (F.col("_start") + F.col("_own") - 1).cast("long"))
        .drop("_group", "_b", "_p", "_bucket", "_part", "_parts", "_own", "_start")
    )


def placed(df: DataFrame, group: str, plan: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """Looks each row's (group, rank) up in a plan of intervals and adds its values.

    plan: rows (group, first rank, first value, step, fixed value): ranks from the first up to the next
    interval of the group get names[0] = first value + step * (rank - first) and names[1] = fixed value.
    The plan's length must not depend on the number of rows.
    """
    cells = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    keys = cells[:, 0] * (1 << 44) + cells[:, 1]
    out = df.schema.fieldNames()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` long" for n in names])

    def look(batches):
        for batch in batches:
            g = np.asarray(batch.column(out.index(group)).to_numpy(zero_copy_only=False), dtype=np.int64)
            r = np.asarray(batch.column(out.index("rank")).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = np.searchsorted(keys, g * (1 << 44) + r, side="right") - 1
            first = cells[at, 2] + cells[at, 3] * (r - cells[at, 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(cells[at, 4])], names=[*out, *names])

    return df.mapInArrow(look, schema)
