"""Tables between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one of its own only for a local session that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df, written to the shared folder and reread: what follows reads it as often as it likes, and lost executors cost no recomputation. by: a column whose values get folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a key that a task of dealt() holds of each side, about; rows of one side that all tasks may hold.
SIDE, HELD = 1000, 10_000


def dealt(left: DataFrame, right: DataFrame, key: str, left_by: Sequence[Column], right_by: Sequence[Column], side: int = SIDE) -> DataFrame:
    """left.join(right, key) for keys with any number of rows: both sides of a large key are cut into blocks of about side rows (by a hash of what left_by and right_by
    tell), and each pair of blocks is joined by itself. Keys with one block on the right stay where they are on the left, if their counted rows on the right are HELD at
    most; large keys without a partner go nowhere. Both are read more than once; by counts, the columns of a key come first."""
    size = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    large = size(left, "_rows").join(size(right, "_columns"), key, "full").where(f"_rows > {side} or _columns > {side}")
    large = written(large.select(key, F.ceil(F.col("_rows") / side).alias("_rows"), F.ceil(F.col("_columns") / side).alias("_columns"), F.col("_columns").alias("_few")), "large-keys")
    both = large.where("_rows is not null and _columns is not null")
    one = both.where("_columns = 1")
    held = (one.agg(F.sum("_few")).first()[0] or 0) <= HELD
    many = both.where("_columns > 1") if held else both
    a, b = (df.join(large.select(key), key, "left_anti").withColumns({"_row": F.lit(0).cast("long"), "_column": F.lit(0).cast("long")}) for df in (left, right))
    if not many.isEmpty():
        block = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        blocks = many.select(key, "_rows", "_columns")
        a = a.unionByName(left.join(blocks, key).withColumn("_row", block(left_by, "_rows")).withColumn("_column", every("_columns")).drop("_rows", "_columns"))
        b = b.unionByName(right.join(blocks, key).withColumn("_column", block(right_by, "_columns")).withColumn("_row", every("_rows")).drop("_rows", "_columns"))
    out = a.join(b, [key, "_row", "_column"]).drop("_row", "_column")
    few = right.join(one.select(key), key, "left_semi")
    return out.unionByName(left.join(F.broadcast(few), key)) if held and not one.isEmpty() else out


#: Numbers that a row of handed_out() carries at once, about, lines that they meet, about (a sequence so short repeats often in a page of a file), and tasks that it makes at most.
BATCH, RUN, TASKS = 10_000, 250, 20_000


def handed_out(asked: DataFrame, lines: DataFrame, key: str, number: str, by: Sequence[Column], side: int = RUN, batch: int = BATCH) -> DataFrame:
    """asked.join(lines, key) for results far larger than both sides: the column number of asked travels as arrays of about batch values, and about side lines of a key
    (by a hash of what by tells) meet one array in a task, where it is taken apart. A number has its lines in a row, so that files hold the number once for all of them and
    the lines as repeats of one sequence. Tasks are as many as such meetings."""
    size = lambda df, n, name: df.groupBy(key).agg(F.ceil(F.count("*") / n).alias(name))
    large = written(size(lines, side, "_rows").join(size(asked, batch, "_columns"), key).where("_rows > 1 or _columns > 1"), "large-keys")
    meetings = large.agg(F.sum(F.col("_rows") * F.col("_columns"))).first()[0] or 0
    one = lambda name: F.coalesce(F.col(name), F.lit(1).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    others = [c for c in asked.columns if c not in (key, number)]
    a = lines.join(large, key, "left").withColumn("_row", F.pmod(F.xxhash64(*by), one("_rows"))).withColumn("_column", every(one("_columns"))).drop("_rows", "_columns")
    b = asked.join(large, key, "left").withColumn("_column", F.pmod(F.xxhash64(number), one("_columns"))).withColumn("_rows", one("_rows"))
    b = b.groupBy(key, *others, "_rows", "_column").agg(F.collect_list(number).alias("_numbers")).withColumn("_row", every(F.col("_rows"))).drop("_rows")
    meet = [key, "_row", "_column"]
    if meetings > lines.sparkSession.sparkContext.defaultParallelism:  # both sides are small, so adaptive execution would make few tasks
        a, b = (df.repartition(min(int(meetings), TASKS), *meet) for df in (a, b))
    b = b.select(*meet, *others, F.explode("_numbers").alias(number))
    return b.join(a, meet).select(*asked.columns, *[c for c in lines.columns if c != key])


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that the session gives it, so that what opens it outside of the session finds the same place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full
