"""Writers: named tables of a report, response logs, Markdown, and a vector index with its manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import fingerprint


def write_report(tables: dict[str, DataFrame], root: str, form: str = "parquet") -> list[str]:
    """Every table in a folder of its own under root."""
    for name, d in tables.items():
        writer = d.write.mode("overwrite")
        writer.option("header", True).csv(f"{root}/{name}") if form == "csv" else writer.format(form).save(f"{root}/{name}")
    return [f"{root}/{name}" for name in tables]


def write_responses(responses: DataFrame, root: str) -> None:
    """All responses as CSV by run, and a Markdown file of each run's answers."""
    responses.write.mode("overwrite").option("header", True).partitionBy("run_name").csv(f"{root}/responses")
    block = F.concat(F.lit("## "), F.col("question"), F.lit("\n\n"), F.coalesce("answer", F.lit("")), F.lit("\n"))
    responses.select("run_name", block.alias("value")).repartition("run_name").sortWithinPartitions("run_name", "value").write.mode("overwrite").partitionBy("run_name").text(f"{root}/markdown")


def append_log(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON, added to what is there."""
    rows.write.mode("append").json(path)


def markdown_table(d: DataFrame, most: int = 100) -> str:
    """A small result (most rows of it) as a Markdown table; what it leaves out is told below it."""
    rows = d.limit(most + 1).collect()
    left = d.count() - most if len(rows) > most else 0
    shown = lambda v: "" if v is None else str(v).replace("|", r"\|").replace("\n", " ")
    lines = ["| " + " | ".join(d.columns) + " |", "|" + "---|" * len(d.columns), *("| " + " | ".join(map(shown, r)) + " |" for r in rows[:most])]
    return "\n".join(lines + ([f"\n{left} more rows"] if left else []))


def write_index(chunks: DataFrame, root: str, model: str, version: int = 2) -> dict:
    """chunks (chunk_id, text, embedding, ...) as Parquet with a manifest of their number and fingerprint."""
    chunks.write.mode("overwrite").parquet(f"{root}/vectors")
    stored = chunks.sparkSession.read.parquet(f"{root}/vectors")
    found = {"version": version, "model": model, "chunks": stored.count(), "fingerprint": fingerprint(stored, model).first()[0]}
    chunks.sparkSession.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return found


def read_index(spark: SparkSession, root: str, chunks: DataFrame, model: str) -> DataFrame | None:
    """The stored vectors if they are those of chunks and model, else nothing: they must be made again."""
    try:
        found = json.loads(spark.read.text(f"{root}/manifest").first()[0])
    except Exception as e:  # no index yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    same = found["model"] == model and found["fingerprint"] == fingerprint(chunks, model).first()[0]
    return spark.read.parquet(f"{root}/vectors") if same else None
