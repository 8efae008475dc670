"""A training corpus in five stages: language, near duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import langid, mixing, neardup, packing, substrings
from loomwork.llm.common import table, written
from loomwork.llm.queries import vocabulary

#: Bytes of a batch of rows that goes to a Python worker. Whole texts make batches of 30 MB and more otherwise, which every task holds several times outside of the heap, and the stages share their executors.
BATCH_BYTES = 4 << 20
#: SQL for run()'s rows: language ID and tokens can't be expressed; tests hold the stages against brute force.
ORACLE_SQL = None


def _in_small_batches(spark: SparkSession) -> None:
    """Bounds batches for Python workers by bytes, unless the session does so itself. It holds for the session from then on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: without letters, or far from every language that docs' labels teach."""
    _in_small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model, into="_language").where("not _language.rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every class of near duplicates (five-word shingles, similarity 0.8): that of the least id, then the least hash of the text.

    Rows with the same id and text are one document and leave one row (the least); the same id with another text is another document.
    """
    _in_small_batches(spark)
    own = ["doc_id", "text"]
    th = F.xxhash64("text")
    several = docs.groupBy("doc_id").agg(F.min(th).alias("lo"), F.max(th).alias("hi")).where("doc_id is not null and lo <> hi")
    several = written(several.select("doc_id", F.lit(True).alias("_several")), "several")
    # an id of one text is its own node: in the order of ids the first documents of large groups find most links
    node = F.when(F.col("doc_id").isNull() | F.col("_several"), F.xxhash64(F.col("doc_id").isNull(), *own)).otherwise(F.col("doc_id"))
    nodes = docs.join(several, "doc_id", "left").withColumn("_node", node)
    found = neardup.classes(nodes.select("_node", "text"), "_node", size=5, percent=80).select(F.col("doc_id").alias("_node"), F.col("component_id").alias("_class")).distinct()
    ids = nodes.select("_node", "doc_id").distinct()
    kept = ids.join(found, "_node").groupBy("_class").agg(F.min(F.struct("doc_id", "_node")).getField("_node").alias("_kept"))
    rows = nodes.join(kept, nodes["_node"] == kept["_kept"], "left_semi")
    rest = [c for c in docs.columns if c not in own]
    return rows.groupBy(*own).agg(F.min(F.struct(*rest)).alias("_rest")).select(*[F.col(c if c in own else f"_rest.{c}").alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out repeats of windows of 20 words; documents that are repeats throughout go."""
    _in_small_batches(spark)
    out = substrings.dedup(docs, also=("lang", "source", "n_chars")).where("kept is null or kept <> ''")
    text = F.coalesce("kept", "text")
    size = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long")
    return out.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as its source's target asks for."""
    return mixing.emit(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences. Workers that served the other stages keep fewer words."""
    _in_small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), kept=500_000)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
