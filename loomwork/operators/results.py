"""Results of runs: routes of questions, modes, flat rows, where an answer comes from, calibration payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text

#: Words that send a question to the web, and words of analytic questions.
WEB_TERMS = ("international import", "international imports", "imports", "growing fastest", "growing", "demand", "regionally", "workforce capacity", "shifting from ice", "ice components")
ANALYTIC_TERMS = ("highest", "lowest", "versus", " vs ", "compare", "comparison", "concentration", "risk", "bottleneck", "dependencies", "cluster", "clusters", "outside of major metros", "combine", "counties")


def route(question: Column) -> Column:
    """web_needed, else analytic, else lookup."""
    q = F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\s+", " "))
    return F.when(text.contains_any(q, WEB_TERMS), "web_needed").when(text.contains_any(q, ANALYTIC_TERMS), "analytic").otherwise("lookup")


def local_k(label: Column, k: int) -> Column:
    return F.when(label == "analytic", F.greatest(F.lit(k), F.lit(7))).otherwise(k)


def web_k(label: Column, k: int) -> Column:
    return F.when(label == "web_needed", F.greatest(F.lit(k), F.lit(5))).when(label == "analytic", F.greatest(F.lit(k), F.lit(4))).otherwise(k)


def with_modes(rows: DataFrame) -> DataFrame:
    """mode and model_display where they are missing: from rag_enabled, else from the run's name (_no_rag before _rag)."""
    name = F.col("run_name")
    by_name = F.when(name.endswith("_no_rag"), "no_rag").when(name.endswith("_rag"), "rag").otherwise("no_rag")
    flag = F.when(F.col("rag_enabled").cast("boolean"), "rag").when(~F.col("rag_enabled").cast("boolean"), "no_rag") if "rag_enabled" in rows.columns else F.lit(None).cast("string")
    new = {"mode": F.coalesce(flag, by_name), "model_display": F.regexp_replace(name, "_(no_rag|rag)$", "")}
    return rows.withColumns({k: c for k, c in new.items() if k not in rows.columns})


def split_sources(mode: Column, answer: Column, cited: Column, retrieved: Column) -> Column:
    """struct(knowledge, pretrained): without retrieval all is pretrained; else what is cited, or retrieved at all, is knowledge, and lines beginning with Evidence: always are."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.rtrim(x))
    evidence = lambda x: F.lower(F.trim(x)).startswith("evidence:")
    joined = lambda keep: F.regexp_replace(F.array_join(F.filter(lines, keep), "\n"), r"^\s+|\s+$", "")
    content, proof = joined(lambda x: ~evidence(x)), joined(evidence)
    known = (cited > 0) | (retrieved > 0)
    knowledge = F.array_join(F.filter(F.array(F.when(known, content).otherwise(""), proof), lambda x: x != ""), "\n")
    return F.when(mode == "no_rag", F.struct(F.lit("").alias("knowledge"), F.coalesce(answer, F.lit("")).alias("pretrained"))).otherwise(F.struct(knowledge.alias("knowledge"), F.when(known, "").otherwise(content).alias("pretrained")))


def flat(responses: DataFrame) -> DataFrame:
    """Responses with their struct of generation spread into columns, with token totals, citations and words."""
    total = F.coalesce("response.prompt_tokens", F.lit(0)) + F.coalesce("response.completion_tokens", F.lit(0))
    answer = F.col("response.answer")
    rest = [c for c in responses.columns if c != "response"]
    return responses.select(*rest, "response.*", total.alias("tokens_total"), text.abstained_marker(answer).alias("abstained"), text.word_count(answer).alias("response_length_words"), F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[E\s*\d+\]"), 0))).alias("citation_count"))


def calibration_payload(rows: DataFrame) -> DataFrame:
    """Retrieval results of calibration rows (row_id, retrieved_contexts): rank from 1, text, final_score 1 / rank."""
    out = rows.select("row_id", F.posexplode(scores.contexts(F.col("retrieved_contexts"))).alias("at", "text"))
    return out.select("row_id", (F.col("at") + 1).alias("rank"), "text", (1.0 / (F.col("at") + 1)).alias("final_score"))


def retrieval_log(hits: DataFrame, kind: str, body: str = "text") -> DataFrame:
    """One row per question: its hits in order as structs, and as blocks of text."""
    item = F.struct("rank", F.lit(kind).alias("source_kind"), "chunk_id", F.round("final_score", 5).alias("score"), text.preview(F.col(body)).alias("preview"))
    out = hits.groupBy("q_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    return out.withColumn("blocks", F.array_join(F.transform("hits", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["chunk_id"].cast("string"), F.lit("\n"), x["preview"])), "\n\n"))
