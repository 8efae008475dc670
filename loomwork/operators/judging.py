"""Judged metrics: prompts for all responses go through one generating stage, replies are parsed, joined back and aggregated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, segments
from ..models import Generator, generate
from ..tables import written
from . import evaluation

CLAIMS, UNITS, CONTEXTS = 16, 24, 10  # items of one prompt


def claims(responses: DataFrame, answer: str = "answer") -> DataFrame:
    """response_id, claim_id (from 1), claim: the units of each answer."""
    return responses.select("response_id", F.posexplode(segments.units(F.col(answer))).alias("at", "claim")).select("response_id", (F.col("at") + 1).alias("claim_id"), "claim")


def _listed(id_: str, body: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(id_, body)))
    return F.array_join(F.transform(items, lambda x: F.concat(x[id_].cast("string"), F.lit(". "), x[body])), "\n")


def _judged(items: DataFrame, evidence: DataFrame, make: Callable[[], Generator], task: str, size: int, labels: tuple[str, ...], default: str, tries: int) -> DataFrame:
    """items (response_id, claim_id, claim) with a label each: a batch of items is one prompt; a reply that can't be parsed is asked for again, tries times in all."""
    todo = evaluation.batches(items, size, "claim_id").groupBy("response_id", "batch").agg(_listed("claim_id", "claim").alias("list"))
    todo = todo.join(evidence.select("response_id", "evidence"), "response_id", "left")
    shape = '{"labels":[{"claim_id":1,"label":"' + labels[0] + '"}]}'
    prompt = F.concat(F.lit(f"{task}\nLabels: {', '.join(labels)}. When in doubt: {default}.\n\nEvidence:\n"), F.coalesce("evidence", F.lit("none")), F.lit("\n\nItems:\n"), F.col("list"), F.lit(f"\n\nReply with JSON of this shape only:\n{shape}"))
    todo = todo.withColumn("prompt", prompt)
    replies = None
    for k in range(tries):
        asked = todo.withColumn("prompt", F.concat("prompt", F.lit("\n" * k))) if k else todo
        got = generate(asked, make).select("response_id", "batch", scores.claim_labels(F.col("response.answer"), labels).alias("labels"))
        got = written(got, "judged")  # read twice, asked once
        good = got.where("labels is not null")
        replies = good if replies is None else replies.unionByName(good)
        todo = todo.join(good.select("response_id", "batch"), ["response_id", "batch"], "left_anti")
    return evaluation.labelled_claims(items, replies, default)


def faithfulness(responses: DataFrame, evidence: DataFrame, make: Callable[[], Generator], tries: int = 2) -> DataFrame:
    """Per response: claims, and the shares that its evidence supports, does not support and contradicts."""
    labelled = _judged(claims(responses), evidence, make, "Say for each item whether the evidence supports it.", CLAIMS, ("supported", "unsupported", "contradicted"), "unsupported", tries)
    return evaluation.claim_ratios(labelled)


def context_recall(references: DataFrame, evidence: DataFrame, make: Callable[[], Generator], tries: int = 2) -> DataFrame:
    """Per response the share of its reference answer's claims that the evidence supports."""
    labelled = _judged(claims(references, "reference"), evidence, make, "Say for each item whether the evidence supports it.", CLAIMS, ("supported", "unsupported", "contradicted"), "unsupported", tries)
    return evaluation.claim_ratios(labelled).select("response_id", F.col("custom_faithfulness").alias("custom_context_recall"))


def context_precision(contexts: DataFrame, questions: DataFrame, make: Callable[[], Generator], tries: int = 2) -> DataFrame:
    """Average precision of ranked contexts (response_id, rank, text) by their relevance to the question (response_id, evidence)."""
    items = contexts.select("response_id", F.col("rank").alias("claim_id"), F.col("text").alias("claim"))
    labelled = _judged(items, questions, make, "The evidence is a question. Say for each item whether it helps to answer it.", CONTEXTS, ("relevant", "irrelevant"), "irrelevant", tries)
    return evaluation.context_precision(labelled.select("response_id", F.col("claim_id").alias("rank"), (F.col("label") == "relevant").alias("relevant")))


def attribution(responses: DataFrame, evidence: DataFrame, make: Callable[[], Generator], tries: int = 2) -> DataFrame:
    """Per response the units of its answer by where they come from: knowledge_source and pretrained, each joined in order."""
    units = claims(responses)
    labelled = _judged(units, evidence, make, "Say for each item whether it comes from the evidence.", UNITS, ("knowledge_source", "pretrained"), "pretrained", tries)
    of = lambda label: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("claim_id", "claim")))), lambda x: x["claim"]), " ").alias(label)
    return labelled.groupBy("response_id").agg(of("knowledge_source"), of("pretrained"))


def dual(prompts: DataFrame, make: Callable[[], Generator], *, rating: int | None = None, into: str = "score", tries: int = 2) -> DataFrame:
    """prompts (response_id, prompt, several a response): the mean of the scores (or of ratings 0..rating, scaled) that can be read, to 4 places; null if none can. What can't be read is asked for again, tries times in all."""
    answer = F.col("response.answer")
    value = scores.judge_score(answer) if rating is None else F.round(scores.judge_rating(answer, tuple(range(rating + 1))) / rating, 4)
    todo = written(prompts.select("response_id", "prompt").withColumn("_call", F.monotonically_increasing_id()), "judge-prompts")
    every, replies = todo, None
    for _ in range(max(1, tries)):
        got = written(generate(todo, make).select("response_id", "_call", value.alias("_value")), "judge-scores")
        good = got.where("_value is not null")
        replies = good if replies is None else replies.unionByName(good)
        todo = todo.join(good.select("_call"), "_call", "left_anti")
    return every.join(replies.select("_call", "_value"), "_call", "left").groupBy("response_id").agg(F.round(F.avg("_value"), 4).alias(into))
