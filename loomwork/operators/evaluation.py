"""Scoring answers: reference metrics, claim and context judgements, calibration of judges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.stems import stem
from ..functions.text import normalized


def reference_metrics(rows: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """Adds token_f1, normalized_exact_match and rouge_l; without a reference all are null."""
    there = F.trim(F.coalesce(F.col(reference), F.lit(""))) != ""
    return rows.withColumns({
        "token_f1": F.when(there, scores.token_f1(F.col(answer), F.col(reference))),
        "normalized_exact_match": F.when(there, scores.exact_match(F.col(answer), F.col(reference))),
        "rouge_l": F.when(there, rouge_l(F.col(answer), F.col(reference))),
    })


def rouge_l(answer: Column, reference: Column) -> Column:
    """F-measure of the longest common subsequence of a-z0-9 words, rounded to 4 places; words of over three letters count by their stems. Blanks and nulls: 0.

    Bit-parallel: for every word of the answer one step over the reference's words as bits of a whole number.
    """

    def lcs(a: list[str], b: list[str]) -> int:
        places: dict[str, int] = {}
        for k, w in enumerate(b):
            places[w] = places.get(w, 0) | 1 << k
        every = (1 << len(b)) - 1
        rest = every
        for w in a:
            match = rest & places.get(w, 0)
            rest = (rest + match | rest - match) & every
        return len(b) - rest.bit_count()

    def run(answers: pd.Series, references: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(answers, references, strict=True):
            a, b = ([stem(w) if len(w) > 3 else w for w in (v or "").split()] for v in (x, y))
            out.append(round(2 * lcs(a, b) / (len(a) + len(b)), 4) if a and b else 0.0)
        return pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double")(normalized(answer), normalized(reference))


def labelled_claims(claims: DataFrame, replies: DataFrame, default: str = "unsupported") -> DataFrame:
    """claims (response_id, claim_id) with the label that a judge gave in any of the response's replies (response_id, labels map); none: default."""
    given = replies.select("response_id", F.explode("labels").alias("claim_id", "label")).groupBy("response_id", "claim_id").agg(F.max("label").alias("label"))
    return claims.join(given, ["response_id", "claim_id"], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def claim_ratios(labelled: DataFrame) -> DataFrame:
    """Per response the shares of supported, unsupported and contradicted claims."""
    share = lambda label: F.round(F.count_if(F.col("label") == label) / F.count("*"), 4)
    return labelled.groupBy("response_id").agg(F.count("*").alias("claims"), share("supported").alias("custom_faithfulness"), share("unsupported").alias("unsupported_claim_ratio"), share("contradicted").alias("contradicted_claim_ratio"))


def context_precision(flags: DataFrame) -> DataFrame:
    """Average precision of ranked flags (response_id, rank, relevant)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "relevant"))), lambda x: x["relevant"])
    return flags.groupBy("response_id").agg(scores.average_precision(ordered).alias("custom_context_precision"))


def batches(items: DataFrame, size: int, item: str = "item_id") -> DataFrame:
    """Items numbered from 1 in batches of so many, for prompts that carry several."""
    return items.withColumn("batch", F.floor((F.col(item) - 1) / size).cast("int"))


def composites(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"answer_quality_score": scores.answer_quality(), "rag_composite_score": F.when(F.col("rag_enabled"), scores.rag_composite())})


def calibration(expected: DataFrame, judged: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("run_name", "question")) -> DataFrame:
    """Per metric: n, mean expected, mean judged, mean absolute and signed error, correlation (null for fewer than two pairs)."""
    long = lambda d, name: d.unpivot(list(keys), metrics, "metric", name)
    both = long(expected, "expected").join(long(judged, "judged"), [*keys, "metric"], "left").where("expected is not null and judged is not null")
    e = F.col("judged") - F.col("expected")
    return both.groupBy("metric").agg(
        F.count("*").alias("n"), F.round(F.avg("expected"), 4).alias("mean_expected"), F.round(F.avg("judged"), 4).alias("mean_judged"),
        F.round(F.avg(F.abs(e)), 4).alias("mean_absolute_error"), F.round(F.avg(e), 4).alias("mean_signed_error"),
        F.when(F.count("*") > 1, F.round(F.corr("expected", "judged"), 4)).alias("correlation"),
    )


def with_references(questions: DataFrame, make, tries: int = 1) -> DataFrame:
    """questions with golden_answer, the missing ones generated; reference_source says which is which."""
    from ..models import generate
    from .context import plain_prompt

    missing = questions.where("golden_answer is null").withColumn("prompt", plain_prompt(F.col("question")))
    made = generate(missing, make, tries=tries).where("response.success").withColumn("golden_answer", F.col("response.answer"))
    made = made.select(*questions.columns).withColumn("reference_source", F.lit("generated"))
    return questions.where("golden_answer is not null").withColumn("reference_source", F.lit("golden")).unionByName(made)
