"""Leaderboards, summaries, diagnostics and the joins that put results side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .quantiles import quantile


def with_golden(questions: DataFrame, golden: DataFrame) -> DataFrame:
    """questions (q_id, question) with golden_answer: by q_id, else by the question's normal form; matched says which, null if none.

    golden (q_id, question, golden_answer, at): of several rows of a key the last by at counts.
    """
    last = lambda key, name: golden.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{name}")).agg(F.max_by("golden_answer", "at").alias(f"_{name}_answer"))
    golden = golden.withColumn("norm", text.normalized(F.col("question")))
    out = questions.join(last("q_id", "id"), F.col("q_id") == F.col("_id"), "left")
    out = out.withColumn("_q", text.normalized(F.col("question"))).join(last("norm", "text"), F.col("_q") == F.col("_text"), "left")
    how = F.when(F.col("_id_answer").isNotNull(), "id").when(F.col("_text_answer").isNotNull(), "text")
    return out.select(*questions.columns, F.coalesce("_id_answer", "_text_answer").alias("golden_answer"), how.alias("matched"))


def means(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], sort: str | None = None, digits: int = 4) -> DataFrame:
    """Mean of every metric by keys, nulls and NaN left out, rounded."""
    mean = lambda m: F.round(F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))), digits).alias(m)
    out = rows.groupBy(*keys).agg(*[mean(m) for m in metrics])
    return out.orderBy(F.desc_nulls_last(sort), *keys) if sort else out


def leaderboard(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], sort: str) -> DataFrame:
    """means() with a rank from 1: the best first, nulls last, ties by keys. The ranks are of groups, a few rows."""
    out = means(rows, keys, metrics)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(sort), *keys)))


def summaries(rows: DataFrame, sets: Sequence[Sequence[str]], metrics: Sequence[str]) -> DataFrame:
    """means() by several sets of keys in one pass; keys that a row isn't grouped by are null and level says by which it is."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("_g"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])
    bits = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): "+".join(s) or "all" for s in sets}
    level = reduce(lambda c, kv: c.when(F.col("_g") == kv[0], kv[1]), bits.items(), F.when(F.lit(False), F.lit(None)))
    return out.withColumn("level", level).drop("_g")


def diagnostics(rows: DataFrame, key: str, metrics: Sequence[str], also: str | None = None) -> DataFrame:
    """Per question mean, sample deviation and least value of each metric, and the first text by order."""
    aggs = [f(m) for m in metrics for f in (lambda m: F.round(F.avg(m), 4).alias(f"{m}_mean"), lambda m: F.round(F.stddev_samp(m), 4).alias(f"{m}_std"), lambda m: F.round(F.min(m), 4).alias(f"{m}_min"))]
    return rows.groupBy(key).agg(*aggs, *([F.min(also).alias(also)] if also else []))


def rates(rows: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rows per key and the percentage of each flag."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.round(F.avg(F.col(f).cast("double")) * 100, 2).alias(f"{f}_pct") for f in flags])


def side_by_side(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Frames of several modes, full outer by keys, their other columns suffixed with the mode."""
    parts = [d.select(*keys, *[F.col(c).alias(f"{c}_{mode}") for c in d.columns if c not in keys]) for mode, d in frames.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), parts)


def pivot(rows: DataFrame, key: str, run: str, runs: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key, a column for every run and metric, runs in the order given (stated, so no pass finds them)."""
    return rows.groupBy(key).pivot(run, list(runs)).agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])


def low_scores(hits: DataFrame, key: str = "q_id", score: str = "score", at: float = 0.10) -> DataFrame:
    """Questions whose best score is at or below that quantile (linear) of all best scores: key, top_score, threshold."""
    best = hits.where(F.col(score).isNotNull()).groupBy(key).agg(F.max(score).alias("top_score"))
    cut = quantile(best, "top_score", at, into="threshold")  # one row
    return best.join(F.broadcast(cut)).where("top_score <= threshold")


def isolation(rows: DataFrame) -> DataFrame:
    """Responses that break their mode's rules: q_id, mode, violation. Without retrieval nothing is retrieved or cited; local retrieval has no web results or citations."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    none, local = F.col("mode") == "no_rag", F.col("mode") == "local_rag"
    rules = {
        "local_retrieval": none & n("local_retrieval_count"), "web_retrieval": (none | local) & n("web_retrieval_count"),
        "doc_citations": none & n("doc_citation_count"), "web_citations": (none | local) & n("web_citation_count"),
        "missing_retrieval": local & ~n("local_retrieval_count"),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select("q_id", "mode", F.explode(hits).alias("violation"))


def problems(rows: DataFrame, violations: DataFrame, low: DataFrame) -> DataFrame:
    """q_id, issue_score: 2 for each violation, 1 each for abstaining, a citation mismatch, no citation matched, a low score (q_id, mode). The worst first."""
    point = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    flagged = rows.join(low.select("q_id", "mode").distinct().withColumn("_low", F.lit(True)), ["q_id", "mode"], "left")
    own = flagged.select("q_id", (point(F.col("abstained")) + point(F.col("citation_mismatch")) + point(F.col("citation_match_ratio") == 0) + point(F.col("_low"))).alias("p"))
    both = own.unionAll(violations.select("q_id", F.lit(2).alias("p")))
    return both.groupBy("q_id").agg(F.sum("p").alias("issue_score")).where("issue_score > 0").orderBy(F.desc("issue_score"), "q_id")


def derived(responses: DataFrame, retrieved: DataFrame) -> DataFrame:
    """responses (q_id, mode, answer) with citations, counts, abstention, words, and how many citations are among retrieved (q_id, mode, chunk_id)."""
    ids = retrieved.groupBy("q_id", "mode").agg(F.collect_set(F.col("chunk_id").cast("string")).alias("_ids"))
    docs, web = text.doc_citations(F.col("answer")), text.web_citations(F.col("answer"))
    out = responses.join(ids, ["q_id", "mode"], "left").withColumns({"doc_citations": docs, "web_citations": web})
    every = F.concat("doc_citations", "web_citations")
    found = F.size(F.array_intersect(every, F.coalesce("_ids", F.array().cast("array<string>"))))
    out = out.withColumns({"citation_count_total": F.size(every), "citation_match_ratio": F.when(F.size(every) > 0, F.round(found / F.size(every), 3))})
    return out.withColumns({"has_any_citations": F.col("citation_count_total") > 0, "citation_mismatch": F.coalesce(F.col("citation_match_ratio") < 1, F.lit(False)), "abstained": text.abstained(F.col("answer")), "answer_word_count": text.word_count(F.col("answer"))}).drop("_ids")


def merge_metrics(responses: DataFrame, metrics: DataFrame, keys: Sequence[str] = ("run_name", "q_id")) -> DataFrame:
    """responses with all metrics by one left join; where both have a column, the metric's value wins unless it is null."""
    same = [c for c in metrics.columns if c in responses.columns and c not in keys]
    named = metrics.select(*keys, *[F.col(c).alias(f"_{c}") if c in same else F.col(c) for c in metrics.columns if c not in keys])
    out = responses.join(named, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in same}).drop(*[f"_{c}" for c in same])


def coverage(frames: dict[str, DataFrame], key: str = "q_id") -> DataFrame:
    """One row: the keys of every mode, those that all have, those that any has."""
    every = reduce(DataFrame.unionAll, [d.select(key, F.lit(m).alias("_mode")) for m, d in frames.items()]).distinct()
    modes = every.groupBy(key).agg(F.collect_set("_mode").alias("_modes"))
    each = [F.count_if(F.array_contains("_modes", m)).alias(f"{m}_keys") for m in frames]
    return modes.agg(*each, F.count_if(F.size("_modes") == len(frames)).alias("in_all"), F.count("*").alias("in_any"))


def review_template(responses: DataFrame, problems_: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """q_id, question, mode, answer with empty columns for a reviewer, the worst questions first."""
    out = responses.select("q_id", "question", "mode", "answer", *[F.lit("").alias(c) for c in ("correct", "grounded", "comment")])
    order = [F.col("q_id"), F.col("mode")]
    if problems_ is not None:
        out, order = out.join(problems_, "q_id", "left"), [F.desc_nulls_last("issue_score"), *order]
    out = out.orderBy(*order)
    return out.limit(most) if most else out
