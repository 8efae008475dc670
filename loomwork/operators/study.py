"""The report set of a study: six tables and a written report, from all scored responses, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import markdown_table, write_report
from ..tables import written
from . import reports
from .results import with_modes

#: Metrics that hold for both modes, for retrieval only, of operation, and of the questions' diagnostics; the scores that boards are sorted by.
BOTH = ("answer_accuracy", "rouge_l", "token_f1", "semantic_similarity", "normalized_exact_match", "answer_quality_score", "ragas_answer_correctness")
RETRIEVAL = (
    "custom_faithfulness", "custom_response_groundedness", "custom_context_precision", "custom_context_recall", "ragas_faithfulness", "ragas_context_precision", "ragas_context_recall",
    "unsupported_claim_ratio", "contradicted_claim_ratio", "citation_coverage", "rag_composite_score",
)
OPERATION = ("success", "abstained", "response_length_words", "latency_seconds", "tokens_in", "tokens_out", "citation_count")
DIAGNOSED = ("answer_accuracy", "answer_quality_score", "rouge_l")
SORTED_BY = ("rag_composite_score", "answer_quality_score")
#: Rows of a table that the report shows, and of the questions' diagnostics.
SHOWN, SHOWN_QUESTIONS = 20, 15


def tables(results: DataFrame) -> dict[str, DataFrame]:
    """The six tables of scored responses (run_name, q_id, question and what there is of metrics): means leave out nulls, boards rank the best first, nulls last, ties by their keys. Metrics that results lack are absent; a table without any is left out."""
    rows = with_modes(results)
    number = lambda names: [c for c in names if c in rows.columns]
    rows = rows.withColumns({c: F.col(c).cast("double") for c in number(BOTH + RETRIEVAL + OPERATION)})
    both, retrieval, operation = number(BOTH), number(RETRIEVAL), number(OPERATION)
    by = lambda names, first=SORTED_BY[1]: next((c for c in (first, SORTED_BY[1]) if c in names), names[0])
    out = {}
    if both:
        out["leaderboard_cross_mode"] = reports.leaderboard(rows, ["run_name", "mode", "model_display"], both, by(both))
    if retrieval or both:
        out["leaderboard_rag_only"] = reports.leaderboard(rows.where("mode = 'rag'"), ["run_name", "model_display"], retrieval + both, by(retrieval + both, SORTED_BY[0]))
    if both or operation:
        out["summary_per_model"] = reports.means(rows, ["model_display"], both + operation, by(both + operation))
        out["summary_per_mode"] = reports.means(rows, ["mode"], both + operation, None).orderBy("mode")
    if both or retrieval or operation:
        out["summary_per_model_per_mode"] = reports.means(rows, ["run_name", "model_display", "mode"], both + retrieval + operation, by(both + retrieval + operation))
    if (diagnosed := number(DIAGNOSED)) and "q_id" in rows.columns:
        out["diagnostics_per_question"] = reports.diagnostics(rows, "q_id", diagnosed, "question" if "question" in rows.columns else None).orderBy("q_id")
    return out


def report(results: DataFrame, made: dict[str, DataFrame]) -> str:
    """The report as Markdown: counts and rates, the tables' first rows, the questions of the largest deviation, success and abstention by run and mode."""
    rows = with_modes(results)
    have = [c for c in ("success", "abstained") if c in rows.columns]
    distinct = [F.count_distinct(c).alias(c) if c in rows.columns else F.lit(None).alias(c) for c in ("model_display", "mode", "q_id")]
    total = rows.agg(F.count("*").alias("n"), *distinct, *[F.avg(F.col(c).cast("double")).alias(f"_{c}") for c in have]).first()
    percent = lambda c: "unknown" if c not in have or total[f"_{c}"] is None else f"{100 * total[f'_{c}']:.1f} %"
    shown = lambda name, n=SHOWN: markdown_table(made[name], n) if name in made else "No data."
    told = lambda v: "unknown" if v is None else v
    parts = [
        "# Study report", f"{total['n']} responses of {told(total['model_display'])} models in {told(total['mode'])} modes to {told(total['q_id'])} questions; success {percent('success')}, abstention {percent('abstained')}.",
        "Boards over both modes rank by answer quality, which needs no retrieval; the retrieval board ranks by its own composite and holds for that mode alone.",
        "## Both modes", shown("leaderboard_cross_mode"), "## Retrieval only", shown("leaderboard_rag_only"), "## Models", shown("summary_per_model"), "## Modes", shown("summary_per_mode"), "## Questions",
    ]
    questions = made.get("diagnostics_per_question")
    if questions is not None and "answer_quality_score_std" in questions.columns:
        questions = questions.orderBy(F.desc_nulls_last("answer_quality_score_std"), "q_id")
    parts += ["No data." if questions is None else markdown_table(questions.limit(SHOWN_QUESTIONS), SHOWN_QUESTIONS), "## Failures and abstentions"]
    parts.append(markdown_table(reports.rates(rows, ["run_name", "mode"], have).orderBy("run_name", "mode"), SHOWN) if have else "No data.")
    return "\n\n".join(parts) + "\n"


def write(results: DataFrame, root: str) -> list[str]:
    """Writes the tables as CSV in folders under root and the report as text to root/STUDY_REPORT; tells where."""
    results = written(results, "study")  # read for every table
    made = tables(results)
    paths = write_report(made, root, "csv")
    results.sparkSession.createDataFrame([(report(results, made),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/STUDY_REPORT")
    return [*paths, f"{root}/STUDY_REPORT"]
