"""The report set of a study."""

from loomwork.operators import study

COLUMNS = "run_name string, q_id string, question string, answer_quality_score double, rouge_l double, rag_composite_score double, success boolean, abstained boolean"
ROWS = [
    ("m1_rag", "1", "Who?", 0.9, 0.5, 0.8, True, False), ("m1_rag", "2", "Where?", 0.7, None, 0.6, True, True), ("m1_no_rag", "1", "Who?", 0.2, 0.1, None, True, False),
    ("m2_rag", "1", "Who?", None, 0.3, 0.9, False, False), ("m2_no_rag", "2", "Where?", 0.7, 0.2, None, True, False),
]


def test_tables(spark):
    made = study.tables(spark.createDataFrame(ROWS, COLUMNS))
    assert list(made) == ["leaderboard_cross_mode", "leaderboard_rag_only", "summary_per_model", "summary_per_mode", "summary_per_model_per_mode", "diagnostics_per_question"]
    board = made["leaderboard_cross_mode"].orderBy("rank").collect()
    assert [(r["rank"], r.run_name, r.answer_quality_score) for r in board] == [(1, "m1_rag", 0.8), (2, "m2_no_rag", 0.7), (3, "m1_no_rag", 0.2), (4, "m2_rag", None)]
    assert [r.run_name for r in made["leaderboard_rag_only"].orderBy("rank").collect()] == ["m2_rag", "m1_rag"]
    assert {r.model_display: r.success for r in made["summary_per_model"].collect()} == {"m1": 1.0, "m2": 0.5}
    assert {r.q_id: (r.answer_quality_score_min, r.question) for r in made["diagnostics_per_question"].collect()} == {"1": (0.2, "Who?"), "2": (0.7, "Where?")}


def test_written_report(spark, tmp_path):
    paths = study.write(spark.createDataFrame(ROWS, COLUMNS), str(tmp_path))
    assert len(paths) == 7 and spark.read.csv(f"{tmp_path}/leaderboard_cross_mode", header=True).count() == 4
    told = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/STUDY_REPORT").collect())
    assert "5 responses of 2 models in 2 modes to 2 questions; success 80.0 %, abstention 20.0 %." in told and "| m1_rag | rag | 2 | 100.0 | 50.0 |" in told


def test_what_is_not_there_is_left_out(spark):
    bare = spark.createDataFrame([("m_rag", 0.5)], "run_name string, custom_faithfulness double")
    assert list(study.tables(bare)) == ["leaderboard_rag_only", "summary_per_model_per_mode"]
    assert "success unknown" in study.report(bare, study.tables(bare)) and study.tables(bare.select("run_name")) == {}
    empty = spark.createDataFrame([], COLUMNS)
    assert "0 responses" in study.report(empty, study.tables(empty))
