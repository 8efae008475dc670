"""Compact context as a fold: selection, the pinned summary, budgets."""

import pytest

from loomwork.operators import compact

COLUMNS = "q_id int, chunk_id string, chunk_type string, text string, company string, category string, primary_oems string, location string, employment string, primary_facility_type string, row_summary string, row_key string, source_file string, sheet_name string, row_number string, final_score double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def hit(**v):
    return tuple({"source_file": "input.xlsx", "sheet_name": "Data", "company": ""} .get(c) if c not in v else v[c] for c in NAMES)


def made(spark, asked, hits, **limits):
    q = spark.createDataFrame(list(asked.items()), "q_id int, question string")
    rows = [hit(q_id=k, **h) for k, hs in hits.items() for h in hs]
    return {r.q_id: r for r in compact.segments(q, spark.createDataFrame(rows, COLUMNS), **limits).collect()}


def row(n, company, score, kind="row_full", **more):
    told = f"Company: {company} | Updated Location: {more.get('location', 'Troup County')} | Primary OEMs: {more.get('primary_oems', 'Kia')}"
    return {"chunk_id": f"r{n}", "chunk_type": kind, "text": told, "company": company, "row_summary": told, "row_key": f"row-{n}", "row_number": str(n), "final_score": score, "location": "Troup County", "primary_oems": "Kia"} | more


SUMMARY = {"chunk_id": "s", "chunk_type": "structured_match_summary", "text": "Structured workbook matches from exact metadata filters:\nMatched rows: 6\nDetailed rows:", "final_score": 1.0}


def test_network_questions_take_more_and_keep_whole_rows(spark):
    asked = "Show all Vehicle Assembly OEMs in Georgia and the full set of Tier 1 suppliers connected to each within the state."
    hits = [SUMMARY, row(1, "Alpha", 0.99, "structured_row_match"), row(2, "Beta", 0.98, "structured_row_match")] + [row(k, f"Firm {k}", 1 - k / 100) for k in (3, 4, 5)]
    got = made(spark, {1: asked}, {1: hits}, most=4, chars=6000)[1]
    assert len(got.blocks) == 6 and got.blocks[0].startswith("[Evidence 1] type=structured_match_summary company=n/a source=input.xlsx::Data\nStructured workbook")
    assert got.blocks[1] == "[Evidence 2] type=structured_row_match company=Alpha source=input.xlsx::Data row=1\nCompany: Alpha | Updated Location: Troup County | Primary OEMs: Kia"
    assert got.context.startswith("[E1] [Evidence 1]") and "\n\n[E6] [Evidence 6]" in got.context


def test_rows_of_one_company_stay_where_several_are_asked_for(spark):
    asked = {1: "What locations does Novelis Inc. operate in, and what primary facility types are associated with each location?", 2: "Who is Novelis?"}
    hits = [row(k, "Novelis Inc.", 1 - k / 100, location=p) for k, p in enumerate(("Gainesville", "Trenton", "Lawrenceville"))]
    got = made(spark, asked, {1: hits, 2: hits}, most=3, chars=3000)
    assert [p in got[1].context for p in ("Gainesville", "Trenton", "Lawrenceville")] == [True] * 3
    assert len(got[2].blocks) == 1 and got[2].blocks[0].endswith("\nCompany: Novelis Inc. | Updated Location: Gainesville | Primary OEMs: Kia")


def test_sparse_metadata_falls_back_to_the_row(spark):
    bare = row(1, "PPG", 0.9) | {"location": None, "primary_oems": None}
    got = made(spark, {1: "Show all Tier 1 suppliers linked to Kia within the state.", 2: "Describe it"}, {1: [bare], 2: [bare]}, most=1, chars=1000)
    assert "Primary OEMs: Kia" in got[1].blocks[0] and "Updated Location: Troup County" in got[2].blocks[0]


def test_notes_rows_and_budgets(spark):
    note = lambda k: {"chunk_id": f"n{k}", "chunk_type": "note_reference", "text": f"note {k} " * 40, "final_score": 0.5}
    long = SUMMARY | {"text": "\n".join(["Counts by County:"] + [f"- County {k}: {k}" for k in range(200)])}
    asked = {1: "define tier", 2: "anything", 3: "count them", 4: "count them", 5: "nothing found", 6: None}
    hits = {1: [note(1), note(2), row(1, "A", 0.4)], 2: [note(1), row(1, "A", 0.4), row(1, "A", 0.3)], 3: [long, row(1, "A", 0.4)], 4: [long]}
    got = made(spark, asked, hits, most=5, chars=1000)
    assert ["type=note_reference" in b for b in got[1].blocks] == [True, False] and len(got[2].blocks) == 1
    first = got[3].blocks[0]
    assert first.endswith("\n...") and len(first) <= 450 + 4 and len(got[3].blocks) == 2
    assert 900 < len(got[4].blocks[0]) <= 1000 + 4 and got[5].blocks == ["No retrieved evidence."] == [got[6].context]
    tight = made(spark, {1: "Who?"}, {1: [row(k, f"F{k}", 1 - k / 100, text="x" * 900, row_summary="x" * 900, location=None, primary_oems=None) for k in range(4)]}, most=4, chars=700)[1]
    assert len(tight.blocks) == 1 and tight.blocks[0].endswith("...") and len(tight.blocks[0]) <= 700
    with pytest.raises(Exception):
        compact.segments(spark.createDataFrame([(1,)], "q_id int"), spark.createDataFrame([], COLUMNS)).collect()
