import json
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork import models, settings
from loomwork.operators import analytics, context, dense_index, evaluation, filters, judging, quantiles, reports, results, retrieval, rows, summaries
from loomwork.plans import planner
from loomwork.sources import documents, ordinals, sinks, tables
from loomwork.streaming import events

HEADERS = ["Company", "Category", "Location", "Updated Location", "Address", "EV Supply Chain Role", "Primary OEMs", "Employment", "Product / Service", "EV / Battery Relevant", "Primary Facility Type", "Supplier or Affiliation Type"]
SHEET = [
    ("Alpha", "OEM", "Old County", "Troup County", "1 Rd, Town, GA 31833", "Vehicle Assembly", "", "2,700", "Cars", "Yes", "Manufacturing", ""),
    ("Beta", "OEM", "Montgomery, Alabama", "", "", "Vehicle Assembly", "", "3000", "Cars", "Yes", "Engineering and Manufacturing", ""),
    ("Gamma", "Tier 1", "LaGrange, Troup County", "", "Georgia", "Battery Pack", "Alpha", "150", "battery pack systems", "Yes", "Manufacturing", "Supplier"),
    ("Delta", "Tier 1", "LaGrange, Troup County", "", "Georgia", "Battery Pack", "Alpha Beta Motors", "90", "wire and harness", "Indirect", "Manufacturing", "Supplier"),
    ("Epsilon", "Tier 2/3", "Macon, Bibb County", "", "GA", "Battery Pack", "Multiple OEMs", "200,000", "copper foil", "No", "Office", "Supplier"),
    ("Gamma", "Tier 2/3", "Macon, Bibb County", "", "GA", "Thermal Parts and Cooling Plates", "Alpha", "", "sensor", "Indirect", "Office", "Supplier"),
]


@pytest.fixture(scope="module")
def sheet(spark):
    data = [("f.xlsx", "Data", k, {h: v for h, v in zip(HEADERS, r, strict=True) if v}) for k, r in enumerate(SHEET, 1)]
    return spark.createDataFrame(data, "source_file string, sheet_name string, row_number int, values map<string,string>").cache()


@pytest.fixture(scope="module")
def wide(sheet):
    return rows.wide_rows(sheet).cache()


def pairs(d, *columns):
    return [tuple(r) for r in d.select(*columns).collect()]


def test_wide_rows(wide, sheet):
    got = {r["row_number"]: r for r in wide.collect()}
    assert got[1]["location"] == "Troup County" and got[1]["state"] == "Georgia" and got[1]["county"] == "Troup County"
    assert got[2]["state"] == "Alabama" and got[2]["city"] == "Montgomery" and got[2]["employment_num"] == 3000
    assert got[5]["is_global_outlier"] and got[6]["employment_num"] is None and got[6]["employment"] == ""
    assert got[1]["row_summary"].startswith("Company: Alpha | Category: OEM") and "Primary OEMs" not in got[1]["row_summary"]
    assert rows.wide_rows(sheet.union(sheet)).count() == 6


def test_row_chunks(sheet):
    c = rows.row_chunks(sheet)
    kinds = {r["chunk_type"]: r["count"] for r in c.groupBy("chunk_type").count().collect()}
    assert kinds == {"row_full": 6, "company_profile": 6, "identity_theme": 6, "location_theme": 6, "supply_chain_theme": 6, "product_theme": 6}
    assert c.select("chunk_id").distinct().count() == 36
    assert rows.row_chunks(sheet.withColumn("source_file", F.lit("other"))).join(c, "chunk_id").count() == 0
    lone = sheet.limit(1).withColumn("values", F.create_map(F.lit("Company"), F.lit("A")))
    assert {r["chunk_type"] for r in rows.row_chunks(lone).collect()} == {"row_full", "company_profile"}


def test_notes_and_fingerprint(spark):
    notes = spark.createDataFrame([("f", "Defs", "x" * 2000)], "source_file string, sheet_name string, text string")
    c = rows.note_chunks(notes)
    assert c.count() == 2 and rows.all_chunks(c, rows.document_chunks(notes.withColumnRenamed("sheet_name", "canonical_source"))).count() == 4
    a = rows.fingerprint(c, "m").first()[0]
    assert a == rows.fingerprint(c.orderBy(F.desc("chunk_index")), "m").first()[0] != rows.fingerprint(c.limit(1), "m").first()[0]
    assert a != rows.fingerprint(c, "n").first()[0]


def test_filters(wide):
    who = lambda c: sorted(r[0] for r in wide.where(c).select("row_number").collect())
    assert who(filters.is_in("category", ["tier 1"])) == [3, 4] and who(filters.is_in("category", [])) == [1, 2, 3, 4, 5, 6]
    assert who(filters.not_in("category", ["OEM"])) == [3, 4, 5, 6] and who(filters.has_any("ev_supply_chain_role", ["battery"])) == [3, 4, 5]
    assert who(filters.employment(">=", 2700)) == [1, 2, 5] and who(filters.relevance("indirect")) == [4, 6]
    assert who(filters.plain_oem()) == [1, 2] and who(filters.blank("primary_oems")) == [1, 2] and who(filters.several_oems()) == [4]
    assert who(filters.harness([])) == [4] and who(filters.harness(["foil"])) == [4, 5] and who(filters.engineering_and_manufacturing()) == [2]
    assert who(~filters.not_outlier()) == [5]
    tagged = filters.tagged(wide, F.col("product_service"), {"packs": ("battery pack",), "metal": ("copper",)}, filters.relevance("yes"))
    assert sorted(pairs(tagged, "row_number", "rule")) == [(1, "metal"), (1, "packs"), (2, "metal"), (2, "packs"), (3, "metal"), (3, "packs"), (5, "metal")]


def test_analytics(wide):
    assert pairs(analytics.group_count(wide, "category", "company"), "category", "n") == [("OEM", 2), ("Tier 1", 2), ("Tier 2/3", 2)]
    assert pairs(analytics.listing(wide, "company", "ev_supply_chain_role", least=2), "company", "members") == [("Gamma", ["Battery Pack", "Thermal Parts and Cooling Plates"])]
    grouped = {r["ev_supply_chain_role"]: r["members"] for r in analytics.listing(wide, "ev_supply_chain_role", "company").collect()}
    assert grouped["Battery Pack"] == ["Delta", "Epsilon", "Gamma"]
    assert analytics.listing(wide, "ev_supply_chain_role", "company").select(analytics.preview_of(F.col("members"), 2)).where("ev_supply_chain_role = 'Battery Pack'").first()[0] == "Delta; Epsilon; 1 more"
    top = analytics.concentration(wide, "ev_supply_chain_role", "county").where("ev_supply_chain_role = 'Battery Pack'").first()
    assert (top["n"], top["parts"], top["top"], round(top["share"], 3)) == (3, 2, "Troup County", 0.667)
    assert pairs(analytics.having_all(wide, "city", "category", ["Tier 1", "Tier 2/3"]), "city") == []
    sane = wide.where(filters.not_outlier())
    assert analytics.median(sane, "employment_num").first()[0] == 1425.0
    assert tuple(analytics.extremes(sane, "employment_num", "company").first()) == (90, "Delta", 3000, "Beta")
    assert sorted(pairs(analytics.keyword_index(wide, F.col("product_service"), {"wire": ("wire",), "packs": ("battery pack",)}), "rule", "n")) == [("packs", 1), ("wire", 1)]
    scopes = {r["scope"]: r["n"] for r in analytics.rollup(wide, "state", F.count("*").alias("n")).collect()}
    assert scopes == {"All": 6, "Georgia": 5, "Alabama": 1}
    assert pairs(analytics.mix(wide, "state", "category", 2).orderBy("state"), "category_mix") == [("OEM: 1",), ("Tier 1: 2; Tier 2/3: 2",)]
    assert analytics.lines(analytics.group_count(wide, "category"), "category", "n").first()[0] == "- OEM: 2"
    empty = wide.limit(0)
    assert analytics.group_count(empty, "category").count() == 0 and analytics.concentration(empty, "category", "county").count() == 0


@pytest.mark.parametrize(
    ("question", "operator"),
    [
        ("How many companies are there per category?", "group_count"), ("Which county has the most companies?", "group_count"),
        ("Which counties have only one company?", "only_one"), ("Median employment in Georgia?", "median"), ("Which role is most concentrated in a county?", "most_concentrated"),
        ("Show the top 2 companies by employment", "top_employment"), ("List companies by EV Supply Chain Role", "listing"), ("Total employment by county", "group_sum"), ("Average employment per category", "group_mean"),
        ("Companies with wire harness products", "product_mentions"), ("Companies with missing primary OEMs", "missing_oems"), ("Companies with more than one role", "several_roles"), ("Describe Beta", "rows"),
    ],
)
def test_planner(wide, question, operator):
    p = planner.plan(question, wide)
    name, out = planner.answer(wide, p)
    assert name == operator and out.count() >= 1


def test_plan_parts(wide):
    p = planner.plan("Which Tier 1 suppliers in Georgia are linked to Alpha with employment >= 1,000?", wide)
    assert (p.categories, p.states, p.oems, p.companies, p.threshold) == (["Tier 1"], ["Georgia"], ["Alpha"], [], (">=", 1000)) and p.relationship and p.queries[0].startswith("Which")
    p = planner.plan('Georgia companies outside "Troup County"?', wide)
    assert p.excluded_locations == ["Troup County"] and p.locations == [] and p.quoted == ["Troup County"]
    assert planner.employment_threshold("employment at least 500") == (">=", 500) and planner.employment_threshold("suppliers over 100 miles away") is None and planner.employment_threshold("Employment <= 1,500") == ("<=", 1500)
    assert planner.group_field("How many companies per EV / Battery Relevant value?") == "ev_battery_relevant" and planner.group_field("count by state") is None and planner.group_field("by county and industry group") == "industry_group"
    assert planner.rank_limit("top 7", 3) == 7 and planner.group_field("companies in the county") == "county"
    assert planner.plan("county list", wide).intent == "aggregation"
    named = lambda q: sorted(planner.plan(q, wide).locations)
    assert named("Who is in Troup County?") == ["LaGrange, Troup County", "Troup County"] and named("Companies in Georgia") == [] and named("Alabama?") == []
    p = planner.plan("Show all Vehicle Assembly OEMs in Georgia and the full set of Tier 1 suppliers connected to each within the state.", wide)
    assert p.relationship and p.broad and any(q.startswith("relationship map") for q in p.queries)
    p = planner.plan("Show all Tier 1 companies grouped by EV Supply Chain Role for battery pack.", wide)
    assert (p.intent, p.structured, p.group, p.categories, p.role_terms, p.relationship) == ("aggregation", True, "ev_supply_chain_role", ["Tier 1"], ["battery pack"], False)
    questions = wide.sparkSession.createDataFrame([(1, "tell me about gamma and delta"), (2, "deltas")], "q_id int, question string")
    assert sorted(pairs(planner.matches(questions, wide, "company"), "q_id", "value")) == [(1, "Delta"), (1, "Gamma")]


def test_retrieval(spark):
    texts = ["alpha makes packs", "beta makes packs in georgia", "gamma makes foil", "delta"]
    chunks = spark.createDataFrame([(f"c{k}", t, t.split(), t.split()[0]) for k, t in enumerate(texts)], "chunk_id string, text string, tokens array<string>, company string")
    chunks = models.embed(chunks, models.HashEmbedder).cache()
    asked = models.embed(spark.createDataFrame([(1, "who makes packs in georgia"), (2, "delta")], "q_id int, question string"), models.HashEmbedder, "question").cache()
    best = {r["q_id"]: r["chunk_id"] for r in retrieval.lexical(asked, chunks).where("lexical_rank = 1").collect()}
    assert best == {1: "c1", 2: "c3"}
    dense = retrieval.dense(asked, chunks, 2).collect()
    assert {(r["q_id"], r["chunk_id"]) for r in dense if r["dense_rank"] == 1} == {(1, "c1"), (2, "c3")} and len(dense) == 4
    one = retrieval.dense(asked, chunks, 2, parts=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, dense))
    out = retrieval.retrieve(asked, chunks, limit=2).orderBy("q_id", "rank").collect()
    assert [(r["q_id"], r["rank"]) for r in out] == [(1, 1), (1, 2), (2, 1), (2, 2)] and out[0]["chunk_id"] == "c1"
    boosted = retrieval.lexical(asked, chunks, company="company").where("q_id = 2").first()
    assert boosted["lexical_score"] == pytest.approx(retrieval.lexical(asked, chunks).where("q_id = 2").first()["lexical_score"] + 2.5)
    assert retrieval.focused(F.lit("what is the list of packs")).__class__ and spark.range(1).select(retrieval.focused(F.lit("What is the list of packs"))).first()[0] == "packs"


def test_selection(spark):
    kinds = "q_id int, chunk_id string, row_key string, company string, state string, chunk_type string, analysis_type string, question_state string, final_score double, priority int"
    hit = lambda c, company, score, kind="row_full", state="", at="": (1, c, c, company, state, kind, at, "Georgia", score, 0)
    data = [hit(f"a{k}", "A", 0.9 - k / 100) for k in range(6)] + [hit("b", "B", 0.5), hit("p", "", 0.1, "structured_match_summary")]
    data += [hit(f"s{k}", "", 0.8, "derived_analytic_summary", s, "county") for k, s in enumerate(("Georgia", "Alabama", ""))]
    got = retrieval.select(spark.createDataFrame(data, kinds), cap=4, limit=12).orderBy("rank")
    assert [r["chunk_id"] for r in got.collect()] == ["p", "a0", "a1", "a2", "a3", "s0", "b"]


def test_boost(spark):
    names = ("question", "company", "category", "state", "location", "ev_supply_chain_role", "product_service", "primary_oems", "chunk_type", "analysis_title", "analysis_type")
    d = spark.createDataFrame([("Suppliers linked to Alpha in Georgia", "Alpha", "OEM", "Georgia", "", "", "", "Alpha", "supply_chain_theme", "", ""), ("x", *[None] * 10)], ", ".join(f"{n} string" for n in names))
    got = [r[0] for r in d.select(retrieval.boost()).collect()]
    assert got == pytest.approx([0.04 + 0.03 + 0.03 + 0.025 + 0.02, 0.0])


def test_context(spark):
    blocks = spark.createDataFrame([(1, 1, "x" * 300), (1, 2, "y" * 400), (1, 3, "z" * 400)], "q_id int, rank int, text string")
    got = context.compact(blocks, 620).first()["context"]
    assert got == "x" * 300 + "\n\n" + "y" * 318
    assert context.compact(blocks, 400).first()["context"] == "x" * 300
    cut = context.token_budget(blocks, 100).orderBy("rank").collect()
    assert [(r["rank"], len(r["text"]), r["tokens"]) for r in cut] == [(1, 300, 75), (2, 100, 25)]
    assert context.numbered(blocks).orderBy("rank").first()["text"].startswith("[E1] x")
    both = context.split_budget(blocks.withColumn("web_needed", F.lit(True)), blocks.withColumn("web_needed", F.lit(True)), 100)
    assert {r["source_kind"]: r["t"] for r in both.groupBy("source_kind").agg(F.sum("tokens").alias("t")).collect()} == {"local": 45, "web": 55}


def test_compact_selection(spark):
    names = "q_id int, chunk_id string, chunk_type string, row_key string, company string, final_score double, priority double, definition boolean, several boolean, broad boolean"
    chunks = [("n1", "note_reference", "", "", 0.9, 3.0), ("n2", "note_reference", "", "", 0.8, 3.0), ("a1", "row_full", "r1", "A", 0.7, 1.0), ("a2", "company_profile", "r1", "A", 0.6, 2.0), ("a3", "identity_theme", "r2", "A", 0.5, 2.4), ("b1", "row_full", "r3", "B", 0.4, 1.0)]
    ask = lambda q, definition, several: [(q, *c, definition, several, False) for c in chunks]
    got = context.compact_selection(spark.createDataFrame(ask(1, True, True) + ask(2, False, False), names)).orderBy("q_id", "rank").collect()
    assert [r["chunk_id"] for r in got if r["q_id"] == 1] == ["n1", "a3", "a2", "b1"]
    assert [r["chunk_id"] for r in got if r["q_id"] == 2] == ["a3", "b1"]
    kept = context.compact_selection(spark.createDataFrame([(1, f"c{k:02}", "document_chunk", "", "", 0.5, 1.4, False, False, k < 20) for k in range(20)], names), limit=8)
    assert kept.count() == 15
    caps = spark.createDataFrame([("Where is each location?", False), ("x", True), ("x", False)], "q string, broad boolean")
    assert [r[0] for r in caps.select(retrieval.company_cap(F.col("q"), 2, F.col("broad"))).collect()] == [3, 4, 2]


def test_stems():
    from loomwork.functions.stems import stem

    assert [stem(w) for w in ("caresses", "ponies", "agreed", "plastered", "motoring", "hopping", "relational", "conditional", "rate", "cease", "controll", "sky")] == ["caress", "poni", "agre", "plaster", "motor", "hop", "relat", "condit", "rate", "ceas", "control", "sky"]


def test_evaluation(spark):
    claims = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "response_id int, claim_id int")
    replies = spark.createDataFrame([(1, {1: "supported"}), (2, None)], "response_id int, labels map<int,string>")
    got = evaluation.labelled_claims(claims, replies)
    assert sorted(pairs(got, "response_id", "claim_id", "label")) == [(1, 1, "supported"), (1, 2, "unsupported"), (2, 1, "unsupported")]
    assert sorted(pairs(evaluation.claim_ratios(got), "response_id", "custom_faithfulness", "unsupported_claim_ratio")) == [(1, 0.5, 0.5), (2, 0.0, 1.0)]
    assert pairs(evaluation.batches(spark.range(1, 51).withColumnRenamed("id", "item_id"), 24).groupBy("batch").count().orderBy("batch"), "count") == [(24,), (24,), (2,)]
    e = spark.createDataFrame([("r", "q", 1.0)], "run_name string, question string, answer_accuracy double")
    c = evaluation.calibration(e, e.withColumn("answer_accuracy", F.lit(0.9)), ["answer_accuracy"]).first()
    assert (c["n"], c["mean_absolute_error"], c["mean_signed_error"], c["correlation"]) == (1, 0.1, -0.1, None)
    out = models.generate(spark.createDataFrame([("a\nb",), (None,)], "prompt string"), models.EchoGenerator).select("response.*").collect()
    assert out[0]["answer"] == "b" and out[0]["success"] and out[1]["answer"] == ""

    class Broken:
        def generate(self, prompt):
            raise RuntimeError("down")

    bad = models.generate(spark.createDataFrame([("a",)], "prompt string"), Broken).select("response.*").first()
    assert not bad["success"] and bad["error_message"] == "RuntimeError: down"
    assert models.unknown_runs(["m_rag", "x"], models.registry(spark, {"m": "model"})) == ["x"]


def test_reports(spark):
    r = spark.createDataFrame([("a", "q1", 0.5), ("a", "q2", None), ("b", "q1", 0.9), ("b", "q2", float("nan")), ("c", "q1", None)], "run_name string, q_id string, score double")
    assert pairs(reports.leaderboard(r, ["run_name"], ["score"], "score").orderBy("rank"), "rank", "run_name", "score") == [(1, "b", 0.9), (2, "a", 0.5), (3, "c", None)]
    assert reports.pivot(r.na.drop(), "q_id", "run_name", ["b", "a"], ["score"]).columns == ["q_id", "b", "a"]
    answers = spark.createDataFrame([("1", "no_rag", "see [doc:x] and [doc:y]"), ("2", "local_rag", "I don't know")], "q_id string, mode string, answer string")
    got = {x["q_id"]: x for x in reports.derived(answers, spark.createDataFrame([("1", "no_rag", "x")], "q_id string, mode string, chunk_id string")).collect()}
    assert got["1"]["citation_match_ratio"] == 0.5 and got["1"]["citation_mismatch"] and got["2"]["abstained"] and got["2"]["citation_match_ratio"] is None


def workbook(path, sheets):
    cell = lambda v, r, c: "" if v is None else (f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, lines in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(line)) + "</row>" for r, line in enumerate(lines, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "w.xlsx", {"Data": [["Company", "Category", "Employment"], ["A", "Tier 1", 12.0], [None, None, None], ["B", None, 3]], "Definitions": [["What a tier is"], ["More"]]})
    got, notes = tables.load_workbook(spark, str(tmp_path / "w.xlsx"))
    assert sorted(pairs(got, "row_number", "values")) == [(1, {"Company": "A", "Category": "Tier 1", "Employment": "12"}), (2, {"Company": "B", "Employment": "3"})]
    assert pairs(notes, "sheet_name", "text") == [("Definitions", "What a tier is\nMore")]
    assert tables.validate(got).first()["rows"] == 2


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Num,Questions,Human validated answers\n1.0,How many are there?,"Two\n\n- a"\n2,abc,x\n,Which ones exist here?,\n')
    got = pairs(tables.questions(tables.read_table(spark, str(tmp_path / "q.csv"))), "q_id", "question", "golden_answer")
    assert got == [("1", "How many are there?", "Two\n\n- a"), ("Q03", "Which ones exist here?", None)]
    for name, data in {"a.json": [{"id": 1, "question": "What is this one?"}], "b.json": {"questions": [{"id": 1, "question": "What is this one?"}]}, "c.json": {"1": {"question": "What is this one?"}}, "d.json": {"1": "What is this one?"}}.items():
        (tmp_path / name).write_text(json.dumps(data))
        assert pairs(tables.questions(tables.read_table(spark, str(tmp_path / name))), "q_id", "question") == [("1", "What is this one?")], name
    cells = spark.createDataFrame([(1, ["Title", None]), (2, ["ID", "Question"]), (3, ["7", "What is this one?"])], "row_index int, cells array<string>")
    assert pairs(tables.questions(tables.promoted(cells)), "q_id", "question") == [("7", "What is this one?")]
    (tmp_path / "wide.json").write_text(json.dumps([{f"k{k}": k for k in range(300)} | {"question": "What is this one?"}]))
    assert len(tables.read_json_items(spark, str(tmp_path / "wide.json")).columns) == 301
    assert tables.pick(["Q ID", "q_id"], "q id") == "Q ID" and tables.pick(["a"], "b") is None


def test_documents(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a_file-name.txt").write_text("One  line\r\n\r\nTwo")
    (root / "sub" / "b.html").write_text("<title>T</title><body><script>x</script><p>Text</p></body>")
    (root / "blank.md").write_text(" \n ")
    (root / "c.pdf").write_bytes(b"%PDF")
    (root / "d.exe").write_bytes(b"x")
    (root / "my_manifest.csv").write_text('Filename,Title,URL\nb.html,By name,http://n\nsub/b.html,,"http://p,q"\n')
    good, bad = documents.load_documents(spark, str(root))
    assert sorted(pairs(good, "filepath", "canonical_source", "text", "title")) == [("a_file-name.txt", "a_file-name.txt", "One line\nTwo", "A File Name"), ("sub/b.html", "http://p,q", "Text", "By name")]
    assert sorted(pairs(bad, "filepath", "reason")) == [("blank.md", "no text"), ("c.pdf", "no reader for pdf"), ("d.exe", "unsupported suffix")]
    assert len(documents.fingerprints(spark, str(root / "d.exe")).first()["fingerprint"]) == 16


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("r1", "q?", "a|b"), ("r2", "q?", None)], "run_name string, question string, answer string")
    assert len(sinks.write_report({"one": d, "two": d}, f"{tmp_path}/rep", "csv")) == 2 and spark.read.csv(f"{tmp_path}/rep/one", header=True).count() == 2
    sinks.write_responses(d, f"{tmp_path}/resp")
    assert spark.read.text(f"{tmp_path}/resp/markdown").count() > 0 and spark.read.csv(f"{tmp_path}/resp/responses", header=True).count() == 2
    for _ in range(2):
        sinks.append_log(d, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    assert sinks.markdown_table(d.limit(1)).splitlines()[-1] == r"| r1 | q? | a\|b |"
    chunks = models.embed(spark.createDataFrame([("c1", "x"), ("c2", "y")], "chunk_id string, text string"), models.HashEmbedder)
    assert sinks.read_index(spark, f"{tmp_path}/idx", chunks, "m") is None
    assert sinks.write_index(chunks, f"{tmp_path}/idx", "m")["chunks"] == 2
    assert sinks.read_index(spark, f"{tmp_path}/idx", chunks, "m").count() == 2
    assert sinks.read_index(spark, f"{tmp_path}/idx", chunks.limit(1), "m") is None and sinks.read_index(spark, f"{tmp_path}/idx", chunks, "n") is None


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([("2026-01-01 00:00:00", 1, "a", 1.0), ("2026-01-01 00:10:00", 1, "a", 3.0), ("2026-01-01 02:00:00", 1, "b", None)], "ts string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(f"{tmp_path}/in")
    assert {(r["event_type"], r["n"], r["total"]) for r in events.tumbling(e).collect()} == {("a", 2, 4.0), ("b", 1, None)}
    assert sorted(r["n"] for r in events.sessions(e).collect()) == [1, 2]
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = events.running_means(stream, ["event_type"], ["value"], f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    got = events.means(spark.read.parquet(f"{tmp_path}/out"), ["event_type"], ["value"])
    assert {(r["event_type"], r["value"]) for r in got.collect()} == {("a", 2.0), ("b", None)}
    w = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    w.awaitTermination(60)
    assert spark.table("w").count() == 2


def test_summaries(wide):
    got = {(r["scope"], r["county"]): (r["companies"], r["employment"], r["ev_yes"], r["ev_indirect"]) for r in summaries.county_cluster(wide).collect()}
    assert got[("", "Troup County")] == (3, 2940, 2, 1) and got[("Georgia", "Bibb County")] == (2, 0, 0, 1) and ("Alabama", "Troup County") not in got
    roles = {(r["scope"], r["role"]): r for r in summaries.role_concentration(wide).collect()}
    assert roles[("", "Battery Pack")]["category_mix"] == "Tier 1: 2; Tier 2/3: 1" and roles[("", "Battery Pack")]["place"] == 1
    index = {r["rule"]: r for r in summaries.capability_index(wide).where("scope = ''").collect()}
    assert (index["complete battery packs"]["companies"], index["complete battery packs"]["samples"]) == (3, "Delta; Gamma; Epsilon") and index["dc fast charging hardware"]["companies"] == 0 and len(index) == 6
    oems = {r["oem"]: r for r in summaries.oem_linkage(wide).where("scope = ''").collect()}
    assert oems["Unspecified OEM"]["suppliers"] == 2 and oems["Alpha"]["samples"] == "Gamma; Gamma"
    assert {r["rule"]: r["companies"] for r in summaries.battery_ecosystem(wide).where("scope = 'Alabama'").collect()} == dict.fromkeys(("battery manufacturing", "battery materials", "charging hardware", "recycling and recovery", "power electronics and sensors"), 1)
    c = summaries.chunks(wide).cache()
    assert c.count() == 15 and c.select("chunk_id").distinct().count() == 15 and c.where("state = 'Georgia' and analysis_title like '%(Georgia)'").count() == 5
    assert summaries.chunks(wide.limit(0)).count() == 0


class Judge:
    """Says that items with a 7 are supported; the first reply to a prompt with "flaky" can't be parsed."""

    def generate(self, prompt):
        items = [x.split(". ", 1) for x in prompt.split("Items:\n")[1].split("\n\n")[0].splitlines()]
        label = (lambda x: "relevant" if "7" in x else "irrelevant") if "relevant, irrelevant" in prompt else (lambda x: "knowledge_source" if "7" in x else "pretrained") if "pretrained" in prompt else (lambda x: "supported" if "7" in x else "contradicted")
        if "flaky" in prompt and not prompt.endswith("\n"):
            return "no JSON", 1, 1
        if "silent" in prompt:
            raise TimeoutError
        return "Here: " + json.dumps({"labels": [{"claim_id": int(n), "label": label(x)} for n, x in items]}), 1, 1


def test_judging(spark):
    answers = spark.createDataFrame([(1, "It has 7 sites. It has 8 sites."), (2, "flaky 7."), (3, "silent 7."), (4, None)], "response_id int, answer string")
    evidence = spark.createDataFrame([(1, "text")], "response_id int, evidence string")
    got = {r["response_id"]: (r["custom_faithfulness"], r["contradicted_claim_ratio"]) for r in judging.faithfulness(answers, evidence, Judge).collect()}
    assert got == {1: (0.5, 0.5), 2: (1.0, 0.0), 3: (0.0, 0.0)}
    parts = {r["response_id"]: (r["knowledge_source"], r["pretrained"]) for r in judging.attribution(answers, evidence, Judge).collect()}
    assert parts[1] == ("It has 7 sites.", "It has 8 sites.") and parts[3] == ("", "silent 7.")
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "7")], "response_id int, rank int, text string")
    assert judging.context_precision(hits, evidence, Judge).first()["custom_context_precision"] == 0.5
    assert judging.context_recall(answers.withColumnRenamed("answer", "reference"), evidence, Judge).where("response_id = 1").first()[1] == 0.5
    prompts = spark.createDataFrame([(1, "SCORE=0.9"), (1, "SCORE=0.7"), (2, "none")], "response_id int, prompt string")
    assert {r[0]: r[1] for r in judging.dual(prompts, models.EchoGenerator).collect()} == {1: 0.8, 2: None}
    ratings = spark.createDataFrame([(1, "RATING=2"), (1, "RATING=1")], "response_id int, prompt string")
    assert judging.dual(ratings, models.EchoGenerator, rating=2).first()["score"] == 0.75


def test_results(spark):
    r = spark.createDataFrame([("m_no_rag", None), ("m_rag", None), ("x", True)], "run_name string, rag_enabled boolean")
    assert pairs(results.with_modes(r), "mode", "model_display") == [("no_rag", "m"), ("rag", "m"), ("rag", "x")]
    s = spark.createDataFrame([("no_rag", "a", 0, 0), ("rag", "a\nEvidence: e", 0, 2), ("rag", "a", 0, 0), ("rag", None, 0, 0)], "mode string, answer string, cited int, got int")
    assert pairs(s.select(results.split_sources(F.col("mode"), F.col("answer"), F.col("cited"), F.col("got")).alias("s")).select("s.*"), "knowledge", "pretrained") == [("", "a"), ("a\nEvidence: e", ""), ("", "a"), ("", "")]
    k = spark.createDataFrame([("analytic",), ("web_needed",), ("lookup",)], "r string").select(results.local_k(F.col("r"), 5).alias("l"), results.web_k(F.col("r"), 3).alias("w"))
    assert pairs(k, "l", "w") == [(7, 4), (5, 5), (5, 3)]
    payload = results.calibration_payload(spark.createDataFrame([(1, '["a","b"]')], "row_id int, retrieved_contexts string"))
    assert pairs(payload, "rank", "final_score") == [(1, 1.0), (2, 0.5)]
    out = results.flat(models.generate(spark.createDataFrame([("Insufficient evidence: [E1]",)], "prompt string"), models.EchoGenerator)).first()
    assert out["abstained"] and out["citation_count"] == 1 and out["response_length_words"] == 3 and out["tokens_total"] == 12


def test_references_and_settings(spark, tmp_path):
    q = spark.createDataFrame([("1", "What?", "that"), ("2", "Why?", None)], "q_id string, question string, golden_answer string")
    assert sorted(pairs(evaluation.with_references(q, models.EchoGenerator), "q_id", "golden_answer", "reference_source")) == [("1", "that", "golden"), ("2", "Answer:", "generated")]
    s = settings.load(env={"LOOMWORK_RRF_K": "10", "LOOMWORK_USE_RERANKER": "no", "LOOMWORK_COMPANY_CAP": " "})
    assert (s.rrf_k, s.use_reranker, s.company_cap) == (10, False, 4)
    (tmp_path / "a.txt").write_text("x")
    assert tables.resolve(spark, [str(tmp_path / "none"), str(tmp_path / "a.txt")]) == str(tmp_path / "a.txt")
    with pytest.raises(FileNotFoundError):
        tables.resolve(spark, ["/none"], "/missing")
    r = spark.createDataFrame([("1", "q", "rag", "a"), ("2", "q", "rag", "b")], "q_id string, question string, mode string, answer string")
    worst = spark.createDataFrame([("2", 3)], "q_id string, issue_score int")
    assert pairs(reports.review_template(r, worst), "q_id", "correct") == [("2", ""), ("1", "")]


def test_lexical_search_by_bounds_equals_scoring_everything(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    held = [(k, sorted({w for w in words if rng.random() < (0.9 if int(w[1:]) < 6 else 0.02 + int(w[1:]) / 900)}), f"firm {k % 7}", "Data") for k in range(900)]
    asked = [(q, " ".join(rng.sample(words, 8) + words[:4])) for q in range(25)] + [(3, "w9 w10 firm 3"), (99, "w0 w1"), (100, "unknown"), (101, None), (102, "w59 of firm 2 in data")]
    chunks = spark.createDataFrame(held, "chunk_id int, tokens array<string>, company string, sheet string")
    questions = spark.createDataFrame(asked, "q_id int, question string")
    df = Counter(t for _, tokens, _, _ in held for t in tokens)
    idf = {t: math.log((1 + len(held)) / (1 + n)) + 1 for t, n in df.items()}
    want = {}
    for q, t in asked:
        for k, tokens, firm, _ in held:
            shared = set((t or "").split()) & set(tokens)
            if shared:
                s = sum(idf[x] for x in shared) + (2.5 if f" {firm} " in f" {t} " else 0) + (0.5 if " data " in f" {t} " else 0)
                want[q, k] = max(want.get((q, k), 0), s)
    for k in (1, 5):
        best = {}
        for (q, c), s in want.items():
            best.setdefault(q, []).append((-round(s, 6), c))
        got = {}
        for r in retrieval.lexical(questions, chunks, k, "company", "sheet", digits=6).orderBy("q_id", "lexical_rank").collect():
            got.setdefault(r.q_id, []).append((-r.lexical_score, r.chunk_id))
        assert got.keys() == best.keys()
        for q, hits in got.items():
            assert [c for _, c in hits] == [c for _, c in sorted(best[q])[:k]]
    reads = retrieval.Lexical(questions.where("q_id < 25"), chunks, 5, 0.0).reads().agg(F.sum("read"), F.sum("postings")).first()
    assert reads[0] < 0.7 * reads[1]


def test_quantiles_of_large_and_tied_groups(spark):
    rng = random.Random(5)
    data = [("all one", 7.0)] * 9000 + [("even", float(k)) for k in rng.sample(range(30_000), 30_000)] + [("tied", float(rng.choice([1, 1, 1, 2, 9]))) for _ in range(12_000)]
    data += [("wide", 10.0 ** rng.uniform(-200, 200)) for _ in range(8000)] + [("few", 1.0), ("few", 2.0), ("one", 5.0), ("none", None), (None, 3.0), (None, 4.0), (None, 9.0)]
    rows = spark.createDataFrame(data, "g string, v double").repartition(4)
    held = {}
    for g, v in data:
        if v is not None:
            held.setdefault(g, []).append(v)
    for p in (0.5, 0.1, 0.0, 1.0):
        got = {r.g: r["quantile"] for r in quantiles.quantile(rows, "v", p, ["g"], exact_below=500).collect()}
        assert got.keys() == held.keys()
        for g, values in held.items():
            assert got[g] == pytest.approx(float(np.quantile(values, p)), rel=1e-12), (g, p)
    assert quantiles.quantile(rows, "v", 0.5).first()[0] == float(np.median([v for _, v in data if v is not None]))
    assert quantiles.quantile(rows.limit(0), "v", 0.5, ["g"]).count() == 0


def test_dense_index_equals_scoring_everything_and_reads_a_part(spark, tmp_path):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 4
    data = [(k, (centers[k % 40] + rng.normal(size=16) * 0.3).tolist()) for k in range(3000)] + [(3000 + k, [0.0] * 16) for k in range(3)] + [(4000 + k, centers[0].tolist()) for k in range(300)]
    chunks = spark.createDataFrame(data, "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(k, (centers[k] + rng.normal(size=16) * 0.2).tolist()) for k in range(6)] + [(6, [0.0] * 16)], "q_id int, embedding array<double>")
    dense_index.build(chunks, str(tmp_path / "i"), cells=40)
    rows = lambda d: sorted((r.q_id, r.dense_rank, r.chunk_id, round(r.dense_score, 9)) for r in d.collect())
    search = dense_index.Search(spark, str(tmp_path / "i"), queries.where("q_id < 6"), 10)
    assert rows(search.hits) == rows(retrieval.dense(queries.where("q_id < 6"), chunks, 10))
    read = search.read()
    assert read["files"] < 0.5 * read["of_files"] and read["vectors"] < 0.5 * read["of_vectors"] == 0.5 * 3303
    assert rows(dense_index.Search(spark, str(tmp_path / "i"), queries, 4000).hits) == rows(retrieval.dense(queries, chunks, 4000))
    assert dense_index.Search(spark, str(tmp_path / "i"), queries.limit(0), 3).hits.count() == 0


def test_ordinals_and_mixes_by_first_appearance(spark):
    rng = random.Random(8)
    data = [(k, rng.choice("abc"), rng.choice(["x", "y", "z", None])) for k in rng.sample(range(5000), 3000)]
    rows = spark.createDataFrame(data, "at int, g string, label string").repartition(7)
    placed = ordinals.ordinal(rows, "g", F.desc("at"))
    want = {(a, g): k for k, (a, g, _) in enumerate(sorted(data, key=lambda r: (r[1], -r[0])))}
    assert {(r["at"], r.g): r.ordinal for r in placed.repartition(5).collect()} == want
    assert ordinals.ordinal(rows.limit(0), "at").count() == 0
    tied = spark.createDataFrame([(0, "k", "zeta"), (1, "k", "alpha"), (2, "k", "alpha"), (3, "k", "zeta"), (4, "k", None), (5, "k", "mid")], "n int, key string, label string")
    assert analytics.mix(ordinals.ordinal(tied, "n"), "key", "label", first="ordinal").first()[1] == "zeta: 2; alpha: 2; Unspecified: 1"
    assert analytics.mix(tied, "key", "label").first()[1] == "alpha: 2; zeta: 2; Unspecified: 1"


def test_markdown_tells_what_it_leaves_out(spark):
    told = sinks.markdown_table(spark.range(7).toDF("n"), most=5)
    assert told.endswith("| 4 |\n\n2 more rows") and "more" not in sinks.markdown_table(spark.range(5).toDF("n"), most=5)


def test_lexical_search_lets_only_the_best_of_a_part_leave_it(spark, monkeypatch):
    """Hot tokens give every chunk a score; none but some k of a part for each text go on, also where texts come in several blocks."""
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    rng, k = random.Random(5), 3
    held = [(c, sorted({"a", "b"} | {f"w{rng.randrange(40)}" for _ in range(6)})) for c in range(3000)]
    asked = [(q, f"a b w{q} w{q + 1} w{q + 2} w{q + 20}") for q in range(7)]
    index = retrieval.Lexical(spark.createDataFrame(asked, "q_id int, question string"), spark.createDataFrame(held, "chunk_id int, tokens array<string>"), k, 0.0)
    df = Counter(t for _, tokens in held for t in tokens)
    got = {}
    for r in index.scores().collect():
        got.setdefault(r.q_id, {})[r.chunk_id] = r.s
    for q, question in asked:
        every = {c: sum(math.log(3001 / (1 + df[t])) + 1 for t in set(question.split()) & set(tokens)) for c, tokens in held}
        best = sorted(every, key=lambda c: (-round(every[c], 6), c))[:k]
        assert sorted(got[q], key=lambda c: (-round(got[q][c], 6), c))[:k] == best
        assert all(got[q][c] == pytest.approx(every[c]) for c in got[q])
        assert len(got[q]) < 600  # of 3000 that share a token


def test_a_part_of_a_lexical_search_goes_in_steps(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "STEP", 70)
    rng = np.random.default_rng(2)
    terms = [sorted(rng.choice(50, rng.integers(0, 9), replace=False).tolist()) for _ in range(500)]
    mine = pa.table({"chunk_id": pa.array([None, *range(1, 500)], pa.int64()), "terms": pa.array(terms, pa.list_(pa.int64()))})
    idf = rng.uniform(1, 5, 50)
    rows = [(q, int(t), float(idf[t]), bool(t % 3), None if q % 2 else 2.0) for q in range(6) for t in rng.choice(60, 12, replace=False) if t < 50]
    asking = pa.table(dict(zip(("qk", "term", "idf", "essential", "threshold"), map(list, zip(*rows, strict=True)), strict=True)), schema=pa.schema([("qk", pa.int64()), ("term", pa.int64()), ("idf", pa.float64()), ("essential", pa.bool_()), ("threshold", pa.float64())]))
    got = retrieval._part_best(mine, asking, 4, 0.5, 1e-5).to_pydict()
    found = dict(zip(zip(got["qk"], got["chunk_id"], strict=True), got["s"], strict=True))
    for q in range(6):
        own = {t: (w, e) for x, t, w, e, _ in rows if x == q}
        late, least = sum(w for w, e in own.values() if not e), -math.inf if q % 2 else 2.0
        s = {}
        for c, held in zip(mine.column("chunk_id").to_pylist(), terms, strict=True):
            first = sum(own[t][0] for t in held if t in own and own[t][1])
            if first > 0 and first + late + 0.5 >= least:
                s[c] = sum(own[t][0] for t in held if t in own)
        kth = sorted(s.values(), reverse=True)[3]
        want = {c for c, v in s.items() if v >= kth - 0.5 - 1e-5}
        assert {c for x, c in found if x == q} == want and all(found[q, c] == pytest.approx(s[c]) for c in want)
    for side in ((mine.slice(0, 0), asking), (mine, asking.slice(0, 0))):
        assert retrieval._part_best(*side, 4, 0.0, 0.0).num_rows == 0


def test_scores_are_rounded_once():
    """0.1234564999996 has 0.1234565 at twelve digits, but 0.123456 at six."""
    assert retrieval.rounded(np.array([0.1234564999996, 0.5, 1.0, 0.0, 0.123457]), 6).tolist() == [0.123456, 0.5, 1.0, 0.0, 0.123457]
    assert retrieval.rounded(np.array([0.125, 0.375]), 2).tolist() == [0.13, 0.38]


def test_dense_index_reads_cells_whose_scores_are_all_clipped_to_zero(spark, tmp_path):
    """Cells that lie opposite a query tie with its k-th score of 0, then ids decide."""
    at = np.linspace(np.pi, np.pi * 0.6, 1000)  # the least ids are the farthest
    chunks = spark.createDataFrame([(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(at)], "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q_id int, embedding array<double>")
    dense_index.build(chunks, str(tmp_path / "i"), cells=40)
    for digits in (None, 6):
        got = dense_index.Search(spark, str(tmp_path / "i"), asked, 5, digits=digits).hits.orderBy("dense_rank").collect()
        assert [(r.chunk_id, r.dense_score) for r in got] == [(k, 0.0) for k in range(5)]
