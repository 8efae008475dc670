"""Tables of questions: plans, matched rows, answers and summaries."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import fixed
from loomwork.operators import rows
from loomwork.plans import answers, planner, questions
from loomwork.tables import dealt, handed_out, written

from .test_library import HEADERS, SHEET

ASKED = [
    "How many companies are there per category?", "Which counties have only one company? Show matching companies", "Median employment in Georgia? List all entries",
    "Which EV Supply Chain Role is most concentrated in a single county?", "Show the top 2 companies with the highest employment", "Total employment by county, top 2",
    "Average employment by category, highest?", "Which product / service entries mentions 'foil'?", "Companies with missing primary OEMs", "Which companies appear multiple times?",
    "Describe Beta", "Which Tier 1 suppliers in Georgia are linked to Alpha with employment >= 100?", "EV / Battery Relevant yes versus indirect",
    "Show all Tier 1 companies grouped by EV Supply Chain Role for battery pack.", "range of employment", "Gamma location and primary facility type", None, "Nothing is known of this",
    "List all companies with EV / Battery Relevant = Indirect", "Companies outside, excluding rows with location = Troup County, count by category", "how many companies with category = OEM",
    "Which cities have both Tier 1 and Tier 2/3 companies?", "Which companies supply to more than one OEM?",
]


@pytest.fixture(scope="module")
def wide(spark):
    data = [("f.xlsx", "Data", k, {h: v for h, v in zip(HEADERS, r, strict=True) if v}) for k, r in enumerate(SHEET, 1)]
    return rows.wide_rows(spark.createDataFrame(data, "source_file string, sheet_name string, row_number int, values map<string,string>")).cache()


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "q_id int, question string")


@pytest.fixture(scope="module")
def plans(spark, wide):
    return questions.plans(table(spark, ASKED), wide).cache()


@pytest.fixture(scope="module")
def told(plans, wide):
    out = {}
    for r in answers.answers(plans, wide).orderBy("q_id", "at", "key").collect():
        out.setdefault(r.q_id, (r.rule, []))[1].append(r.line)
    return out


def test_plans(plans):
    p = {r.q_id: r for r in plans.collect()}
    assert len(p) == len(ASKED)
    linked = p[11]
    assert (linked.categories, linked.states, linked.oems, linked.companies, linked.op, linked.number) == (["Tier 1"], ["Georgia"], ["Alpha"], [], ">=", 100) and linked.relationship
    assert linked.queries[3] == "relationship map | Tier 1 | Alpha | Georgia" and linked.queries[4] == "Tier 1 linked to Alpha"
    listed = p[13]
    assert (listed.intent, listed.structured, listed.by_role, listed.exhaustive, listed.categories, listed.role_terms) == ("aggregation", True, True, True, ["Tier 1"], ["battery pack"])
    assert p[16].structured is False and p[16].queries == [] and p[17].structured is False
    assert p[19].excluded == ["Troup County"] and p[19].locations == ["LaGrange, Troup County"] and p[20].categories == ["OEM"]
    assert p[0].group == "category" and p[12].group == "ev_battery_relevant" and p[10].companies == ["Beta"]


def test_group_fields_and_thresholds_are_those_of_the_single_planner(spark, wide):
    texts = [f"count by {w}" for w, _ in fixed.GROUP_FIELDS] + ["employment at least 1,500", "over 100 miles", "Employment < 20 or more", "by state"]
    for r in questions.plans(table(spark, texts), wide).select("q_id", "group", "op", "number").collect():
        assert planner.group_field(texts[r.q_id]) == r.group
        assert planner.employment_threshold(texts[r.q_id]) == ((r.op, r.number) if r.op else None)


def test_answers(told):
    assert told[0] == ("group_count", ["Counts by Category:", "- OEM: 2", "- Tier 1: 2", "- Tier 2/3: 2"])
    assert told[1] == ("only_one", ["Counts by County:", "- Alabama: 1", "  Companies: Beta"])
    assert told[2][1][0] == "Median Employment: 150" and len(told[2][1]) == 4
    assert told[3][1][1:4] == ["- Role: Thermal Parts and Cooling Plates", "- County: Bibb County", "- Share: 1.00"]
    assert told[4] == ("ranked", ["Employment-ranked companies:", "- Company: Beta | Employment: 3000", "- Company: Alpha | Employment: 2,700"])
    assert told[5][1] == ["Total Employment by County:", "- Alabama: 3000", "- Troup County: 2940"]
    assert told[6][1] == ["Average Employment by Category:", "- OEM: 2850.00", "- Tier 1: 120.00", "Highest: OEM (2850.00)"]
    assert told[7][1][1:] == ["- Company: Delta | Product / Service: wire and harness", "- Company: Epsilon | Product / Service: copper foil"]
    assert told[9][1][1] == "- Gamma: Battery Pack, Thermal Parts and Cooling Plates"
    assert told[11] == ("linked", ["Linked companies:", "- Company: Gamma | Employment: 150"])
    assert told[12][1][1:3] == ["- Indirect: 2", "  Companies: Delta, Gamma"]
    assert told[14][1][1:] == ["- Min: 90 | Company: Delta", "- Max: 3000 | Company: Beta"]
    assert told[15] == ("by_location", ["Company records by location:", "- Updated Location: LaGrange, Troup County | Primary Facility Type: Manufacturing | EV Supply Chain Role: Battery Pack", "- Updated Location: Macon, Bibb County | Primary Facility Type: Office | EV Supply Chain Role: Thermal Parts and Cooling Plates"])
    assert [line.split(" | ")[0] for line in told[18][1][1:]] == ["- Company: Delta", "- Company: Gamma"]
    assert told[19][1][1:] == ["- Tier 1: 2"]
    assert told[20][1][1:] == ["- OEM: 2"] and told[22][1][1:] == ["- Company: Delta | Primary OEMs: Alpha Beta Motors"]
    assert not {13, 16, 17} & set(told)


def test_one_by_one_is_the_same(spark, wide, told):
    for k in (2, 11, 15):
        p = questions.plans(table(spark, [ASKED[k]]), wide)
        assert [r.line for r in answers.answers(p, wide).orderBy("at", "key").collect()] == told[k][1]


def test_summaries(plans, wide):
    out = {}
    for r in answers.summaries(plans.where("q_id in (0, 10, 11, 13, 21)"), wide).orderBy("q_id", "part", "at", "key").collect():
        out.setdefault(r.q_id, []).append(r.line)
    assert out[0][:3] == ["Structured workbook matches from exact metadata filters:", "Applied filters: ", "Matched rows: 6"] and out[0][3:] == ["Counts by Category:", "- OEM: 2", "- Tier 1: 2", "- Tier 2/3: 2"]
    assert out[11][1:3] == ["Applied filters: category in ['Tier 1'], state in ['Georgia'], primary OEMs in ['Alpha'], supplier type in ['supplier']", "Matched rows: 1"]
    assert out[13][2:] == ["Matched rows: 2", "Grouped by EV Supply Chain Role:", "- Battery Pack: Delta; Gamma"]
    assert out[10][3:] == ["Matching rows:", "- Company: Beta"]
    cut = {r.q_id: r for r in answers.summaries(plans.where("q_id = 13"), wide, exhaustive=1, shown=1).where("part = 2").collect()}
    assert cut[13].line.startswith("Summary truncated because matched rows (2)")


def test_structured_results(plans, wide):
    got = answers.structured(plans.where("q_id in (0, 13, 16)"), wide, top_k=4).orderBy("q_id", "place").collect()
    assert [(r.q_id, r.place) for r in got] == [(0, 0), (0, 1), (0, 2), (13, 0), (13, 1), (13, 2)]
    assert got[0].final_score == 1.0 and got[1].final_score == 0.99 and got[1].text.startswith("Company: Alpha") and got[3].text.endswith("- Battery Pack: Delta; Gamma")
    assert got[3].chunk_id.startswith("structured-summary::") and len(got[3].chunk_id) == 32 and got[4].company == "Gamma"


def test_no_questions_and_no_rows(spark, wide):
    nothing = table(spark, ASKED).limit(0)
    assert questions.plans(nothing, wide).count() == 0
    p = questions.plans(table(spark, ASKED), wide.limit(0))
    assert p.count() == len(ASKED) and answers.answers(p, wide.limit(0)).count() == 0


def test_values_of_any_length_are_found(spark, wide):
    short = wide.limit(1).withColumns({"company": F.lit("X"), "primary_oems": F.lit("Q1"), "location": F.lit("Pine"), "category": F.lit("c")})
    p = questions.plans(table(spark, ["is x linked to q1 in pine?"]), short).first()
    assert (p.oems, p.companies, p.locations) == (["Q1"], [], ["Pine"])


def test_lines_are_made_once_for_all_questions_that_share_them(spark, wide, monkeypatch):
    made = {}
    monkeypatch.setattr(answers, "written", lambda df, label, by=None: made.setdefault(label, written(df, label, by)))
    few, many = (table(spark, [ASKED[18], ASKED[13]] * k) for k in (1, 20))
    sizes = []
    for t in (few, many):
        made.clear()
        assert answers.structured(questions.plans(t, wide), wide).where("place = 0").count() == t.count()
        sizes.append(made["summary-lines"].count())
    assert sizes[0] == sizes[1] > 0


def test_large_keys_are_dealt_in_blocks(spark):
    a = spark.range(3000).select((F.col("id") % 2 * F.col("id")).alias("k"), F.col("id").alias("x"))
    b = spark.range(700).select((F.col("id") % 7).alias("k"), F.col("id").alias("y"))
    got = dealt(a, b, "k", [F.col("x")], [F.col("y")], side=50)
    want = a.join(b, "k")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # key 0 has 1500 x 100 pairs; a task of one key alone would hold them all
    aqe = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = dealt(a, b, "k", [F.col("x")], [F.col("y")], side=50).where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", aqe[1])
    assert sum(r[1] for r in tasks) == 150_000 and max(r[1] for r in tasks) < 75_000


def test_texts_are_planned_once_and_lists_made_only_where_needed(spark, wide, monkeypatch):
    made = []
    monkeypatch.setattr(answers, "written", lambda df, label, by=None: made.append((label, written(df, label, by))) or made[-1][1])
    asked = table(spark, [ASKED[0], ASKED[11], ASKED[10], None, ""] * 4)
    got = answers.answered(asked, wide)
    want = answers.answers(questions.plans(asked, wide), wide)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0
    rows_of = lambda label: [df.count() for k, df in made if k == label]
    assert rows_of("plans")[0] == 3
    # the answered count needs no list of its rows, and after the linked companies nothing is tried
    assert rows_of("lines")[:2] == [4, 1]


def test_results_larger_than_both_sides_are_handed_out_in_bounded_tasks(spark):
    asked = spark.range(900).select(F.col("id").alias("q"), (F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.when(F.col("id") % 5 > 0, "r").alias("rule"))
    asked = asked.unionByName(asked.where("q < 10"))
    lines = spark.range(1200).select((F.col("id") % 4).alias("k"), F.col("id").alias("line"))
    got, want = handed_out(asked, lines, "k", "q", [F.col("line")], side=50, batch=60), asked.join(lines, "k").select("q", "k", "rule", "line")
    assert sorted(got.columns) == sorted(want.columns) and got.count() == want.count() > 200_000
    assert got.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(*want.columns)).isEmpty()
    tasks = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 20 and max(tasks) < want.count() / 8


def test_files_of_a_result_that_is_handed_out_hold_a_number_once_for_its_lines(spark, tmp_path):
    asked = spark.range(8000).select(F.xxhash64("id").alias("q"), F.lit(1).alias("k"))
    lines = spark.range(500).select(F.lit(1).alias("k"), F.sha1(F.col("id").cast("string")).alias("key"), F.concat(F.lit("- Company: "), F.col("id").cast("string")).alias("line"))
    handed_out(asked, lines, "k", "q", [F.col("key")]).write.parquet(f"{tmp_path}/out")
    files = list((tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in files) < 4_000_000


def test_rows_of_large_keys_stay_where_they_are_if_few_meet_them(spark):
    a = spark.range(4000).select((F.col("id") % 2 * F.col("id")).alias("k"), F.col("id").alias("x"))
    b = spark.range(5).select((F.col("id") % 4).alias("k"), F.col("id").alias("y"))
    got, want = dealt(a, b, "k", [F.col("x")], [F.col("y")], side=50), a.join(b, "k")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # key 0 has 2000 rows on the left: they are where they were read, in all parts
    at = [r[0] for r in got.where("k = 0").select("x", F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(at) == a.rdd.getNumPartitions()
