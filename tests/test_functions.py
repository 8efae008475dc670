import hashlib
import random
import re
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import fixed, places, scores, segments, text
from loomwork.operators import evaluation


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return d.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Tier 1/2 — OEM!", "tier 1 2 oem"), ("", ""), (None, None), ("  A  b ", "a b")])
def test_normalized(spark, raw, want):
    assert one(spark, text.normalized(F.col("t")), t=raw) == want


def test_cells(spark):
    cases = {None: "", "  a \n b ": "a b", "12.0": "12", "12.5": "12.5", "-3.0": "-3", "v1.0": "v1.0"}
    for raw, want in cases.items():
        assert one(spark, text.cell(F.col("t")), t=raw) == want


def test_answer_text_keeps_blocks(spark):
    assert one(spark, text.answer_text(F.col("t")), t="\n First  line \r\n\n\n\n- a\n -  b\n") == "First line\n\n- a\n- b"


def brute_windows(t, size, overlap):
    out, start = [], 0
    while start < len(t):
        end = min(len(t), start + size)
        if t[start:end].strip():
            out.append(t[start:end].strip())
        if end == len(t):
            break
        start = max(end - overlap, start + 1)
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t=st.text("ab \n", max_size=60), size=st.integers(1, 12), overlap=st.integers(0, 14))
def test_windows(spark, t, size, overlap):
    got = one(spark, text.windows(F.col("t"), size, overlap), t=t)
    assert [r["chunk"] for r in got] == brute_windows(t, size, overlap) and [r["chunk_index"] for r in got] == list(range(len(got)))


def test_windows_bounds(spark):
    assert one(spark, text.windows(F.col("t")), t=None) == []
    with pytest.raises(ValueError):
        text.windows(F.col("t"), 0)


@pytest.mark.parametrize("name", ["", "a", "file::sheet::7", "é😀"])
def test_identifiers(spark, name):
    assert one(spark, text.uuid5(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, text.chunk_id(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(name.encode()).hexdigest()))


def test_citations(spark):
    t = "As [DOC: a_1.] and (doc: b) doc:c/d; see [web:x] https://e.org/p?q, [Source 3] and [doc:a_1]"
    assert one(spark, text.doc_citations(F.col("t")), t=t) == ["a_1", "b", "c/d", ]
    assert one(spark, text.web_citations(F.col("t")), t=t) == ["x", "https://e.org/p?q", "source_3"]
    assert one(spark, text.evidence_citations(F.col("t"), F.lit(3)), t="[E1] [E 3] [E4] [E1] [E0]") == [1, 3]
    assert one(spark, text.citation_coverage(F.col("t"), F.lit(4)), t="[E1] [E2]") == 0.5
    assert one(spark, text.retrieved_citations(F.col("t"), F.col("ids")), t="[DOC:z] [DOC:a]", ids=["DOC:a", "DOC:z", "WEB:b"]) == ["DOC:a", "DOC:z"]
    assert one(spark, text.retrieved_citations(F.col("t"), F.col("ids")), t="x\nEvidence: WEB:b", ids=["DOC:a", "WEB:b"]) == ["WEB:b"]


@pytest.mark.parametrize(("t", "want"), [("I don't know", True), ("I don’t know.", True), ("We cannot find it", True), ("It was found", False), (None, False)])
def test_abstained(spark, t, want):
    assert one(spark, text.abstained(F.col("t")), t=t) is want


def test_html(spark):
    page = '<html><head><title>T &amp; U</title><meta property="og:title" content="Og"><link rel="canonical" href="http://c/"></head><body><nav>menu</nav><script>var a="</p>";</script><main><p>One  two</p><p>3 &lt; 4</p></main></body></html>'
    assert one(spark, text.html_title(F.col("t")), t=page) == "Og"
    assert one(spark, text.html_url(F.col("t")), t=page) == "http://c/"
    assert one(spark, text.html_text(F.col("t")), t=page) == "One two\n3 < 4"
    assert one(spark, text.html_title(F.col("t")), t="<title>T &amp; U</title>") == "T & U"


def test_small_texts(spark):
    assert one(spark, text.preview(F.col("t"), 10), t="abcdef  ghijkl") == "abcdef..."
    assert one(spark, text.preview(F.col("t"), 10), t="a  b") == "a b"
    assert one(spark, text.logged_list(F.col("t")), t="a, b;a\nc,,") == ["a", "b", "c"]
    assert one(spark, text.question_id(F.col("t")), t=" 12.0") == "12"
    assert one(spark, text.word_count(F.col("t")), t=None) == 0
    assert one(spark, text.token_estimate(F.col("t")), t="abc") == 1
    assert one(spark, text.document_text(F.col("t")), t="a  b\r\n\n &amp;lt; \n") == "a b\n&lt;"


@pytest.mark.parametrize(("t", "want"), [("12 Main St, Town, GA 31833", "Georgia"), ("Montgomery, Alabama", "Alabama"), ("Troup County", ""), ("West Virginia", "West Virginia"), ("ga", "Georgia"), (None, ""), ("We met in OR 7 people", "")])
def test_states(spark, t, want):
    assert one(spark, places.state(F.col("t")), t=t) == want


def test_places(spark):
    assert one(spark, places.city(F.col("t")), t="LaGrange, Troup County") == "LaGrange"
    assert one(spark, places.county_of_location(F.col("t")), t="LaGrange, Troup County") == "Troup County"
    assert [one(spark, places.county(F.col("t")), t=t) for t in ("LaGrange, Troup County", "Georgia", "", "Atlanta")] == ["Troup County", "Statewide / Unspecified", "Unknown", "Atlanta"]
    assert [one(spark, places.head_count(F.col("t")), t=t) for t in ("2,700 people", "", "100-200", None)] == [2700, None, 100200, None]
    assert one(spark, places.preferred(F.col("a"), F.col("b")), a=" ", b="Old") == "Old"
    assert one(spark, places.infer_state(F.col("a"), F.col("b")), a="nowhere", b="GA") == "Georgia"


def brute_words(t):
    t = re.sub(r"\s+", " ", (t or "").lower().translate(str.maketrans("", "", text.PUNCTUATION)))
    return [w for w in t.split() if w not in fixed.ARTICLES]


def test_f1_and_rouge(spark):
    rng = random.Random(1)
    words = ["the", "a", "cat", "Dog,", "sat", "mat.", "on"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(40)] + [(None, "x"), ("x", None)]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scores.token_f1(F.col("a"), F.col("b")).alias("f"), evaluation.rouge_l(F.col("a"), F.col("b")).alias("r"), scores.exact_match(F.col("a"), F.col("b")).alias("e"))
    for row in d.collect():
        a, b = brute_words(row["a"]), brute_words(row["b"])
        common = sum(min(a.count(w), b.count(w)) for w in set(b))
        p, r = (common / len(a) if a else 0), (common / len(b) if b else 0)
        assert row["f"] == pytest.approx(2 * p * r / (p + r) if common else 0, abs=6e-5)
        assert row["e"] == float(bool((row["a"] or "").strip() and (row["b"] or "").strip()) and a == b)
        x, y = re.findall("[a-z0-9]+", (row["a"] or "").lower()), re.findall("[a-z0-9]+", (row["b"] or "").lower())
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
        assert row["r"] == pytest.approx(2 * table[-1][-1] / (len(x) + len(y)) if x and y else 0, abs=6e-5)


def test_composites(spark):
    names = ("answer_accuracy", "custom_faithfulness", "custom_response_groundedness", "custom_context_precision", "custom_context_recall", "unsupported_claim_ratio", "contradicted_claim_ratio", "semantic_similarity", "rouge_l", "token_f1")
    kinds = ", ".join(f"{n} double" for n in names)
    full = (0.8, 0.7, 0.75, 0.6, 0.5, 0.2, 0.1, None, None, None)
    d = spark.createDataFrame([full, (0.8, *[None] * 9), (None,) * 10, (1.7, *[None] * 9)], kinds).select(scores.rag_composite().alias("c"), scores.answer_quality().alias("q")).collect()
    want = sum(w * (1 - v if low else v) for (w, low), v in zip(fixed.COMPOSITE.values(), full, strict=False)) * 100
    assert d[0]["c"] == pytest.approx(want, abs=0.006) and d[0]["q"] == 80.0
    assert (d[1]["c"], d[1]["q"]) == (80.0, 80.0) and (d[2]["c"], d[2]["q"]) == (None, None) and d[3]["q"] == 100.0


@pytest.mark.parametrize(("reply", "want"), [("SCORE=0.83", 0.83), ("0.40", 0.4), ("SCORE=1.20", None), ("not a score", None), ("score = .5", 0.5), (None, None)])
def test_judge_scores(spark, reply, want):
    assert one(spark, scores.judge_score(F.col("t")), t=reply) == want


def test_judge_replies(spark):
    assert one(spark, scores.judge_rating(F.col("t")), t="RATING=2") == 2 and one(spark, scores.judge_rating(F.col("t")), t="RATING=5") is None
    assert one(spark, scores.claim_labels(F.col("t")), t='Sure: {"labels":[{"claim_id":1,"label":"Supported"},{"claim_id":2,"label":"unsupported"}]} ok') == {1: "supported", 2: "unsupported"}
    assert one(spark, scores.claim_labels(F.col("t")), t='{"labels":[{"claim_id":1,"label":"maybe"}]}') is None and one(spark, scores.claim_labels(F.col("t")), t="nothing") is None
    assert one(spark, scores.contexts(F.col("t")), t='["a", " b "]') == ["a", "b"] and one(spark, scores.contexts(F.col("t")), t="a\nb\n---\nc\n\nd") == ["a\nb", "c", "d"]


@pytest.mark.parametrize(("flags", "want"), [([True, False], 1.0), ([False, True], 0.5), ([False], 0.0), ([], None), ([True, False, True], 0.8333)])
def test_average_precision(spark, flags, want):
    d = spark.createDataFrame([(flags,)], "f array<boolean>")
    assert d.select(scores.average_precision(F.col("f"))).first()[0] == want


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]


def test_units(spark):
    assert one(spark, segments.units(F.col("t")), t="One is here. Two follows, e.g. this one! Three?\n\n- item a\n- item b") == ["One is here.", "Two follows, e.g. this one!", "Three?", "item a", "item b"]
    assert len(one(spark, segments.units(F.col("t")), t="[A Co | Tier 1 | Georgia; B Co | Tier 2 | Alabama; C Co | OEM | Texas]")) == 3
    assert one(spark, segments.units(F.col("t")), t=None) == [] and one(spark, segments.units(F.col("t")), t=" \n ; ") == []
