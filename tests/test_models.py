"""Model calls in parallel: order, retries, errors told, runs that resume."""

import threading
import time

from pyspark.sql import functions as F

from loomwork import models, settings
from loomwork.operators import judging, retrieval
from loomwork.sources.ledger import Log


class Flaky:
    """Fails on the first call of a prompt with "flaky", always on "bad"; one client must not be used by two threads."""

    seen: dict = {}

    def __init__(self):
        self.thread = None

    def generate(self, prompt):
        self.thread = self.thread or threading.get_ident()
        assert self.thread == threading.get_ident()
        time.sleep(0.05)
        n = Flaky.seen[prompt] = Flaky.seen.get(prompt, 0) + 1
        if "bad" in prompt or ("flaky" in prompt and n == 1):
            raise ValueError(f"no answer to {prompt}")
        return prompt.upper(), 1, 2


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "q_id int, prompt string").coalesce(1)


def test_calls_keep_order_and_retry(spark):
    texts = [f"p{k}" + (" flaky" if k % 5 == 2 else " bad" if k == 9 else "") for k in range(40)] + [None]
    began = time.monotonic()
    got = models.generate(prompts(spark, texts), Flaky, tries=3, parallel=20).select("q_id", "response.*").collect()
    assert [r.q_id for r in got] == list(range(41))
    assert all(r.answer == (texts[r.q_id] or "").upper() and r.success for r in got if r.q_id != 9)
    assert got[9].success is False and got[9].error_message == "ValueError: no answer to p9 bad" and got[9].attempts == 3 and got[2].attempts == 2 and got[0].attempts == 1
    assert time.monotonic() - began < 60
    one = models.generate(prompts(spark, ["a flaky x"]), Flaky, tries=1).select("response.*").first()
    assert not one.success and one.attempts == 1


def test_reranking_tells_errors(spark):
    class Picky:
        def predict(self, pairs):
            if any(t == "odd" for _, t in pairs):
                raise RuntimeError("odd text")
            return [len(t) for _, t in pairs]

    class Missing:
        def __init__(self):
            raise OSError("no model")

    rows = spark.createDataFrame([("q", "c1", "abc", 1.0), ("q", "c2", "odd", 0.9), ("q", "c3", "abcdef", 0.8)], "q_id string, chunk_id string, text string, final_score double").withColumn("question", F.lit("?"))
    got = {r.chunk_id: r for r in models.rerank_scores(rows, Picky).collect()}
    assert (got["c1"].model_score, got["c2"].model_score, got["c3"].model_score) == (3.0, None, 6.0) and got["c2"].model_error == "RuntimeError: odd text" and got["c1"].model_error is None
    order = retrieval.reranked(models.rerank_scores(rows, Picky), "model_score", weight=60.0).collect()
    assert {r.chunk_id: round(r.final_score, 4) for r in order} == {"c3": round(0.8 + 60 / 61, 4), "c1": round(1.0 + 60 / 62, 4), "c2": 0.9}
    assert {r.model_error for r in models.rerank_scores(rows, Missing).collect()} == {"OSError: no model"}


def test_a_resumed_run_asks_only_what_is_missing(spark, tmp_path):
    class Counting:
        def generate(self, prompt):
            with open(tmp_path / "calls", "a") as f:
                f.write(prompt + "\n")
            if prompt == "p3" and not (tmp_path / "mended").exists():
                raise ValueError("later")
            return prompt.upper(), 1, 1

    log = Log(spark, str(tmp_path / "log"), ["q_id"])
    rows = prompts(spark, [f"p{k}" for k in range(6)])
    first = {r.q_id: r.response for r in models.resumed(rows.where("q_id < 4"), Counting, log, "run", batches=2).collect()}
    assert first[0].answer == "P0" and not first[3].success and len((tmp_path / "calls").read_text().split()) == 4
    (tmp_path / "mended").touch()
    again = {r.q_id: r.response.answer for r in models.resumed(rows, Counting, log, "run", batches=2).collect()}
    assert again == {k: f"P{k}" for k in range(6)}
    assert sorted((tmp_path / "calls").read_text().split()[4:]) == ["p3", "p4", "p5"]


def test_dual_scores_ask_again_for_what_cannot_be_read(spark, tmp_path):
    class Judge:
        def generate(self, prompt):
            mark = tmp_path / prompt.replace(" ", "_")
            first = not mark.exists()
            mark.touch()
            return ("not-a-score" if first and "slow" in prompt else "nothing" if "mute" in prompt else "SCORE=0.90" if "a" in prompt[:1] else "SCORE=0.70"), 1, 1

    asked = spark.createDataFrame([(1, "a slow"), (1, "b"), (2, "a mute"), (2, "b"), (3, "c mute")], "response_id int, prompt string")
    assert {r.response_id: r.score for r in judging.dual(asked, Judge).collect()} == {1: 0.8, 2: 0.7, 3: None}


def test_retrieval_follows_settings(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"word{k} shared".split(), [1.0, k / 10], f"firm {k % 2}") for k in range(8)], "chunk_id string, tokens array<string>, embedding array<double>, company string")
    asked = spark.createDataFrame([(1, "word3 shared", [1.0, 0.3])], "q_id int, question string, embedding array<double>")
    env = {"LOOMWORK_FINAL_TOP_K": "3", "LOOMWORK_COMPANY_CAP": "1", "LOOMWORK_LEXICAL_WEIGHT": "0"}
    got = retrieval.retrieve(asked, chunks, settings=settings.load(env=env)).orderBy("rank").collect()
    assert [r.company for r in got] == ["firm 1", "firm 0"] and got[0].chunk_id == "c3" and round(got[0].final_score, 6) == round(1 / 61, 6)
    assert retrieval.retrieve(asked, chunks, settings=settings.load(env={})).count() == 8


def test_an_embedder_hashes_a_word_once(monkeypatch):
    import hashlib

    from loomwork import models

    hashed, md5 = [], hashlib.md5
    monkeypatch.setattr(models.hashlib, "md5", lambda b: hashed.append(b) or md5(b))
    model = models.HashEmbedder(8)
    got = model.encode(["A b a", "b A", None])
    assert sorted(hashed) == [b"a", b"b"] and (got[2] == 0).all() and abs((got[1] ** 2).sum() - 1) < 1e-9
