from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from loomwork.llm import neardup

from .corpus import documents, frame
from .test_operators import brute_classes, brute_cut, brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rows = documents(n=120)
    docs = frame(spark, rows).select(*COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]

    one = cp.STAGES[0][1](spark, docs, str(tmp_path)).cache()
    assert one.columns == COLUMNS
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert all(kept.get(d) == t for d, t, *_ in rows if t and len(set(t.split())) > 4)
    assert not any(d in kept for d, t, *_ in rows if not t or not any(map(str.isalpha, t)))

    two = cp.STAGES[1][1](spark, one, str(tmp_path)).cache()
    assert two.columns == COLUMNS
    want = {c for _, _, c in brute_classes(list(kept.items()), 5, 80)}
    assert {r["doc_id"] for r in two.collect()} == want

    three = cp.STAGES[2][1](spark, two, str(tmp_path)).cache()
    assert three.columns == COLUMNS
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    cut = {d: (k if gone else texts[d]) for d, (_, gone, k) in brute_cut(list(texts.items()), 20).items() if k or not gone}
    assert {r["doc_id"]: r["text"] for r in three.collect()} == cut
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect() if r["text"] != texts[r["doc_id"]])

    four = cp.STAGES[3][1](spark, three, str(tmp_path)).cache()
    assert four.columns == COLUMNS
    sizes, taken = Counter(), Counter()
    for r in three.collect():
        sizes[r["source"]] += len(r["text"].encode().split())
    for r in four.collect():
        taken[r["source"]] += len(r["text"].encode().split())
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) < 0.5 * sizes[s] for s in sizes)

    five = cp.STAGES[4][1](spark, four, str(tmp_path))
    assert five.where("piece = 0").count() == four.count()
    assert cp.run(spark, str(tmp_path)).count() == five.count()
    assert cp.ORACLE_SQL is None and neardup.classes(two).count() == two.count()


def test_ids_of_several_texts(spark, tmp_path):
    """Null and shared ids: what goes is a copy or near copy of what stays."""
    texts = [t for _, t, *_ in documents(seed=5, n=40)[:40]]
    near = texts[0].split()
    near = " ".join((near * 3)[:200])
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k, t, "en", "a", k) for k, t in enumerate(texts)]
    rows += [(None, texts[1], "en", "b", 1), (7, texts[1], "en", "a", 2), (7, texts[1], "de", "a", 3), (7, near, "en", "a", 4), (200, near + " tail", "en", "a", 5), (None, texts[2].upper(), "en", "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, cp.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    gone = {(7, texts[1]), (102, texts[2]), (200, near + " tail")}
    assert got == sorted([r for r in rows if r[:2] not in gone], key=str)
    again = sorted(map(tuple, cp.near_duplicates(spark, docs.repartition(7), str(tmp_path)).collect()), key=str)
    assert again == got

    doubled = docs.unionByName(docs.withColumn("source", F.lit("c")))
    assert sorted(map(tuple, cp.near_duplicates(spark, doubled, str(tmp_path)).collect()), key=str) == got


def test_empty(spark, tmp_path):
    docs = frame(spark, []).select(*COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_whole_texts_go_to_workers_in_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    docs = spark.range(3000).coalesce(1).selectExpr("id as doc_id", "repeat('some words ', 400) as text", "'en' as lang", "'a' as source", "4400L as n_chars")
    try:
        spark.conf.unset(name)
        cp.language(spark, docs.limit(0), "")
        n = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(n) > 12_000_000 and max(n) < 1.1 * cp.BATCH_BYTES
        spark.conf.set(name, 1 << 25)
        cp.language(spark, docs.limit(0), "")
        assert spark.conf.get(name) == str(1 << 25)  # the session's own
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
