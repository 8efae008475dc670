"""Logs that resume and an index that is kept up to date."""

import pytest
from pyspark.sql import functions as F

from loomwork import models
from loomwork.sources.ledger import Log, VectorIndex


class Salted(models.HashEmbedder):
    """Vectors tell which embedder made them."""

    def __init__(self, salt):
        super().__init__(4)
        self.salt = salt

    def encode(self, texts):
        out = super().encode(texts)
        out[:, 0] = self.salt
        return out


def test_a_killed_and_repeated_batch_changes_nothing(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), ["q_id", "run"])
    rows = lambda *ids: spark.createDataFrame([(i, "a", f"answer {i}") for i in ids], "q_id int, run string, answer string")
    assert log.rows() is None and log.missing(rows(1, 2)).count() == 2
    assert log.append(rows(1, 2, 2), "one") == 2
    rows(3, 4).withColumn("batch", F.lit("two")).write.parquet(log.folder("two"))  # the driver was lost before the commit
    assert log.rows().count() == 2
    assert log.append(rows(2, 3, 4), "two") == 2 and log.append(rows(7, 8), "two") == 0
    assert sorted((r.q_id, r.batch) for r in log.rows().collect()) == [(1, "one"), (2, "one"), (3, "two"), (4, "two")]
    assert [r.q_id for r in log.missing(rows(1, 9)).collect()] == [9]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        log.commit("two", folder="x", rows=0)
    null = spark.createDataFrame([(None, "a", "x"), (None, "a", "y")], "q_id int, run string, answer string")
    assert log.append(null, "three") == 1 and log.append(null, "four") == 0 and log.missing(null).count() == 0
    log.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_only_changed_chunks_are_encoded(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"), "m")
    chunks = lambda texts: spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    encode = lambda salt: lambda c: models.embed(c, lambda: Salted(salt))
    assert index.read() is None
    texts = {f"c{k}": f"text {k}" for k in range(20)} | {"none": None}
    made = index.update(chunks(texts), encode(1.0))
    assert (made["encoded"], made["kept"], made["gone"]) == (21, 0, 0)
    assert index.update(chunks(texts), encode(2.0))["encoded"] == 0 and len(index.commits()) == 1
    texts |= {"c3": "changed", "new": "new"}
    del texts["c4"], texts["c5"]
    made = index.update(chunks(texts), encode(3.0))
    assert (made["encoded"], made["kept"], made["gone"]) == (2, 18, 2)
    assert {r.chunk_id for r in index.read().collect() if r.embedding[0] == 3.0} == {"c3", "new"} and index.read().count() == 20
    chunks(texts).write.parquet(index.folder("v000002") + "/vectors")  # a lost driver's files
    assert index.read().count() == 20
    assert index.update(chunks({"c1": "text 1"}), encode(4.0))["encoded"] == 0 and [r.embedding[0] for r in index.read().collect()] == [1.0]
    assert VectorIndex(spark, str(tmp_path / "index"), "other").update(chunks({"c1": "text 1"}), encode(5.0))["encoded"] == 1
    assert index.update(chunks({}), encode(6.0))["chunks"] == 0 and index.read().count() == 0
