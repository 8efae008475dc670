"""Tables that grow by committed steps: response logs that resume, and a vector index that is kept up to date chunk by chunk.

Every step writes a folder of its own and then a commit that names it, so what was written without being committed (a lost
driver, a repeated attempt) is never read, and what was committed is never written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written


class Ledger:
    """A folder of committed steps. A step's name is committed once; steps are few (one a batch or version), so their commits may be listed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[dict]:
        """What was committed, in order."""
        try:
            found = self.spark.read.text(f"{self.root}/commits/*").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((json.loads(r[0]) for r in found), key=lambda c: (c["at"], c["step"]))

    def folder(self, step: str) -> str:
        return f"{self.root}/steps/{step}-{uuid.uuid4().hex}"

    def commit(self, step: str, **told) -> dict:
        """Fails if the step was committed meanwhile."""
        found = {"step": step, "at": len(self.commits()), **told}
        self.spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("error").text(f"{self.root}/commits/{step}")
        return found


class Log(Ledger):
    """Rows by key, each once: a batch adds those whose key is not there yet, and a batch that was committed adds nothing when it is repeated."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        super().__init__(spark, root)
        self.keys = list(keys)

    def rows(self) -> DataFrame | None:
        """All committed rows with their batch; none committed: None."""
        found = [c for c in self.commits() if c["rows"]]
        if not found:
            return None
        return self.spark.read.parquet(*[c["folder"] for c in found])

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose key isn't committed: what a resumed run has left to do. A null in a key is a value of its own."""
        done = self.rows()
        if done is None:
            return rows
        done = done.select(*self.keys).distinct().select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        met = F.lit(True)
        for k in self.keys:
            met = met & rows[k].eqNullSafe(done[f"_{k}"])
        return rows.join(done, met, "left_anti")

    def append(self, rows: DataFrame, batch: str) -> int:
        """Adds a batch and tells how many rows came; 0 if the batch was committed before. Of several rows of a key in it one stays."""
        if any(c["step"] == batch for c in self.commits()):
            return 0
        folder = self.folder(batch)
        self.missing(rows).dropDuplicates(self.keys).withColumn("batch", F.lit(batch)).write.parquet(folder)
        n = self.spark.read.parquet(folder).count()
        self.commit(batch, folder=folder, rows=n)
        return n

    def export(self, path: str) -> None:
        """The committed rows as lines of JSON."""
        found = self.rows()
        if found is not None:
            found.write.mode("overwrite").json(path)


class VectorIndex(Ledger):
    """Vectors of chunks, kept up to date: a version encodes the chunks that are new or changed and keeps the others' vectors and files.

    A version's step holds vectors (chunk_id, print, the chunks' columns, embedding) and live (chunk_id, print, part), which tells where each of its chunks lies.
    """

    def __init__(self, spark: SparkSession, root: str, model: str):
        super().__init__(spark, root)
        self.model = model

    def prints(self, chunks: DataFrame) -> DataFrame:
        """chunks with print, a fingerprint of model and text; of several chunks of an id that of the least print counts."""
        told = F.sha1(F.encode(F.concat_ws("\x1f", F.lit(self.model), F.coalesce("text", F.lit("\x00"))), "UTF-8"))
        rows = chunks.withColumn("print", told)
        least = rows.groupBy("chunk_id").agg(F.min("print").alias("_print"))
        return rows.join(least, "chunk_id").where(F.col("print") == F.col("_print")).drop("_print").dropDuplicates(["chunk_id"])

    def update(self, chunks: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> dict:
        """Makes the index hold just these chunks and tells version, encoded, kept and gone. encode adds embedding to chunks; it sees new and changed ones only. Unchanged chunks: no new version."""
        last = next(iter(reversed(self.commits())), None)
        rows = written(self.prints(chunks), "index-prints")
        if last:
            live = self.spark.read.parquet(f"{last['folder']}/live")
            old = live.select("chunk_id", F.col("print").alias("_print"), F.col("part").alias("_part"))
            met = rows.join(old, "chunk_id", "left")
            kept = met.where(F.col("print") == F.col("_print")).select("chunk_id", "print", F.col("_part").alias("part"))
            new = met.where(F.col("_print").isNull() | (F.col("print") != F.col("_print"))).drop("_print", "_part")
            gone = live.join(rows.select("chunk_id"), "chunk_id", "left_anti").count()
            if not gone and new.isEmpty():
                return last | {"encoded": 0, "kept": last["chunks"], "gone": 0}
        else:
            kept, new, gone = None, rows, 0
        version = f"v{len(self.commits()):06d}"
        folder = self.folder(version)
        encode(new).write.parquet(f"{folder}/vectors")
        fresh = self.spark.read.parquet(f"{folder}/vectors").select("chunk_id", "print", F.lit(folder).alias("part"))
        (fresh if kept is None else kept.unionByName(fresh)).write.parquet(f"{folder}/live")
        encoded, total = fresh.count(), self.spark.read.parquet(f"{folder}/live").count()
        return self.commit(version, folder=folder, model=self.model, encoded=encoded, kept=total - encoded, gone=gone, chunks=total)

    def read(self) -> DataFrame | None:
        """The chunks of the last version with their vectors and the step (part) that encoded them; no version: None. Only parts that still hold a chunk are read."""
        last = next(iter(reversed(self.commits())), None)
        if not last:
            return None
        live = self.spark.read.parquet(f"{last['folder']}/live")
        parts = [r[0] for r in live.select("part").distinct().collect()]  # as many as versions
        if not parts:
            return self.spark.read.parquet(f"{last['folder']}/vectors").limit(0).withColumn("part", F.lit(""))
        vectors = [self.spark.read.parquet(f"{p}/vectors").withColumn("part", F.lit(p)) for p in parts]
        out = vectors[0]
        for v in vectors[1:]:
            out = out.unionByName(v, allowMissingColumns=True)
        return out.join(live, ["chunk_id", "print", "part"], "left_semi")
