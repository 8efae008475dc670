"""Exact dense search that reads a part of the index: vectors in cells around centroids, cells left out by an exact distance bound."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written
from .retrieval import PART_ROWS, part_scores, ranked

#: Vectors that centroids are fitted on, at most, rounds of fitting, and cells at most. They bound what the driver and every task hold; all vectors are indexed.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1024
#: Vectors that a query's first cells hold at least, times k.
FIRST = 8
#: Room for rounding in bounds.
SLACK = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 1e-12)


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of units by Lloyd's rounds from evenly spaced vectors; empty cells keep theirs."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        near = nearest(sample, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def nearest(vectors: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance) of each vector."""
    d = np.sqrt(np.maximum((vectors**2).sum(axis=1)[:, None] - 2 * vectors @ c.T + (c**2).sum(axis=1), 0))
    cell = d.argmin(axis=1)
    # once more without the products' rounding
    return cell, np.linalg.norm(vectors - c[cell], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build(chunks: DataFrame, root: str, *, cells: int | None = None, vector: str = "embedding", chunk: str = "chunk_id") -> None:
    """Writes root/vectors (chunk_id, v; a folder for every cell) and root/cells (cell, n, radius, center). Vectors are of one length, not null; zero vectors are indexed too.

    Cells are as many as half the root of the vectors' number, up to MOST_CELLS. A cell's radius is its farthest vector's distance. A hot cell is written by several tasks.
    """
    rows = chunks.select(F.col(chunk).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        raise ValueError("no vectors")
    share = max(1, n // SAMPLE)
    picked = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0).limit(SAMPLE).select("v").collect() or [rows.select("v").first()]
    sample = units(np.array([r[0] for r in picked], dtype=float))
    c = centroids(sample, min(len(sample), cells or max(1, min(MOST_CELLS, int(n**0.5 / 2)))))
    id_kind = rows.schema["chunk_id"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if b.num_rows:
                cell, d = nearest(units(_matrix(b.column(1))), c)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d)], names=["chunk_id", "v", "cell", "distance"])

    placed = rows.mapInArrow(assign, f"chunk_id {id_kind}, v array<double>, cell int, distance double")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/vectors")
    found = rows.sparkSession.read.parquet(f"{root}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    centers = rows.sparkSession.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "cell int, center array<double>")
    found.join(centers, "cell").coalesce(1).write.parquet(f"{root}/cells")


class Search:
    """One search of an index for a stated set of queries. hits: the query columns, chunk_id, dense_score, dense_rank, equal to an exhaustive search. digits: scores are rounded
    before they are ranked. read(): what it read."""

    def __init__(self, spark: SparkSession, root: str, queries: DataFrame, k: int = 30, *, query: Sequence[str] = ("q_id",), vector: str = "embedding", digits: int | None = None):
        self.root, self.k, self.spark, self.query, self.digits = root, k, spark, list(query), digits
        room = SLACK + (0 if digits is None else 10.0**-digits)  # a score may be rounded up to the k-th one, then the chunk_id decides
        self.visited: set[int] = set()
        cells = sorted(spark.read.parquet(f"{root}/cells").collect(), key=lambda r: r.cell)  # MOST_CELLS at most
        self.sizes = {r.cell: r.n for r in cells}
        c, radius, number = np.array([r.center for r in cells]), np.array([r.radius for r in cells]), np.array([r.cell for r in cells], dtype=np.int32)
        count = np.array([r.n for r in cells])

        def bounds(batches):
            """Per query and cell the largest score that the cell may hold, and whether the cell is among the query's first."""
            for b in batches:
                if not b.num_rows:
                    continue
                q = units(_matrix(b.column(1)))
                d = np.linalg.norm(q[:, None, :] - c[None], axis=2)
                most = np.clip(1 - np.maximum(d - radius, 0) ** 2 / 2, 0, 1) + room
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(count[order], axis=1) - count[order]
                first = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(first, order, before < FIRST * k, axis=1)
                at = np.repeat(np.arange(b.num_rows), len(c))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.tile(number, b.num_rows)), pa.array(most.ravel()), pa.array(first.ravel())], names=["q", "cell", "most", "first"])

        kind = queries.select(*query).schema.simpleString()
        asked = queries.select(F.to_json(F.struct(*query), {"ignoreNullFields": "false"}).alias("q"), F.col(vector).cast("array<double>").alias("v"))
        asked = written(asked, "dense-asked")
        reach = written(asked.repartition(max(1, min(64, asked.count() // 256))).mapInArrow(bounds, "q string, cell int, most double, first boolean"), "dense-bounds")
        one = written(self._scored(asked, reach.where("first")), "dense-first")
        # the k-th best of the first cells is a score that no cell of a lower bound can reach
        kth = one.withColumn("_at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dense_score"), "chunk_id"))).where(F.col("_at") == k).select("q", F.col("dense_score").alias("_kth"))
        more = reach.where("not first").join(kth, "q", "left").where("_kth is null or most >= _kth")
        two = written(self._scored(asked, more), "dense-more")
        both = one.unionByName(two).withColumn("q", F.from_json("q", kind)).select("q.*", "chunk_id", "dense_score")
        self.hits = ranked(both, self.query, "dense_score", rank="dense_rank", limit=k)

    def _scored(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """The best k of each pair of query and cell: cells are read by partition pruning, hot ones in parts."""
        wanted = sorted(r[0] for r in pairs.select("cell").distinct().collect())
        self.visited.update(wanted)
        parts = F.create_map(*[x for c in wanted for x in (F.lit(c), F.lit(-(-self.sizes[c] // PART_ROWS)))]) if wanted else None
        held = self.spark.read.parquet(f"{self.root}/vectors").where(F.col("cell").isin(wanted))
        n = F.element_at(parts, F.col("cell")) if wanted else F.lit(1)
        left = held.select("chunk_id", "v", (F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("chunk_id"), n)).alias("part"))
        right = pairs.select("q", "cell").join(asked, "q").select("q", "v", F.explode(F.sequence(F.lit(0), n - 1)).alias("p"), "cell").select("q", "v", (F.col("cell").cast("long") * (1 << 32) + F.col("p")).alias("part"))
        return part_scores(left, right, self.k, self.digits)

    def read(self) -> dict[str, int]:
        """Cells, files and vectors read, and how many there are."""
        files = self.spark.read.parquet(f"{self.root}/vectors").inputFiles()
        seen = [f for f in files if int(f.split("cell=")[1].split("/")[0]) in self.visited]
        return {"cells": len(self.visited), "of_cells": len(self.sizes), "files": len(seen), "of_files": len(files), "vectors": sum(self.sizes[c] for c in self.visited), "of_vectors": sum(self.sizes.values())}
