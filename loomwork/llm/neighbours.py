"""Approximate nearest neighbours by collision-counting hashing with query-centred windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block; a task searches one shard for one block.
SHARD, BLOCK = 16384, 8192
#: Share of the projections in which a vector must collide with a query to be verified; how much of a band is: this share of it and so many times k.
COLLIDE, VERIFY, FLOOR = 0.85, 0.05, 10
#: Half window of radius 0, in standard deviations of a projection, and what it grows by from radius to radius.
WINDOW, GROW = 1.0, 1.05
#: Buckets of a sorted array; windows begin and end with buckets. Queries that are searched at once.
BUCKETS, ONCE = 256, 8
#: Every so many vectors of a band tell the radius at which enough of them collide.
PROBE = 8
#: A projection whose values deviate by no more than this share of the largest has no spread; its windows would not grow.
FLAT = 1e-9
#: The longest vector of a band over its shortest, at most.
RATIO = 1.2


def usable(vector: Column) -> Column:
    """Not null, not zero, without null, infinite or undefined components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def norms(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


class Band:
    """Vectors of similar norm over the longest of them, lifted by one dimension so that the nearest to a unit query are the nearest by inner product, and the sorted array of each projection in buckets of equal size.

    The projections are an orthonormal base of random direction. A vector is kept as its bucket in each array (a byte).
    """

    def __init__(self, vectors: np.ndarray, norm: np.ndarray):
        unit = vectors / norm.max()
        length = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
        dims = vectors.shape[1] + 1
        self.n, self.radius = len(vectors), 0
        self.base = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]
        self.need = int(np.ceil(COLLIDE * dims))
        values = np.column_stack([unit, length]) @ self.base
        self.spread = values.std(axis=0)
        self.flat = bool((self.spread <= FLAT * np.abs(values).max()).any())
        starts = np.arange(BUCKETS) * self.n // BUCKETS
        self.edges = np.sort(values, axis=0)[starts].T.copy()
        # equal values share their last bucket, so that none lies outside a window that holds another
        self.code = np.stack([np.searchsorted(e, v, side="right") - 1 for e, v in zip(self.edges, values.T, strict=True)]).astype(np.uint8)
        self.probe = self.code[:, ::PROBE].copy()

    def collisions(self, codes: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Queries x vectors: whether a vector collides, lying in a bucket that the query's window touches, in enough projections."""
        half = WINDOW * GROW ** radius.astype(float)
        wide = half[:, None] * self.spread
        first = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(self.edges, (at - wide).T, strict=True)])
        last = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(self.edges, (at + wide).T, strict=True)])
        low = np.maximum(first - 1, 0).astype(np.uint8)[:, :, None]
        width = (np.maximum(last - 1, 0) - low[:, :, 0]).astype(np.uint8)[:, :, None]
        empty = last == 0  # the window ends below the array
        count = np.zeros((len(at), codes.shape[1]), dtype=np.uint8 if len(codes) < 256 else np.uint16)
        away, hit = np.empty(count.shape, dtype=np.uint8), np.empty(count.shape, dtype=bool)
        for k, code in enumerate(codes):
            np.subtract(code, low[k], out=away)  # buckets below the window wrap around and come out large
            np.less_equal(away, width[k], out=hit)
            if empty[k].any():
                hit[empty[k]] = False
            np.add(count, hit.view(np.uint8), out=count)
        return count >= self.need

    def search(self, units: np.ndarray, enough: int) -> np.ndarray:
        """Queries x vectors: which are found.

        The least radius at which enough collide is told by every PROBE-th vector; the walk to it begins at the radius of
        the queries before, which does not change where it ends. Where fewer than half of enough collide then, the radius grows on.
        """
        at = np.column_stack([units, np.zeros(len(units))]) @ self.base
        radius = np.full(len(units), self.radius)
        todo, way = np.arange(len(units)), np.zeros(len(units), dtype=np.int64)  # way: -1 and 1 once it is known to be smaller or larger
        while len(todo):
            hit = self.collisions(self.probe, at[todo], radius[todo])
            full = hit.sum(axis=1) * PROBE >= enough
            done = np.where(full, (way[todo] > 0) | (radius[todo] < -100), way[todo] < 0)
            radius[todo] += np.where(done, ~full, np.where(full, -1, 1))  # the one before was the least, or walk on
            way[todo] = np.where(full, -1, 1)
            todo = todo[~done]
        self.radius = int(np.median(radius))
        found, todo = np.zeros((len(units), self.n), dtype=bool), np.arange(len(units))
        while len(todo):
            found[todo] = self.collisions(self.code, at[todo], radius[todo])
            todo = todo[2 * found[todo].sum(axis=1) < enough]
            radius[todo] += 1
        return found


class Index:
    """A shard's vectors, the longest first, in bands of similar norm. Bands in which enough would be all, or with a projection that has no spread, are found whole.

    A query leaves out the bands whose longest vector can't reach the k-th best inner product that it has.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        norm = norms(vectors)
        order = np.argsort(-norm, kind="stable")
        self.ids, self.vectors, self.k, norm = ids[order], vectors[order], k, norm[order]
        self.bands: list[tuple[slice, float, Band | None, int]] = []
        first = int(np.isinf(norm).sum())
        if first:
            self.bands.append((slice(0, first), np.inf, None, first))
        while first < len(ids):
            own = slice(first, int(np.searchsorted(-norm, -norm[first] / RATIO, side="right")))
            n = own.stop - own.start
            enough = FLOOR * k + int(VERIFY * n)
            band = Band(self.vectors[own], norm[own]) if enough < n else None
            self.bands.append((own, float(norm[first]), None if band is None or band.flat else band, enough))
            first = own.stop

    def search(self, query_ids: np.ndarray, queries: np.ndarray):
        """(query's place, ids, scores) of the k nearest found. Queries count by direction: their length does not change the order."""
        most = np.abs(queries).max(axis=1, keepdims=True)
        size = norms(queries)
        units = queries / most
        units /= norms(units)[:, None]
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        for own, longest, band, enough in self.bands:
            # rounding can't hide a vector: the bound has room for it
            open_ = np.array([len(f) < self.k or not s[-1] > longest * n * (1 + 1e-9) for (f, s), n in zip(best, size, strict=True)])
            turn = np.flatnonzero(open_)
            if not len(turn):
                continue
            hits = band.search(units[turn], enough) if band else np.ones((len(turn), own.stop - own.start), dtype=bool)
            for q, hit in zip(turn, hits, strict=True):
                best[q] = self.verify(query_ids[q], queries[q], np.concatenate([best[q][0], np.flatnonzero(hit) + own.start]))
        for place, (found, score) in enumerate(best):
            yield place, self.ids[found], score

    def verify(self, query_id: int, query: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.k
        found = found[self.ids[found] != query_id]
        vectors = self.vectors[found]
        rough = vectors @ query
        if len(found) > k:  # all that may be among the first k, ties included
            slack = 1e-9 * (1 + np.abs(rough).max())
            close = rough >= np.partition(rough, -k)[-k] - slack
            found, vectors = found[close], vectors[close]
        score = (vectors * query).sum(axis=1)  # the same sum for the same vector, wherever it stands
        first = np.lexsort((self.ids[found], -score))[:k]
        return found[first], score[first]


def _search(k: int):
    def run(batches):
        cell, ids, vectors, index = None, [], [], None
        for batch in batches:
            cells, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            own = batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            width = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(width)
            cut = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(cells)], strict=True):
                if a == b:
                    continue
                part = flat[ends[a] - width[a] : ends[b - 1]].reshape(b - a, -1)
                if cells[a] != cell:
                    cell, ids, vectors, index = cells[a], [], [], None
                if kinds[a] == 0:
                    ids.append(own[a:b])
                    vectors.append(part)
                    continue
                if not ids:
                    continue
                index = index or Index(np.concatenate(ids), np.concatenate(vectors), k)
                for s in range(0, b - a, ONCE):
                    for place, near, score in index.search(own[a + s : min(a + s + ONCE, b)], part[s : s + ONCE]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), own[a + s + place])), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    def gathered(batches):
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows > 10_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return gathered


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query its k nearest by inner product as far as found: query_id, rank (from 1), vec_id, score.

    Of equally near ones the smaller id comes first; scores are exact on the original vectors, in double
    precision. A row with the query's own id is no candidate. Unusable vectors (usable()) and null ids take no part,
    vectors of other lengths don't meet. Rows with one id: the best counts; as queries: the least vector. No rows: no rows.

    Every shard of at most about SHARD vectors is indexed and searched for every block of queries; shards grow in
    number with the vectors, not in size. The first k of each are merged. Recall is set by VERIFY and FLOOR: about so
    many of each band of a shard, those that collide with the query in most projections, are compared exactly.
    """
    clean = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base, asked = clean(vectors).distinct(), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, q = base.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // BLOCK))
    spread = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    own = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    left = base.select("id", "v", own(shards).alias("s"), spread("b", blocks)).withColumn("kind", F.lit(0))
    right = asked.select("id", "v", spread("s", shards), own(blocks).alias("b")).withColumn("kind", F.lit(1))
    both = left.unionByName(right).select(F.xxhash64(F.size("v"), "s", "b").alias("cell"), "kind", "id", "v")
    both = both.repartition(shards * blocks, "cell").sortWithinPartitions("cell", "kind")
    found = both.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
