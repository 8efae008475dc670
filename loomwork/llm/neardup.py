"""N-gram Jaccard join: exact links between documents by dual traversal of signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom, may_hold, written
from .components import components
from .substrings import numbers, whole_groups
from .textkit import byte_hashes, mixed, ranges, slices, span_hashes, tidy, words

#: Bits of a signature.
BITS = 2048
#: Buckets in which all shingles are counted to tell rare ones, and rows in which a task sends its counts.
BUCKETS, CHUNKS = 1 << 20, 256
#: Of so many keys that two sets must share one of, they must share a quarter of if each has a quarter more.
PART = 4
#: Keys of a bucket with so many shingles, and so many times an average one's, are grouped in parts first.
HOT, TIMES = 200, 4
#: Children of a node of a tree, and the largest groups in which the first round looks for all pairs.
FAN, FULL = 4, 16
#: Rows of one key that one task joins, and rows of a group that one task traverses with themselves.
SPLIT, BLOCK = 500, 4096
#: Blocks (64 bits each) of the filter that texts pass before they are shuffled.
BLOOM = 1 << 16
_NULL_ID = -(1 << 63)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within each; first of each text and the number of all).

    Words are lower-cased in A-Z. A text of fewer words than size has one shingle, its whole sequence; one without words none.
    """
    buf, starts, ends, first = words(column)
    hashes = byte_hashes(_FOLDED[buf], starts, ends)
    n = np.diff(first)
    short = np.minimum(n, size)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = ranges(first[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    h = span_hashes(hashes, at, at + short[doc])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _tally(size: int):
    """Each task's counts of all buckets (255 stands for more), in chunks."""

    def run(batches):
        count = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                count += np.bincount(_bucket(shingles(part.column(1), size)[0]), minlength=BUCKETS)
        rows = np.minimum(count, 255).astype(np.uint8).reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["chunk", "counts"])

    return run


def _summed(batches):
    """The sums of the counts of each chunk in a task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])


def bucket_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many shingles fall into each bucket. The order that follows from it, rare ones first, gives the same links as any other; it keeps groups small.

    BUCKETS numbers come to the driver and go to the tasks, however many documents there are.
    """
    found = texts.mapInArrow(tidy(_tally(size)), "chunk long, counts binary").repartition("chunk").mapInArrow(tidy(_summed), "chunk long, counts binary")
    count = np.zeros((CHUNKS, BUCKETS // CHUNKS), dtype=np.int64)
    for chunk, counts in found.collect():
        count[chunk] += np.frombuffer(counts, dtype=np.int64)
    return np.minimum(count.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _profiles(size: int, percent: int, counts: np.ndarray, hot: int):
    """A row for each document: set size, two hashes of the set, its keys, how many of them it must share, its signature.

    Under one order of all shingles, those of the emptiest buckets first, two sets of that similarity share one of the first
    n - ceil(n * similarity) + 1 of each, and with k - 1 more of each, k. A pair must share the lesser need of its two.
    Keys of full buckets stand apart (hot).
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                h, first = shingles(part.column(1), size)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                level = counts[_bucket(h)]
                one = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                need = np.maximum(one // PART, 1)
                keep = np.where(n > 0, one + need - 1, 0)
                order = np.lexsort((h, level, doc))
                own = order[ranges(first[:-1], keep)]
                keys, full, owner = h[own].view(np.int64), level[own] >= hot, np.repeat(np.arange(len(n)), keep)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[k], minlength=len(n)))]).astype(np.int32)), pa.array(keys[k])) for k in (~full, full)]
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mixed(h), mixed(h ^ np.uint64(0x5BD1E995)))]
                bits = np.zeros(len(n) * BITS, dtype=bool)
                bits[doc * BITS + ((h >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)] = True
                sig = np.packbits(bits).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(n.astype(np.int64))]
                    + [pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums]
                    + [*lists, pa.array(need.astype(np.int64)), pa.array([sig[i : i + BITS // 8] for i in range(0, len(sig), BITS // 8)], pa.binary())],
                    names=["doc", "id", "row", "n", "s1", "s2", "keys", "hot", "need", "sig"],
                )

    return run


def ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


class Forest:
    """A signature tree for each group of documents, all built at once; documents are in the order given, groups one after the other.

    levels[0] are the documents, every node above stands for up to FAN in a row of the level below: the OR of their
    bitmaps, the range of their sizes, the most shingles of one of them that share bits, the least and greatest
    component. below[l] has the first and last child of the nodes of level l + 1; group is each node's group.
    """

    def __init__(self, group: np.ndarray, sig: np.ndarray, n: np.ndarray, comp: np.ndarray):
        self.levels = [(sig, n, n, n - ones(sig), comp, comp)]
        self.group, self.below = [group], [(None, None)]
        self.roots: list[np.ndarray] = [np.zeros(0, np.int64)]
        at = np.arange(len(group))  # nodes that still get parents
        while len(at):
            own = self.group[-1][at]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(new, append=len(own))
            within = np.arange(len(own)) - np.repeat(new, size)
            cut = np.flatnonzero(within % FAN == 0)
            first = at[cut]
            last = first + np.diff(cut, append=len(own))
            # nodes without parents lie between groups only, so a parent's children stand in a row
            sig, low, high, slack, c, d = (x[at] for x in self.levels[-1])
            over = ((np.bitwise_or, sig), (np.minimum, low), (np.maximum, high), (np.maximum, slack), (np.minimum, c), (np.maximum, d))
            self.levels.append(tuple(f.reduceat(x, cut) for f, x in over))
            self.group.append(own[cut])
            self.below.append((first, last))
            above = np.repeat(-(-size // FAN), -(-size // FAN))  # nodes of each node's group
            self.roots.append(np.flatnonzero(above == 1))
            at = np.flatnonzero(above > 1)


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair under nodes a[i] and b[j] can be similar enough and is of two components.

    Of a set, at most slack + |bits that both have| shingles can be shared: the set's other bits stand for at least one shingle each that the other lacks.
    """
    sig, low, high, slack, c, d = a
    sig2, low2, high2, slack2, c2, d2 = b
    ok = (100 * high[i] >= percent * low2[j]) & (100 * high2[j] >= percent * low[i]) & ~((c[i] == d[i]) & (c2[j] == d2[j]) & (c[i] == c2[j]))
    k = np.flatnonzero(ok)
    for s in range(0, len(k), 1 << 14):  # so that memory stays bounded
        q = k[s : s + (1 << 14)]
        x, y = i[q], j[q]
        both = ones(sig[x] & sig2[y])
        most = np.minimum(np.minimum(high[x], high2[y]), np.minimum(slack[x], slack2[y]) + both)
        # overlap >= t / (1 + t) * (sum of sizes)
        ok[q] = (100 + percent) * most >= percent * (low[x] + low2[y])
    return ok


def traverse(forest: Forest, percent: int, starred: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents of one group that may link, by descending from the pairs of roots; depth first in parts, so the frontier stays bounded.

    Of starred groups (by number) only pairs with the first document are wanted: on that side the first child alone is visited.
    """
    todo = [(level, r, r) for level, r in enumerate(forest.roots) if len(r)]
    while todo:
        level, i, j = todo.pop()
        keep = may_link(forest.levels[level], i, forest.levels[level], j, percent)
        if level == 0:
            yield i[keep], j[keep]
            continue
        i, j = i[keep], j[keep]
        first, last = forest.below[level]
        wide = np.where(starred[forest.group[level][i]], 1, last[i] - first[i])
        deep = last[j] - first[j]
        ends = np.cumsum(wide * deep)
        cuts = np.searchsorted(ends, np.arange(most, (ends[-1] if len(ends) else 0) + most, most), side="right")
        for a, b in zip([0, *cuts], [*cuts, len(i)], strict=True):
            if a == b:
                continue
            area = (wide * deep)[a:b]
            at = np.repeat(np.arange(a, b), area)
            k = ranges(np.zeros(b - a, np.int64), area)
            x, y = first[i[at]] + k // deep[at], first[j[at]] + k % deep[at]
            ok = x < y if level == 1 else x <= y
            todo.append((level - 1, x[ok], y[ok]))


def _candidates(percent: int):
    """Pairs of documents of two components in one group that may link, by one tree a group. With each pair goes how many keys it shares there and how many it needs."""

    def run(batches):
        for t in whole_groups(batches):
            cell, doc, n, comp, need, block, head, star, keys = (numbers(t.column(i)) for i in range(9))
            sig = np.frombuffer(b"".join(t.column(9).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
            order = np.lexsort((doc, n, comp, ~head, cell))
            cell, doc, n, comp, need, block, star, keys, sig = (x[order] for x in (cell, doc, n, comp, need, block, star, keys, sig))
            new = np.concatenate([[True], cell[1:] != cell[:-1]])
            found = Found(doc, need, block, keys)
            for i, j in traverse(Forest(np.cumsum(new) - 1, sig, n, comp), percent, star[new]):
                found.add(i, j)
                if found.rows > 1 << 18:
                    yield found.batch()
            yield found.batch()

    return run


class Found:
    """Pairs of rows, gathered and counted. block: below 0 for rows of a group joined with itself; else only pairs of two blocks count, as those of one are found elsewhere."""

    def __init__(self, doc: np.ndarray, need: np.ndarray, block: np.ndarray, keys: np.ndarray):
        self.doc, self.need, self.block, self.keys = doc, need, block, keys
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        keep = (self.block[i] < 0) | (self.block[i] != self.block[j])
        i, j = i[keep], j[keep]
        a, b = self.doc[i], self.doc[j]
        self.parts.append((np.maximum(a, b), np.minimum(a, b), np.minimum(self.need[i], self.need[j]), self.keys[i]))
        self.rows += len(i)

    def batch(self) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        a, b, need, keys = (np.concatenate([none, *x]) for x in (zip(*self.parts, strict=True) if self.parts else ((), (), (), ())))
        order = np.lexsort((b, a))
        a, b, need, keys = a[order], b[order], need[order], keys[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else none
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new], b[new], need[new], np.add.reduceat(keys, new) if len(a) else none)], names=["a", "b", "need", "times"])


def _sets(size: int):
    """The shingle set of each document, once for each of its places (head, salt)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                h, first = shingles(part.column(1), size)
                places = part.column(2)
                each = numbers(places.value_lengths())
                flat = places.flatten()
                doc = np.repeat(np.arange(part.num_rows), each)
                for s in range(0, len(doc), 256):
                    d = doc[s : s + 256]
                    n = first[d + 1] - first[d]
                    sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h[ranges(first[d], n)].view(np.int64)))
                    place = flat.slice(s, 256)
                    yield pa.RecordBatch.from_arrays([place.field(0), place.field(1), part.column(0).take(pa.array(d)), sets], names=["place", "head", "doc", "set"])

    return run


def _verify(percent: int):
    """Exact links in groups of one place: the head's set (first) against the others'."""

    def run(batches):
        place, heads = None, []
        for batch in batches:
            at, head, doc = (numbers(batch.column(i)) for i in range(3))
            sets = batch.column(3)
            cuts, flat = np.concatenate([[0], np.cumsum(numbers(sets.value_lengths()))]), numbers(sets.flatten())
            a, b = [], []
            for i in range(batch.num_rows):
                own = flat[cuts[i] : cuts[i + 1]]
                if place != at[i]:
                    place, heads = at[i], []
                if doc[i] == head[i]:
                    heads.append((head[i], own.copy()))
                    continue
                for h, other in heads:
                    if h == head[i]:
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            a.append(doc[i])
                            b.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, each: int = 500) -> DataFrame:
    """Those of pairs (a, b), distinct, whose sets are similar enough.

    The sets are made again from the texts of the documents in pairs, which a Bloom filter of bounded size tells before
    the texts are shuffled, and dealt by b; a b of very many pairs is salted, with a copy of its set for every so many of them.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / each).cast("int").alias("salts"))
    dealt = pairs.join(salts, "b").select(F.col("a").alias("doc"), F.col("b").alias("head"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    own = salts.select(F.col("b").alias("doc"), F.col("b").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    places = dealt.union(own).select("doc", F.struct(F.xxhash64("head", "salt").alias("place"), "head").alias("at"))
    places = written(places.groupBy("doc").agg(F.collect_list("at").alias("places")), "places")
    wanted = texts.join(F.broadcast(bloom(places, "doc", BLOOM))).where(may_hold(F.col("_bloom"), F.col("doc"), BLOOM))
    rows = wanted.select("doc", "text").join(places, "doc").select("doc", "text", "places")
    rows = rows.mapInArrow(tidy(_sets(size)), "place long, head long, doc long, set array<long>")
    rows = rows.repartition("place").sortWithinPartitions("place", "head", F.col("doc") != F.col("head"))
    return rows.mapInArrow(tidy(_verify(percent)), "a long, b long")


def _apart(texts: DataFrame) -> tuple[DataFrame, bool]:
    """texts (id, text) with doc, a number for every id and text: the id itself, or a hash of both for ids of several texts. And whether there are such ids."""
    th = F.xxhash64("text")
    several = texts.groupBy("id").agg(F.min(th).alias("lo"), F.max(th).alias("hi")).where("lo <> hi")
    several = written(several.select("id", F.lit(True).alias("_several")), "several")
    if several.isEmpty():
        return texts.withColumn("doc", F.col("id")), False
    return texts.join(several, "id", "left").withColumn("doc", F.when(F.col("_several"), F.xxhash64("id", "text")).otherwise(F.col("id"))).drop("_several"), True


def _grouped(rows: DataFrame, parts) -> DataFrame:
    """rows (key, doc, comp, keys) of keys that two components hold, with the key's head (least doc), number of rows, and a hash of its documents (any order).

    Keys are grouped in so many parts first, and joined back part by part, so none of many rows meets in one task.
    """
    rows = rows.select("key", "doc", "comp", "keys", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"))
    some = rows.groupBy("key", "part").agg(F.min("doc").alias("head"), F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("doc")).alias("x"))
    sums = [F.min("head").alias("head"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_xor("x").alias("x")]
    whole = some.groupBy("key").agg(*sums).where("lo <> hi").drop("lo", "hi")
    return rows.join(some.select("key", "part").join(whole, "key"), ["key", "part"]).drop("part")


def _enough(rows: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """rows of documents with as many keys as the smallest partner would need."""
    least = F.floor((percent * F.col("n") + 99) / 100)
    one = least - F.floor((percent * least + 99) / 100) + 1
    held = rows.groupBy("doc").agg(F.sum("keys").alias("held")).join(kept.select("doc", "n"), "doc")
    return rows.join(held.where(F.col("held") >= F.greatest(F.floor(one / PART), F.lit(1))).select("doc"), "doc", "left_semi")


def _pairs(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the trees of cells find often enough."""
    columns = ["cell", "doc", "n", "comp", "need", "block", "head", "star", "keys", "sig"]
    found = cells.select(*columns).repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(_candidates(percent)), "a long, b long, need long, times long")
    return found.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where("times >= need").select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (least doc_id that links reach).

    Two documents link if 100 * shared >= percent * union of their sets of size-word shingles (at least one
    shingle; words lower-cased in A-Z; shorter texts are one shingle). Null and blank texts link with nothing.
    Rows with one id are one document with the links of each. ids are integers; null is an id, the least (-2^63 stands for it).

    1. Equal sets are one node. Every two sets that link share a number of their keys, their first shingles under one
       order, so every key's documents make a group; documents that share too few keys to link are left out. Keys with
       the same documents make one group, which counts as so many keys.
    2. Each group has a signature tree. A first traversal finds all pairs of small groups that sizes and bitmaps allow,
       and in large ones those with the group's least document; they are compared, and components follow.
    3. The groups still held by two components are traversed anew for all pairs of different components, and those that
       share as many keys as they need are compared. Large groups are dealt as pairs of blocks.
    Every pair that could link is compared or lies in one component already, so no link is lost.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts, apart = _apart(texts)
    texts = texts.select("doc", "text", "id")
    counts = bucket_counts(texts, size)
    hot = max(HOT, int(TIMES * counts.mean()))  # so that a key of the others holds a small part of all rows, at any size
    made = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(_profiles(size, percent, counts, hot)), "doc long, id long, row long, n long, s1 long, s2 long, keys array<long>, hot array<long>, need long, sig binary")
    profiles = written(made, "profiles")
    live = profiles.where("n > 0")
    parts = F.lit(max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    same = ["s1", "s2", "n"]
    slim = live.select(*same, "doc", "row", F.pmod(F.xxhash64("row"), parts).alias("part"))
    some = slim.groupBy(*same, "part").agg(F.min(F.struct("doc", "row")).alias("node"), F.count("*").alias("rows"))
    whole = some.groupBy(*same).agg(F.min("node").alias("node"), F.sum("rows").alias("rows")).where("rows > 1")
    copies = slim.join(some.select(*same, "part").join(whole, same), [*same, "part"]).where(F.col("row") != F.col("node.row"))
    copies = written(copies.select("row", "doc", F.col("node.doc").alias("node")), "copies")
    alone = live.join(copies.select("row"), "row", "left_anti")
    kept = alone.select("doc", "n", "need", "sig")

    keys = lambda column: alone.select(F.explode(column).alias("key"), "doc")
    one = lambda c: c.over(Window.partitionBy("key"))
    cold = keys("keys").select("key", "doc", one(F.min("doc")).alias("head"), one(F.count("*")).alias("rows"), one(F.bit_xor(F.xxhash64("doc"))).alias("x")).where("rows > 1")
    full = _grouped(keys("hot").withColumn("comp", F.col("doc")).withColumn("keys", F.lit(1).cast("long")), parts)
    shared = cold.withColumn("keys", F.lit(1).cast("long")).unionByName(full.drop("comp"))
    shared = _enough(written(shared, "shared"), kept, percent)
    shared = shared.groupBy("x", "rows", "head", "doc").agg(F.min("key").alias("key"), F.sum("keys").alias("keys"))
    shared = written(shared.select("key", "keys", "doc", F.col("doc").alias("comp"), "head", "rows"), "shared")
    blocks = F.ceil(F.col("rows") / SPLIT).cast("int")
    head = F.col("doc") == F.col("head")
    block = F.explode(F.when(head, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), blocks).cast("int"))))
    cells = shared.withColumn("at", block).select(F.xxhash64("key", "at").alias("cell"), "doc", "comp", "keys", F.lit(-1).cast("long").alias("block"), head.alias("head"), (F.col("rows") > FULL).alias("star"))
    first = written(_pairs(cells.join(kept, "doc"), percent), "pairs")
    known = copies.where("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    if apart:
        ids = profiles.select("id", "doc").distinct()
        known = known.union(ids.join(ids.groupBy("id").agg(F.min("doc").alias("b")), "id").select(F.col("doc").alias("a"), "b").where("a <> b"))
    label = components(written(verified(first, texts, size, percent), "links").union(known)).select(F.col("a").alias("doc"), F.col("b").alias("comp"))

    rest = shared.drop("comp").join(label, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    rest = written(_enough(written(_grouped(rest, F.ceil(F.col("rows") / SPLIT)), "shared"), kept, percent), "shared")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), F.when(k == block, -1).otherwise(block).alias("block")))
    cells = rest.select(F.explode(cells).alias("at"), "key", "keys", "doc", "comp")
    cells = cells.select(F.xxhash64("key", "at.i", "at.j").alias("cell"), "doc", "comp", "keys", F.col("at.block").cast("long").alias("block"), F.lit(False).alias("head"), F.lit(False).alias("star"))
    second = written(_pairs(cells.join(kept, "doc"), percent).join(first, ["a", "b"], "left_anti"), "pairs")
    links = verified(second, texts, size, percent)
    name = lambda c: label.select(F.col("doc").alias(c), F.col("comp").alias(f"{c}_comp"))
    links = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    joined = components(links).select(F.col("a").alias("comp"), F.col("b").alias("least"))

    out = profiles.select("id", "doc", "n").join(label, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")).join(joined, "comp", "left")
    out = out.select("id", "n", F.coalesce("least", "comp").alias("comp"))
    if apart:  # components are named by the least number; the least id names them now
        out = out.join(out.groupBy("comp").agg(F.min("id").alias("least")), "comp").select("id", "n", F.col("least").alias("comp"))
    shown = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return out.select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("comp").alias("component_id"))
