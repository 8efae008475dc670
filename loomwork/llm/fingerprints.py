"""Improbable-feature digests: rare byte windows of a document in a chain of Bloom filters."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substrings import numbers
from .textkit import byte_hashes, mixed, ranges, raw, slices, tidy

#: For each scale: bytes of a window, windows among which the rarest is sought, how often one must be it to be a feature, and the texts that have such features (bytes from, and below).
SCALES = ((64, 64, 16, 512, 1 << 62), (16, 8, 3, 0, 1024))
#: Bits of a filter, bits set for a feature, features of a filter.
BITS, SET, FEATURES = 2048, 5, 160
#: Entropies are told apart in this many steps.
STEPS = 768
#: Buckets of neighbouring ids for every shuffle partition, from which ranges of even bytes are made.
BUCKETS = 8
_SCALE = 1 << 10
_COST = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, 65)], dtype=np.int64)
_GAIN = np.diff(_COST)


def steps(b: np.ndarray, window: int) -> np.ndarray:
    """The entropy step of the window at each byte: the sum of c * log2(c) over its byte counts c falls as the entropy rises.

    The sum changes from one window to the next by what the entering and the leaving byte add, which follows
    from how often each occurs among the window - 1 bytes before and after it; all sums are of integers.
    """
    n = len(b)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for d in range(1, window):
        same = (b[d:] == b[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    total = np.empty(n - window + 1, dtype=np.int64)
    total[0] = _COST[np.bincount(b[:window], minlength=256)].sum()
    total[1:] = _GAIN[before[window:]] - _GAIN[after[:-window]]
    return np.cumsum(total) * STEPS // (_COST[window] + 1)


def _of_scale(b: np.ndarray, offsets: np.ndarray, scale: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts that have features of a scale, where each of these begins, its number, and where windows lie within one text."""
    window, _, _, least, below = scale
    size = np.diff(offsets)
    own = np.flatnonzero((size >= max(least, window)) & (size < below))
    if len(own) < len(size):
        b = b[ranges(offsets[own], size[own])]
    first = np.cumsum(size[own]) - size[own]
    return b, first, own, ranges(first, size[own] - window + 1)


def _histogram(batches):
    count = np.zeros((len(SCALES), STEPS), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, 0):
            for k, scale in enumerate(SCALES):
                b, _, _, inside = _of_scale(*raw(part.column(0)), scale)
                count[k] += np.bincount(steps(b, scale[0])[inside], minlength=STEPS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(count.size)), pa.array(count.ravel())], names=["step", "n"])


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """For each scale the rank of every entropy step, the rarest among all its windows of all documents first; ties: the lower entropy first."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(_histogram), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas()
    n = found.set_index("step")["n"].reindex(range(len(SCALES) * STEPS), fill_value=0).to_numpy().reshape(-1, STEPS)
    rank = np.empty_like(n, dtype=np.int64)
    for own, counted in zip(rank, n, strict=True):
        own[np.lexsort((-np.arange(STEPS), counted))] = np.arange(STEPS)
    return rank


def _features(b: np.ndarray, offsets: np.ndarray, scale: tuple[int, ...], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the features of one scale."""
    window, area, popular, *_ = scale
    b, first, own, inside = _of_scale(b, offsets, scale)
    worth = np.full(len(b) + area, np.iinfo(np.int64).max)
    if len(inside):
        worth[inside] = (rank[steps(b, window)[inside]] << 32) | inside
    width = 1
    while width < area:  # the least of width windows becomes that of twice as many
        worth = np.minimum(worth[:-width], worth[width:])
        width *= 2
    noted = worth[inside] & 0xFFFFFFFF
    new = np.flatnonzero(np.diff(noted, prepend=-1))
    at = noted[new[np.diff(new, append=len(noted)) >= popular]]
    grid = b[at[:, None] + np.arange(window)].view(np.uint64) if len(at) else np.zeros((0, window // 8), np.uint64)
    h = np.full(len(at), window, dtype=np.uint64)
    for k in range(grid.shape[1]):
        h = mixed(h ^ grid[:, k]) + np.uint64(k)
    k = np.searchsorted(first, at, side="right") - 1
    return h, own[k], offsets[own[k]] + at - first[k]


def digests(column: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filters of all texts in a row, each BITS / 64 numbers; first filter of each text and the number of all).

    Of each area of windows in a row the rarest (the leftmost of equals) is noted; windows noted often enough
    are features, each once. Short texts have features of the small scale, long ones of the large one, those between of both.
    A text without features has one: its hash. Every FEATURES of them begin a filter.
    """
    b, offsets = raw(column)
    texts = len(offsets) - 1
    h, doc, at = (np.concatenate(x) for x in zip(*(_features(b, offsets, scale, r) for scale, r in zip(SCALES, rank, strict=True)), strict=True))
    plain = np.setdiff1d(np.arange(texts), doc)
    h = np.concatenate([h, byte_hashes(b, offsets[plain], offsets[plain + 1])])
    doc, at = np.concatenate([doc, plain]), np.concatenate([at, offsets[plain]])
    order = np.lexsort((at, h, doc))
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    keep = order[first]
    keep = keep[np.lexsort((h[keep], at[keep], doc[keep]))]
    h, doc = h[keep], doc[keep]
    begin = np.searchsorted(doc, np.arange(texts + 1))
    chain = np.concatenate([[0], np.cumsum(-(-np.diff(begin) // FEATURES))])
    where = (chain[doc] + (np.arange(len(doc)) - begin[doc]) // FEATURES) * BITS
    bits = np.zeros(int(chain[-1]) * BITS, dtype=bool)
    for k in range(SET):
        bits[where + ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64).reshape(-1, BITS // 64), chain


#: Pairs of filters that are compared at once.
PAIRS = 1 << 16


def likeness(a: np.ndarray, chain_a: np.ndarray, b: np.ndarray, chain_b: np.ndarray) -> np.ndarray:
    """For the texts of two digests, one to one: 0 to 1. Every filter of the shorter chain takes its best match in the other; the mean counts.

    A match is the number of common bits beyond what chance gives, by the most there could be. Memory is bounded by PAIRS and one number a filter, whatever the texts' lengths.
    """
    na, nb = np.diff(chain_a), np.diff(chain_b)
    ends = np.cumsum(na * nb)
    short = np.minimum(na, nb)
    start = np.concatenate([[0], np.cumsum(short)])
    best = np.zeros(start[-1])
    of_a, of_b = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (a, b))
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
        text = np.searchsorted(ends, pair, side="right")
        k = pair - (ends - na * nb)[text]
        i, j = k // nb[text], k % nb[text]
        at_a, at_b = chain_a[:-1][text] + i, chain_b[:-1][text] + j
        x, y = a[at_a], b[at_b]
        both = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
        chance = of_a[at_a] * of_b[at_b] / BITS
        room = np.minimum(of_a[at_a], of_b[at_b]) - chance
        match = np.where(room > 0, np.clip((both - chance) / np.where(room > 0, room, 1), 0, 1), (x == y).all(axis=1))
        np.maximum.at(best, start[text] + np.where(na[text] <= nb[text], i, j), match)  # row: the filter of the shorter chain
    return np.add.reduceat(best, start[:-1]) / short if len(short) else np.zeros(0)


def strings(filters: np.ndarray, chain: np.ndarray) -> list[str]:
    return [base64.b64encode(filters[a:b].tobytes()).decode() for a, b in zip(chain[:-1], chain[1:], strict=True)]


def digest(docs: DataFrame, rank: np.ndarray, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text (null: empty): base64 of its filters."""

    def run(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        return pd.Series([s for part in slices(batch, 0) for s in strings(*digests(part.column(0), rank))], dtype=object)

    return docs.withColumn(into, F.pandas_udf(run, "string")(F.col(text_col)))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, text, last) dealt and sorted so that the row after each of a partition is the next document by descending id, and the first after the last.

    Ids are dealt in one range for each shuffle partition, of even bytes as far as ids allow (rows of one id, and null is one, stay
    together), made of buckets between quantiles; the first document of each range is also sent after the end of
    the range before it, marked last, which has no turn of its own there. Only the buckets' bounds, first ids and
    bytes reach the driver (BUCKETS for every shuffle partition). Of rows with one id, those with the lesser text
    hash come first. Null ids come after all others (-2^63 is taken for null).
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(own.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = BUCKETS * parts
    cuts = rows.agg(F.percentile_approx("doc", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))[::-1]
    bucket = lambda d: len(bounds) - np.searchsorted(bounds[::-1], d, side="left")

    number = F.pandas_udf(lambda doc: pd.Series(bucket(doc.to_numpy())), "long")
    sizes = rows.select(number("doc").alias("b"), "doc", (F.octet_length("text") + 100).cast("long").alias("bytes"))
    found = sorted((r[0], r[1], r[2]) for r in sizes.groupBy("b").agg(F.max("doc"), F.sum("bytes")).collect())
    before = np.cumsum([0] + [r[2] for r in found])
    ranges_ = np.zeros(len(bounds) + 1, dtype=np.int64)  # the range of each bucket: by the bytes up to its middle
    heads: list[tuple[int, int]] = []  # first id and number of each range
    for (b, first, size), start in zip(found, before, strict=False):
        ranges_[b] = (2 * start + size) * parts // (2 * before[-1])
        if not heads or heads[-1][1] != ranges_[b]:
            heads.append((first, int(ranges_[b])))
    # each range's first one goes to the end of the range before, that of the first to the end of the last
    sent = sorted((h[0], heads[k - 1][1]) for k, h in enumerate(heads))
    firsts, ends = (np.array([x[i] for x in sent], dtype=np.int64) for i in (0, 1))

    def places(doc: pd.Series) -> pd.Series:
        d = doc.to_numpy()
        r = ranges_[bucket(d)]
        k = np.minimum(np.searchsorted(firsts, d), len(firsts) - 1)
        return pd.Series([[x] if h != y else [x, -1 - e] for x, y, h, e in zip(r.tolist(), d.tolist(), firsts[k].tolist(), ends[k].tolist(), strict=True)])

    at = F.explode(F.pandas_udf(places, "array<long>")("doc"))
    rows = rows.withColumn("_at", at).select(F.when(F.col("_at") < 0, -1 - F.col("_at")).otherwise(F.col("_at")).alias("range"), (F.col("_at") < 0).alias("last"), "doc", "text")
    return rows.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "last", F.desc("doc"), F.xxhash64("text"), "text")


COLUMNS = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_next(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited (its text whose last half is replaced by the beginning of the next document's), both fingerprints, and the likeness of its own to the edited text's and to the next document's.

    Null texts are empty. A single document is its own next. Rows with one id each have their turn. No documents: no rows.
    """

    def run(batches):
        held = None
        for batch in batches:
            held = pa.concat_batches([held, batch]) if held is not None else batch
            for k, part in _overlapping(held):
                if k:
                    yield _compared(part, rank)
            held = held.slice(held.num_rows - 1)
        # the row that is left is always marked last

    return beside_next(docs, id_col, text_col).mapInArrow(tidy(run), COLUMNS)


def _overlapping(batch: pa.RecordBatch):
    """Parts of bounded size, each with the row after it."""
    first = 0
    if batch.num_rows < 2:
        return
    for part in slices(batch.slice(0, batch.num_rows - 1), 3):
        yield part.num_rows, batch.slice(first, part.num_rows + 1)
        first += part.num_rows


def _compared(part: pa.RecordBatch, rank: np.ndarray) -> pa.RecordBatch:
    texts = part.column(3).to_pylist()
    n = len(texts) - 1
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
    own, chain = digests(part.column(3), rank)
    other, chain2 = digests(pa.array(edited, pa.string()), rank)
    turn = np.flatnonzero(~numbers(part.column(1))[:n])
    near = likeness(own, chain[:-1], other, chain2)
    after = likeness(own, chain[:-1], own, chain[1:])
    shown, shown2 = strings(own, chain), strings(other, chain2)
    ids = [None if d == -(1 << 63) else d for d in part.column(2).to_pylist()]
    pick = lambda values: [values[i] for i in turn.tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array(pick(ids), pa.int64()), pa.array([len(t) for t in pick(texts)], pa.int64()), pa.array(pick(edited), pa.string()), pa.array(pick(shown), pa.string()), pa.array(pick(shown2), pa.string()), pa.array(near[turn]), pa.array(after[turn])],
        names=[c.split()[0] for c in COLUMNS.split(", ")],
    )


