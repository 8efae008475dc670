"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .textkit import raw, slices, tidy

#: Features: byte n-grams of these lengths, hashed.
GRAMS, SIZE = (1, 2, 3, 4), 1 << 13
#: Bytes and rows that are counted at once.
PART, ROWS = 1 << 19, 64
#: A language's centroids, how many of its documents (by hash of the id) k-means starts from, and in how many rounds over all documents it goes on (each makes the centroids means of all).
CLUSTERS, SAMPLE, ROUNDS = 4, 512, 1
#: The most languages that are broadcast.
BROADCAST = 100_000
#: A document is rejected below this share of the similarity that all but this part of its language's documents of its length have.
REJECT, PART_BELOW = 0.7, 0.01
#: Lengths are told apart by powers of two up to this one; similarities are counted in steps of one over STEPS, coordinates summed in units of one over UNIT.
BINS, STEPS, UNIT = 24, 10_000, 1 << 30
UNKNOWN = "und"
_KEEP = np.full(256, 32, dtype=np.uint64)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_DAMPED = np.log1p(np.arange(1 << 12)).astype(np.float32)
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)


def _grams(column: pa.Array, ends: bool = True):
    """(text, feature, first byte behind it) of every n-gram that counts, a length at a time, and (texts' lower-cased bytes, where each begins). Lower-cased; whatever is neither a-z nor beyond ASCII is a space; n-grams of spaces alone don't count."""
    buf, offsets = raw(pc.utf8_lower(column.fill_null("")))
    b = _KEEP[buf]
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(b))  # bytes from here to the text's end
    h, ink = np.zeros(len(b), dtype=np.uint64), np.zeros(len(b), dtype=bool)
    found = []
    for k in range(max(GRAMS)):
        m = len(b) - k
        if m <= 0:
            break
        h, ink = h[:m] + b[k:] * _FACTORS[k], ink[:m] | (b[k:] != 32)
        if k + 1 in GRAMS:
            ok = ink & (left[:m] > k)
            found.append((doc[:m][ok], ((h[ok] * _FACTORS[4]) >> np.uint64(64 - 13)).astype(np.int64), np.flatnonzero(ok) + k + 1 if ends else None))
    return found, buf, offsets


def counts(column: pa.Array) -> np.ndarray:
    """Texts x features: how often each n-gram occurs."""
    n = len(column)
    out = np.zeros(n * SIZE, dtype=np.int64)
    for doc, feature, _ in _grams(column, ends=False)[0]:
        out += np.bincount(doc * SIZE + feature, minlength=n * SIZE)
    return out.reshape(n, SIZE)


def _unit(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of damped counts times idf."""
    damped = _DAMPED[np.minimum(counted, len(_DAMPED) - 1)]
    if len(counted) and counted.max() >= len(_DAMPED):
        damped = np.log1p(counted).astype(np.float32)
    v = damped * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of damped counts times idf."""
    return _unit(counts(column), idf)


def _starts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each character begins, the first character of each text and the number of all)."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    return at, np.searchsorted(at, offsets)


def cut_similarities(column: pa.Array, idf: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin of length, cosine with the nearest of the centroids c) of every text whole and cut to every power of two of characters from 4 on.

    The n-grams are found once for all cuts of a text: each occurrence adds what it changes in the products and the norm to the first cut that holds it.
    """
    found, buf, offsets = _grams(column)
    chars = np.cumsum((buf & 0xC0) != 0x80)  # of all texts up to each byte
    before = np.concatenate([[0], chars])[offsets[:-1]]
    size = np.diff(_starts(buf, offsets)[1])
    # a text has the cuts to 4, 8, ... up to the first that is the whole text
    last = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64).clip(None, BINS - 1) - 2
    n, most = len(size), BINS - 2
    doc, feature, end = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    held = chars[end - 1] - before[doc]  # characters up to its end
    level = np.searchsorted(1 << np.arange(2, BINS), np.arange(1, held.max(initial=0) + 1))[held - 1]  # the first cut that holds so many
    inside = level < most
    doc, feature, level = doc[inside], feature[inside], level[inside]
    # sorted by text, feature and cut
    key = np.sort((doc * SIZE + feature) * 32 + level)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(key))[: len(first)]
    level, both = key[first] & 31, key[first] >> 5
    doc, feature = both >> 13, both & (SIZE - 1)
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    begin = first[np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))]  # where the n-gram of the text begins
    table = np.log1p(np.arange(len(key) + 1))
    damped, more = table[first - begin], table[end - begin]
    place, weight = doc * most + level, idf[feature].astype(float)
    added = lambda w: np.cumsum(np.bincount(place, weights=w, minlength=n * most).reshape(n, most), axis=1)
    norm = np.sqrt(added((more**2 - damped**2) * weight**2))
    step = (more - damped) * weight
    near = np.max([added(step * one[feature]) for one in c], axis=0) / np.maximum(norm, 1e-12)
    own, k = np.nonzero(np.arange(most)[None, :] <= last[:, None])
    plain, at = raw(column)
    first, text = _starts(plain, at)
    ends = np.concatenate([first, [len(plain)]])[np.minimum(text[own] + (1 << (k + 2)), text[own + 1])]
    return own, _bin(ends - at[own]), near[own, k]


def cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids of unit vectors (fewer if there are fewer): spherical k-means from spread-out starts."""
    picked = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argmin((v @ v[picked].T).max(axis=1))))
    c = v[picked]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _bin(size: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(size, 1)).astype(np.int64), 0, BINS - 1)


def bins(texts: pa.Array) -> np.ndarray:
    """The power of two below the number of bytes."""
    return _bin(np.diff(raw(texts)[1]))


def floors(found: pd.DataFrame) -> np.ndarray:
    """For each length the similarity below which a document of a language is rejected; a length of few documents takes that of the one below (the shortest: none). found: bin, n, low (the quantile)."""
    out, at = np.zeros(BINS), found.set_index("bin")
    for b in range(BINS):
        out[b] = REJECT * at["low"][b] if b in at.index and at["n"][b] >= 16 else out[max(b - 1, 0)]
    return out


@dataclass
class Model:
    """Centroids with their languages, the least similarity that isn't rejected for each length (a row a centroid), and the idf of all features."""

    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray


def _frequencies(batches):
    """A task's number of documents (feature -1) and of those that hold each feature."""
    held, n = np.zeros(SIZE, dtype=np.int64), 0
    for batch in batches:
        for big in slices(batch, 0, PART):
            for part in _rows(big.column(0)):
                held += (counts(part) > 0).sum(axis=0)
                n += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE)), pa.array(np.concatenate([[n], held]))], names=["feature", "n"])


def _of(languages: list[str], starts: dict[str, tuple[int, int]], batch: pa.RecordBatch, part: pa.Array, first: int):
    """(language, (first and last centroid), rows of part that are of it) for the languages of a part of a batch that begins at row first."""
    own = np.array(batch.column(1).slice(first, len(part)).to_pylist(), dtype=object)
    for lang in sorted(set(own) & set(languages)):
        yield lang, starts[lang], np.flatnonzero(own == lang)


def _sums(languages: list[str], starts: dict[str, tuple[int, int]], c: np.ndarray, idf: np.ndarray):
    """A task's sums of the unit vectors next to each centroid of their language, in whole units, so that they don't depend on the order of adding."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            first = 0
            for big in slices(batch, 0, PART):
                for part in _rows(big.column(0)):
                    v = vectors(part, idf)
                    for _, (a, b), at in _of(languages, starts, batch, part, first):
                        near = (v[at] @ c[a:b].T).argmax(axis=1)
                        for k in np.unique(near).tolist():
                            sums[a + k] = sums.get(a + k, 0) + np.rint(v[at[near == k]].astype(float) * UNIT).astype(np.int64).sum(axis=0)
                    first += len(part)
        for k, s in sorted(sums.items()):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(s[at])], names=["centroid", "feature", "s"])

    return run


def _similarities(languages: list[str], starts: dict[str, tuple[int, int]], c: np.ndarray, idf: np.ndarray):
    """A task's counts of how near its documents, whole and cut to all lengths, are to their language's centroids: language, bin of length, steps, n."""

    def run(batches):
        met: dict[int, np.ndarray] = {}  # of each language met, its counts by length and steps
        for batch in batches:
            first = 0
            for big in slices(batch, 0, PART):
                for part in _rows(big.column(0)):
                    for lang, (a, b), at in _of(languages, starts, batch, part, first):
                        k = languages.index(lang)
                        _, length, near = cut_similarities(part.take(pa.array(at)), idf, c[a:b])
                        steps = np.clip(near * STEPS, 0, STEPS).astype(np.int64)
                        met[k] = met.get(k, 0) + np.bincount(length * (STEPS + 1) + steps, minlength=BINS * (STEPS + 1))
                    first += len(part)
        for k, n in sorted(met.items()):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at // (STEPS + 1)), pa.array(at % (STEPS + 1)), pa.array(n[at])], names=["lang", "bin", "steps", "n"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, clusters: int = CLUSTERS, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learns from all rows with a language and a text with letters.

    idf comes from all of them. Spherical k-means starts from centroids of at most sample documents a language, those with the least hash of id and text,
    made in one task a language; then it goes on over all documents, rounds times, so that the centroids are means of all. All documents, whole and cut to all lengths,
    tell how near its centroids a language's texts of each length are. Only sums and counts come to the driver (clusters x SIZE numbers a
    language and BINS a language). No usable rows: a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = rows.select("text").mapInArrow(tidy(_frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    n = found.set_index("feature")["n"].reindex(range(-1, SIZE), fill_value=0).to_numpy()
    idf = (np.log((1 + n[0]) / (1 + n[1:])) + 1).astype(np.float32)

    draw = F.xxhash64(F.coalesce(F.col("doc").cast("string"), F.lit("")), F.col("text"))
    least = Window.partitionBy("lang").orderBy("draw")
    share = written(rows.groupBy("lang").agg((4.0 * sample / F.count("*")).alias("share")), "shares")
    if share.count() <= BROADCAST:
        share = F.broadcast(share)
    even = (F.col("draw").cast("double") + 2.0**63) / 2.0**64
    some = rows.select("lang", draw.alias("draw")).join(share, "lang").where(even <= F.col("share"))  # about four times as many as needed
    chosen = some.withColumn("at", F.row_number().over(least)).where(F.col("at") <= sample)
    chosen = written(chosen.select("lang", "draw").distinct(), "chosen")  # at most sample rows a language
    texts = rows.select("lang", draw.alias("draw"), "text").join(chosen, ["lang", "draw"]).dropDuplicates(["lang", "draw"])

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(pdf.sort_values("draw")["text"].to_list(), pa.string())
        v = np.concatenate([vectors(part, idf) for part in _rows(texts)])
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(cluster(v, clusters))})

    got = texts.groupBy("lang").applyInPandas(start, "lang string, centroid array<float>").toPandas()
    got = got.sort_values("lang", kind="stable")
    if not len(got):
        return Model([], np.zeros((0, SIZE), np.float32), np.zeros((0, BINS)), idf)
    c = np.stack(got["centroid"].to_list()).astype(np.float32)
    owner = got["lang"].to_list()
    languages = sorted(set(owner))
    starts = {lang: (owner.index(lang), owner.index(lang) + owner.count(lang)) for lang in languages}
    known = rows.select("text", "lang")
    for _ in range(rounds):
        sums = known.mapInArrow(tidy(_sums(languages, starts, c, idf)), "centroid long, feature long, s long").groupBy("centroid", "feature").agg(F.sum("s").alias("s")).toPandas()
        new = np.zeros(c.shape)
        new[sums["centroid"], sums["feature"]] = sums["s"]
        size = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(size > 0, new / np.maximum(size, 1), c).astype(np.float32)
    near = known.mapInArrow(tidy(_similarities(languages, starts, c, idf)), "lang long, bin long, steps long, n long").groupBy("lang", "bin", "steps").agg(F.sum("n").alias("n"))
    low = near.groupBy("lang", "bin").agg(F.sum("n").alias("n"), (F.percentile("steps", PART_BELOW, F.col("n")) / STEPS).alias("low")).toPandas()
    bound = {lang: floors(low[low["lang"] == k]) for k, lang in enumerate(languages)}
    return Model(owner, c, np.stack([bound[lang] for lang in owner]), idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column: lang, score, rejected.

    lang is that of the nearest centroid by cosine (ties: the first by name), score that cosine, in 0 to 1.
    Null texts and those without letters: und, 0, rejected. Others are rejected if they lie farther from
    their nearest centroid than its language's texts of their length do. Without languages everything is und, and only texts without letters are rejected.
    """

    at = docs.columns.index(text_col)
    kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kinds)])

    def run(batches):
        for batch in batches:
            found = [_guess(part, model) for big in slices(batch, at, PART) for part in _rows(big.column(at))]
            lang, score, low = ([x for f in found for x in f[k]] for k in range(3))
            guess = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], names=kinds.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, guess], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def _rows(texts: pa.Array):
    for k in range(0, len(texts), ROWS):
        yield texts.slice(k, ROWS)


def _guess(texts: pa.Array, model: Model) -> tuple[list[str], list[float], list[bool]]:
    n = len(texts)
    blank = np.array([x is None or not any(map(str.isalpha, x)) for x in texts.to_pylist()], dtype=bool)
    if not model.languages:
        return [UNKNOWN] * n, [0.0] * n, blank.tolist()
    near = vectors(texts, model.idf) @ model.centroids.T
    best = near.argmax(axis=1)
    value = np.clip(near[np.arange(n), best].astype(float), 0, 1)
    lang = [UNKNOWN if b else model.languages[i] for i, b in zip(best, blank, strict=True)]
    return lang, np.where(blank, 0.0, value).tolist(), (blank | (value < model.floors[best, bins(texts)])).tolist()


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
