"""Substring dedup: winnowed anchors seed matches of word windows, which are extended and removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textkit import mixed, ranges, runs, slices, span_hashes, tidy, word_hashes, words

#: An anchor held by so many slices of the input is hot: its windows are dealt out one by one.
HOT = 100
SLICE = 1 << 20
_NULL_ID = -(1 << 63)


def whole_groups(batches: Iterator[pa.RecordBatch], most: int = 20_000, enough: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first column; holds about so many rows or one group.

    With enough, a group of very many rows comes in several tables, each with at least so many of its rows.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held)
            key = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(key, key[-1]))
            if last == 0:  # the last group may go on and may have begun earlier
                if enough and batch.num_rows >= 2 * enough:
                    yield t.slice(0, rows - enough)
                    held, rows = [batch.slice(batch.num_rows - enough)], enough
                continue
            yield t.slice(0, rows - batch.num_rows + last)
            held, rows = [batch.slice(last)], batch.num_rows - last
    if rows:
        yield pa.Table.from_batches(held)


def numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def seeds(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor) of every window of each text, and the hash of the gram at each word.

    A window's anchor is the leftmost of its grams with the least hash, so equal windows have equal anchors at equal places.
    """
    width = window - gram + 1
    n = max(len(hashes) - gram + 1, 0)
    at = np.arange(n)
    grams = span_hashes(hashes, at, at + gram) if n else np.zeros(0, np.uint64)
    m = max(n - width + 1, 0)
    best, arg = grams[:m].copy(), np.arange(m)
    for d in range(1, width):
        less = grams[d : d + m] < best
        best[less] = grams[d : d + m][less]
        arg[less] = np.flatnonzero(less) + d
    starts = ranges(first[:-1], runs(np.diff(first), window))
    return starts, arg[starts], grams


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys[0] with the others as the order: is a row the first of its equals, has it equals, and which row is their first."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    again = np.zeros(len(k), dtype=bool)
    again[:-1] = ~new[1:]
    first, several, leader = np.empty_like(new), np.empty_like(new), np.empty(len(k), dtype=np.int64)
    first[order], several[order] = new, again | ~new
    leader[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else order
    return first, several, leader


def _anchors(window: int, gram: int):
    """Each slice's anchors. Of equal ones in a slice, the first alone takes part in the search for equals (key = hash); the others have them already and go elsewhere (key = a hash of their place), so no group has more rows than there are slices."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                hashes, first = word_hashes(part.column(1))
                _, anchor, grams = seeds(hashes, first, window, gram)
                anchor = anchor[np.flatnonzero(np.diff(anchor, prepend=-1))]
                doc = np.searchsorted(first, anchor, side="right") - 1
                h = grams[anchor]
                one, several, _ = _first_of(h, anchor)
                ids = numbers(part.column(0))[doc]
                pos = anchor - first[doc]
                key = np.where(one, h, mixed(h ^ mixed(ids.astype(np.uint64)) ^ pos.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.where(one, 0, h.view(np.int64))), pa.array(ids), pa.array(pos.astype(np.int32)), pa.array(several)], names=["key", "h", "doc", "pos", "sure"])

    return run


def _repeated(batches):
    """Anchors that occur again, and by how many slices they are held (0 where their slice knew it; at least HOT of a very common one, whose rows pass by)."""
    for t in whole_groups(batches, enough=max(HOT, 2)):
        key, h, doc, pos, sure = (numbers(c) for c in t.columns)
        new = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
        count = np.repeat(np.diff(new, append=len(key)), np.diff(new, append=len(key)))
        keep = sure | (count > 1)
        h = np.where(h == 0, key, h)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(doc[keep]), pa.array(pos[keep]), pa.array(np.where(count > 1, count, 0)[keep].astype(np.int64))], names=["h", "doc", "pos", "slices"])


def _windows(window: int, gram: int, salts: int):
    """For each repeated anchor, extended both ways, its run of windows: a row with their hashes, or for hot anchors a row for each.

    A run all of whose windows stand earlier in the same slice needs no search (length below 0); its source is known. Rows go
    by deal: the anchor's hash, of a hot window its own hash and one of so many salts.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                hashes, first = word_hashes(part.column(1))
                starts, anchor, grams = seeds(hashes, first, window, gram)
                ids, th = numbers(part.column(0)), numbers(part.column(2))
                marks = part.column(3)
                flat, cuts = numbers(marks.flatten()), np.concatenate([[0], np.cumsum(numbers(marks.value_lengths()))])
                at = flat // 2 + np.repeat(first[:-1], np.diff(cuts))
                inside = (at < np.repeat(first[1:], np.diff(cuts))) & (at < len(grams))
                state = np.zeros(len(hashes) + 1, dtype=np.int8)
                state[at[inside]] = 1 + flat[inside] % 2
                wanted = state[anchor] > 0
                starts, anchor = starts[wanted], anchor[wanted]
                if not len(starts):
                    continue
                w = span_hashes(hashes, starts, starts + window)
                hot = state[anchor] == 2
                # a run: windows with one anchor, in a row; a hot window is a run of its own
                new = np.flatnonzero(hot | (np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
                length = np.diff(new, append=len(starts))
                doc = np.searchsorted(first, starts[new], side="right") - 1
                whole = span_hashes(w, new, new + length)
                hot = hot[new]
                h = np.where(hot, w[new], grams[anchor[new]])
                pos = (starts[new] - first[doc]).astype(np.int32)
                one, _, leader = _first_of(whole ^ h, ids[doc], th[doc], pos)
                ends = np.cumsum(np.where(one, length, 0)) * 8
                data = w[np.repeat(one, length)].tobytes()
                body = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])
                place = mixed(ids[doc].astype(np.uint64)) ^ pos.astype(np.uint64)
                deal = np.where(one, np.where(hot, mixed(h ^ mixed(mixed(place) % np.uint64(salts) + np.uint64(1))), h), mixed(whole ^ place))
                columns = [deal.view(np.int64), h.view(np.int64), ids[doc], th[doc], pos, np.where(one, length, -length).astype(np.int32), hot, ids[doc][leader], pos - pos[leader]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), body], names=["deal", "key", "doc", "th", "pos", "n", "hot", "source", "shift", "hashes"])

    return run


def _later(batches):
    """Runs of windows that also start earlier: (doc, th, first window, last window, the earlier one's document, by how many words it stands before).

    A hot window that has no earlier one among its salt's rows comes with its hash (key) to be compared with those of other salts; key is null else.
    """
    for t in whole_groups(batches):
        t = t.combine_chunks()
        deal, key, doc, th, pos, n, hot, source, shift = (numbers(c) for c in t.columns[:9])
        length = np.abs(n)
        searched = np.repeat(n > 0, length)
        row = np.repeat(np.arange(len(n)), length)
        start = ranges(pos.astype(np.int64), length.astype(np.int64))
        gone = ~searched
        source, shift = source[row], shift[row].astype(np.int64)
        s = np.flatnonzero(searched)
        if len(s):
            column = t.column(9).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :]
            w = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)
            r = row[s]
            # windows are the same if their hashes and their anchors' hashes are; the first by (doc, th, start) stays
            order = np.lexsort((start[s], th[r], doc[r], w, key[r]))
            k, v = key[r][order], w[order]
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
            lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            gone[s[order]] = same
            source[s[order]] = doc[r][lead]
            shift[s[order]] = start[s[order]] - start[s[lead]]
        i = np.flatnonzero(gone)
        if len(i):
            new = np.flatnonzero((np.diff(row[i], prepend=-1) != 0) | (np.diff(start[i], prepend=-2) != 1) | (np.diff(source[i], prepend=0) != 0) | (np.diff(shift[i], prepend=0) != 0))
            last = np.append(new[1:], len(i)) - 1
            r = row[i[new]]
            yield _found(doc[r], th[r], start[i[new]], start[i[last]], source[i[new]], shift[i[new]], pa.nulls(len(new), pa.int64()))
        i = np.flatnonzero(~gone & hot[row])
        if len(i):
            r = row[i]
            yield _found(doc[r], th[r], start[i], start[i], doc[r], np.zeros(len(i)), pa.array(key[r]))


def _found(doc, th, a, b, source, shift, key) -> pa.RecordBatch:
    columns = [doc, th, a.astype(np.int32), b.astype(np.int32), source, shift.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), key], names=["doc", "th", "a", "b", "source", "shift", "key"])


def _repeats(found: pa.StructScalar, window: int) -> tuple[np.ndarray, ...]:
    """(first word, words, source, shift) of the maximal repeats that runs of windows make up: those with one source and shift that touch or overlap are one."""
    a, b, source, shift = (numbers(found.field(i)).astype(np.int64) for i in range(4))
    order = np.lexsort((a, shift, source))
    a, b, source, shift = (x[order] for x in (a, b, source, shift))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > b[:-1] + 1)
    at = np.flatnonzero(new)
    return a[at], np.maximum.reduceat(b, at) + window - a[at], source[at], shift[at]


def _cut(window: int, text_at: int, names: list[str]):
    """Each text without the words that its repeats cover, and the repeats. Texts without repeats stay as they are."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_first", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_at, SLICE):
                buf, starts, ends, first = words(part.column(text_at))
                data = buf.tobytes()
                found = part.column(part.num_columns - 1)
                kept, removed, repeats = [], [], []
                for d in range(part.num_rows):
                    own = found[d].values
                    if own is None or not len(own):
                        kept.append(None)
                        removed.append(0)
                        repeats.append([])
                        continue
                    n = int(first[d + 1] - first[d])
                    at, length, source, shift = _repeats(own, window)
                    step = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, np.minimum(at + length, n), -1)
                    stay = np.flatnonzero(np.cumsum(step[:n]) == 0) + first[d]
                    kept.append(b" ".join([data[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode())
                    removed.append(n - len(stay))
                    repeats.append([dict(zip(("first", "words", "source", "source_first"), r, strict=True)) for r in sorted(zip(at.tolist(), length.tolist(), (None if x == _NULL_ID else x for x in source.tolist()), (at - shift).tolist(), strict=True), key=lambda r: r[:2])])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(repeats, kind)], names=names)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, gram: int = 8, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text, th, n_words, n_removed, kept, repeats, and the columns in also (under their names).

    A window is so many consecutive words of one document; its copies after the first (smaller id, then
    smaller text hash, then earlier start) lose all their words. kept: the other words joined by one
    space; null if nothing was removed, "" if everything was. repeats: what was removed, as maximal repeats of at least so many
    words (first word, words, the source's id and first word there). Null and empty texts have no words. Rows with
    the same id and text are one document, judged alike. ids are integers; null comes first (-2^63 stands for it).

    1. Every window has an anchor, its gram with the least hash; anchors that occur once are dropped.
    2. The texts of the others' documents are joined to them, and each anchor, a seed, is extended both ways over the
       windows that it stands for: a row of window hashes, dealt by anchor. Windows are compared by their
       own and their anchor's 64-bit hashes; each match names the earliest one as its source.
    3. Matches of neighbouring seeds on one diagonal (same source, same shift) make up maximal repeats, which are cut out.
    Equal anchors and runs within a slice of the input are settled in the slice, so a passage in a third of
    all documents makes one row for each slice; these rows are counted as they pass. Windows around such an anchor are dealt
    by their own hash and a salt, and the first ones of the salts are compared in a second step.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc")
    texts = docs.select(own, F.col(text_col).alias("text")).where("text is not null")
    # marks find back to their text by 32 bits of id and text, so an id of many texts is no hot key; marks of another text with the same bits add windows to compare, no repeats
    mark = (F.xxhash64("doc", "text").bitwiseAND(F.lit((1 << 32) - 1))).alias("mark")
    found = texts.select(mark, "text").mapInArrow(tidy(_anchors(window, gram)), "key long, h long, doc long, pos int, sure boolean")
    found = found.repartition("key").sortWithinPartitions("key")
    again = written(found.mapInArrow(tidy(_repeated), "h long, doc long, pos int, slices long"), "anchors")
    hot = written(again.where(F.col("slices") >= HOT).select("h").distinct().withColumn("_hot", F.lit(1)), "hot")
    some_hot = not hot.isEmpty()
    again = again.join(hot, "h", "left").groupBy(F.col("doc").alias("mark")).agg(F.collect_list(F.col("pos") * 2 + F.coalesce("_hot", F.lit(0))).alias("marks"))
    seeded = texts.select("doc", "text", mark).join(again, "mark").select("doc", "text", F.xxhash64("text").alias("th"), "marks")
    salts = max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = seeded.mapInArrow(tidy(_windows(window, gram, salts)), "deal long, key long, doc long, th long, pos int, n int, hot boolean, source long, shift int, hashes binary")
    later = found.repartition("deal").sortWithinPartitions("deal").mapInArrow(tidy(_later), "doc long, th long, a int, b int, source long, shift int, key long")
    if some_hot:
        later = written(later, "later")
        same = Window.partitionBy("key").orderBy("doc", "th", "a")  # a row for each salt at most
        firsts = later.where("key is not null").withColumn("at", F.row_number().over(same)).withColumn("first", F.first(F.struct("doc", "a")).over(same))
        firsts = firsts.where("at > 1").select("doc", "th", "a", "b", F.col("first.doc").alias("source"), (F.col("a") - F.col("first.a")).alias("shift"))
        later = later.where("key is null").drop("key").unionByName(firsts)
    later = later.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b", "source", "shift")).alias("found"))
    later = later.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "found")
    rows = docs.select(own, F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"), *[F.col(c).alias(f"also_{i}") for i, c in enumerate(also)])
    rows = rows.join(later, (rows["doc"] == later["_doc"]) & (rows["th"] == later["_th"]), "left").drop("_doc", "_th")
    names = [*rows.columns[:-1], "n_words", "n_removed", "kept", "repeats"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_words long, n_removed long, kept string, repeats array<struct<first:int,words:int,source:long,source_first:int>>"])
    out = rows.mapInArrow(tidy(_cut(window, 1, names)), schema)
    return out.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "text", "th", "n_words", "n_removed", "kept", "repeats", *[F.col(f"also_{i}").alias(c) for i, c in enumerate(also)])
