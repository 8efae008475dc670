"""Ranked lexical search with variable block-max indexes.

index() makes shards of documents with all their postings; search() joins the postings of the queries' terms and answers each
block of queries in each shard. There, dynamic programming cuts every posting list into blocks so that the bounds' total error and the number of
blocks together are least; a query then takes the stretches of documents between block borders by their bound and stops at the first that can't reach
its k-th score: the same pivot test as WAND's, made for all stretches at once. Results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .textkit import byte_hashes, ranges, raw, slices, spans, tidy

#: A shard ends with the document that brings it to so many terms, or documents.
SHARD_TERMS, SHARD_DOCS = 1 << 22, 1 << 16
#: Queries that are answered together in a shard.
QUERIES = 1024
#: Cells of a list, between which blocks may end, and cells of a block at most.
CELLS, LONGEST = 1024, 64
#: What a block costs in bound error: the list's greatest score at so many documents.
BLOCK_COST = 32
#: ASCII letters and digits and all bytes of other characters make terms.
OTHERS = np.ones(256, dtype=bool)
OTHERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POSTINGS = "shard long, term long, n long, docs binary, counts binary"


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term of all texts in a row, first term of each text and the number of all)."""
    buf, offsets = raw(column)
    buf = LOWER[buf]
    starts, ends = spans(buf, offsets, OTHERS)
    return byte_hashes(buf, starts, ends).view(np.int64), np.searchsorted(starts, offsets)


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Shards of documents: for each a row of term null (n: all terms with repeats; docs: ids and whether they are null; counts: each document's terms), and a row per term (n: documents that hold it; docs: their
    places in the shard; counts: the term's occurrences in each). Terms are 64-bit hashes.

    A shard is a run of the rows that a task reads, so nothing is shuffled. Null and empty texts, and those without terms, are in no shard.
    Rows of one id are documents of their own; ids are integers or null. Very long texts are one document of a shard of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def shard(key: int, ids: list, lengths: list, found: list[np.ndarray]) -> pa.RecordBatch:
        n = np.concatenate(lengths)
        every = np.concatenate(found)
        known = np.sort(every)
        known = known[np.flatnonzero(np.diff(known, prepend=known[0] - 1 if known[0] > np.iinfo(np.int64).min else known[0] + 1))]
        at = np.searchsorted(known, every) * np.int64(len(n)) + np.repeat(np.arange(len(n)), n)
        at.sort()
        first = np.flatnonzero(np.diff(at, prepend=-1))
        counts = np.diff(np.append(first, len(at))).astype("<u4")
        term, doc = np.divmod(at[first], len(n))
        cut = np.append(np.searchsorted(term, np.arange(len(known))), len(term))
        doc = doc.astype("<u4")
        offsets = pa.py_buffer((cut * 4).astype(np.int32).tobytes())
        lists = [pa.Array.from_buffers(pa.binary(), len(known), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (doc, counts)]
        ids = pa.concat_arrays(ids)
        own = np.array(ids.fill_null(0)).astype("<i8").tobytes() + np.array(ids.is_null()).astype("u1").tobytes()
        head = [pa.array([own], pa.binary()), pa.array([n.astype("<u4").tobytes()], pa.binary())]
        columns = [pa.array(np.full(len(known) + 1, key)), pa.concat_arrays([pa.array([None], pa.int64()), pa.array(known)]), pa.array(np.append(len(every), np.diff(cut)).astype(np.int64)), *(pa.concat_arrays([h, x]) for h, x in zip(head, lists, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "n", "docs", "counts"])

    def run(batches):
        key = TaskContext.get().partitionId() << 24
        ids, lengths, found, size, held = [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, 1, rows=min(4096, shard_docs)):
                hashes, first = terms(part.column(1))
                n = np.diff(first)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                if size and (size + len(hashes) > shard_terms or held + len(some) > shard_docs):
                    yield shard(key, ids, lengths, found)
                    key, ids, lengths, found, size, held = key + 1, [], [], [], 0, 0
                ids.append(part.column(0).take(pa.array(some)))
                lengths.append(n[some])
                found.append(hashes)
                size, held = size + len(hashes), held + len(some)
        if size:
            yield shard(key, ids, lengths, found)

    return rows.mapInArrow(tidy(run), POSTINGS)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (query, term). Rows that share an id are one query; a null id is one of its own."""
    rows = queries.select(F.col(id_col).cast("long").alias("query"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                hashes, first = terms(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(first)))), pa.array(hashes)], names=["query", "term"])

    return rows.mapInArrow(tidy(run), "query long, term long").distinct()


def cell_size(n: np.ndarray) -> np.ndarray:
    """Postings of a cell of lists of n postings: one, until a list has CELLS."""
    return -(-n // CELLS)


def cuts(scores: np.ndarray, docs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where blocks of posting lists start: first[k]:first[k + 1] of scores and docs is list k; the result also ends with the number of all.

    A block bounds every document from its first to its last, those without the term too, so its error is its greatest score times those documents, less its scores. Of all
    ways to cut a list between cells, with blocks of at most LONGEST cells, this is the one with the least sum of errors plus BLOCK_COST times the list's greatest score for every
    block. Lists of similar lengths are solved together.
    """
    n = np.diff(first)
    each = np.maximum(cell_size(n), 1)
    cells = -(-n // each)
    out = [first]
    for size in range(2, int(cells.max(initial=0)).bit_length() + 1):
        mine = np.flatnonzero((cells >= 1 << (size - 1)) & (cells < 1 << size))
        step = max(1, (1 << 20) >> size)
        for some in (mine[a : a + step] for a in range(0, len(mine), step)):
            width = int(cells[some].max())
            row = np.repeat(np.arange(len(some)), cells[some])
            cell = ranges(np.zeros(len(some), np.int64), cells[some])
            begin = first[some][row] + cell * each[some][row]
            most, lo, hi = (np.zeros((len(some), width)) for _ in range(3))
            flat = ranges(first[some], n[some])
            most[row, cell] = np.maximum.reduceat(scores[flat], np.cumsum(np.append(0, np.minimum(each[some][row], first[some + 1][row] - begin)))[:-1])
            lo[row, cell] = docs[begin]
            hi[row, cell] = docs[np.minimum(begin + each[some][row], first[some + 1][row]) - 1] + 1
            price = BLOCK_COST * most.max(axis=1)
            best = np.zeros((len(some), width + 1))
            came = np.zeros((len(some), width + 1), dtype=np.int32)
            top, from_ = np.zeros((len(some), LONGEST)), np.zeros((len(some), LONGEST))  # of blocks by their first cell, the latest last
            for end in range(1, width + 1):
                top[:, :-1], from_[:, :-1] = top[:, 1:], from_[:, 1:]
                top[:, -1], from_[:, -1] = 0, lo[:, end - 1]
                live = min(LONGEST, end)
                np.maximum(top[:, -live:], most[:, end - 1, None], out=top[:, -live:])
                total = best[:, end - live : end] + top[:, -live:] * (hi[:, end - 1, None] - from_[:, -live:])
                took = total.argmin(axis=1)
                best[:, end] = total[np.arange(len(some)), took] + price
                came[:, end] = end - live + took
            at = cells[some].copy()
            left = np.flatnonzero(at > 0)
            while len(left):
                at[left] = came[left, at[left]]
                left = left[at[left] > 0]
                out.append(first[some[left]] + at[left] * each[some[left]])
    return np.unique(np.concatenate(out))


class Shard:
    """The postings of a shard that some queries ask for; all arrays in list order."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, first: np.ndarray, ids: np.ndarray):
        """first: where each list starts (and the last ends); ids: place in the order of ids of every document of the shard."""
        self.docs, self.scores, self.first, self.ids = docs, scores, first, ids
        self.key = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 32 | docs
        start = cuts(scores.astype(np.float64), docs, first)
        self.block_lo = docs[start[:-1]]
        self.block_hi = docs[start[1:] - 1] + 1
        self.block_max = np.maximum.reduceat(scores, start[:-1]) if len(scores) else scores
        self.blocks = np.searchsorted(start, first)
        self.read = 0

    def top(self, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best by score, then by place of id; only scores above 0."""
        block = ranges(self.blocks[lists], self.blocks[lists + 1] - self.blocks[lists])
        at = np.concatenate([self.block_lo[block], self.block_hi[block]])
        change = np.concatenate([self.block_max[block], -self.block_max[block]])
        order = np.argsort(at, kind="stable")
        at, change = at[order], np.cumsum(change[order])
        last = np.flatnonzero(np.diff(at, append=at[-1] + 1))  # one stretch for each distinct border
        lo, bound = at[last][:-1], change[last][:-1]
        hi = at[last][1:]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        docs, scores, need, step, a = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 4, 0
        while a < len(order) and bound[order[a]] >= need:
            some = order[a : a + step]
            some = np.sort(some[bound[some] >= need])
            a, step = a + step, step * 2
            # all lists' postings within the stretches
            base = lists[:, None] << 32
            from_ = np.searchsorted(self.key, (base | lo[some]).ravel())
            to = np.searchsorted(self.key, (base | hi[some]).ravel())
            mine = ranges(from_, to - from_)
            self.read += len(mine)
            got, place = np.unique(self.docs[mine], return_inverse=True)
            sums = np.zeros(len(got), np.int64)
            np.add.at(sums, place, self.scores[mine])
            good = sums >= need
            docs, scores = np.concatenate([docs, got[good]]), np.concatenate([scores, sums[good]])
            if len(docs) >= k:
                best = np.lexsort((self.ids[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
                need = max(1, int(scores[-1]))
        best = np.lexsort((self.ids[docs], -scores))[:k]
        return docs[best], scores[best]


def search(found: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text", per_shard: int = QUERIES) -> DataFrame:
    """The k best documents of an index for each query: query, rank (from 1), doc_id, score. found: what index() made, as a written table.

    score: the sum over the query's distinct terms of w * ((1000000000 * tf) div (1000 * tf + 8 * m)), w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 10 + (90 * n * N) div L;
    N documents with terms, L their terms, n one document's, tf and df as usual. Only scores above 0; ties go to the lesser id (null last).
    A query without terms, or none that a document holds, has no rows; no documents or no queries: no rows.

    Queries are numbered and answered in blocks of per_shard, so a task's work is bounded by a shard and a block.
    """
    heads = found.where("term is null")
    totals = heads.agg(F.sum(F.octet_length("counts") / 4).cast("long"), F.sum("n")).first()
    docs, length = totals[0] or 0, totals[1] or 0
    asked = written(query_terms(queries, id_col, text_col), "query-terms")
    names = asked.select("query").distinct()
    # hashes deal queries into blocks, twice as many as full ones would be
    blocks = max(1, -(-2 * names.count() // per_shard)) if names.count() > per_shard else 1
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    by_term = asked.groupBy("term", block).agg(F.collect_list(F.struct(F.col("query").alias("q"))).alias("queries"))
    lists = found.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.ln((2 * F.lit(docs) + 2).cast("double") / (2 * F.sum("n") + 1).cast("double"))).cast("long")
    weights = lists.groupBy("term").agg(weight.alias("w")).where("w > 0")
    lists = lists.join(by_term.join(weights, "term"), "term").select("shard", "block", "term", "docs", "counts", "queries", "w")
    heads = heads.select(F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at"), F.col("docs").alias("ids"), F.col("counts").alias("lengths"))

    def answer(key, postings: pa.Table, head: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out = [(pa.array([], pa.int64()), pa.array([], pa.int64()), none)]
        if postings.num_rows and head.num_rows:
            postings = postings.combine_chunks()
            each = np.frombuffer(head.column("lengths")[0].as_py(), "<u4").astype(np.int64)
            own = head.column("ids")[0].as_py()
            ids = pa.array(np.frombuffer(own[: 8 * len(each)], "<i8"), mask=np.frombuffer(own[8 * len(each) :], "u1").astype(bool))
            order = np.lexsort((np.frombuffer(own[: 8 * len(each)], "<i8"), np.frombuffer(own[8 * len(each) :], "u1")))
            place = np.empty(len(each), np.int64)
            place[order] = np.arange(len(each))
            (where, offsets), (counts, _) = (raw(postings.column(c).chunk(0)) for c in ("docs", "counts"))
            where, tf, first = where.copy().view("<u4").astype(np.int64), counts.copy().view("<u4").astype(np.int64), offsets // 4
            m = 10 + (90 * each * docs) // length
            w = np.repeat(postings.column("w").to_numpy(), np.diff(first))
            shard = Shard(where, w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[where])), first, place)
            asking = postings.column("queries").chunk(0)
            number = np.repeat(np.arange(len(asking)), np.diff(np.asarray(asking.offsets)))
            q = asking.flatten().field(0)
            code = q.dictionary_encode(null_encoding="encode")
            codes = code.indices.to_numpy()
            by = np.argsort(codes, kind="stable")
            for c, mine in zip(code.dictionary.take(pa.array(np.unique(codes))), np.split(number[by], np.flatnonzero(np.diff(codes[by])) + 1), strict=True):
                best, scores = shard.top(mine, k)
                out.append((pa.array([c.as_py()] * len(best), pa.int64()), ids.take(pa.array(best)), scores))
        return pa.table([pa.concat_arrays([o[0] for o in out]), pa.concat_arrays([o[1] for o in out]), pa.array(np.concatenate([o[2] for o in out]))], names=["query", "doc_id", "score"])

    hits = lists.groupBy("shard", "block").cogroup(heads.groupBy("of", "at")).applyInArrow(answer, "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def ranked_search(spark: SparkSession, docs: DataFrame, queries: DataFrame, *, k: int = 10, query_id: str = "item_id") -> DataFrame:
    """search() over a new index of docs."""
    return search(written(index(docs), "lexical-index"), queries, k=k, id_col=query_id)
