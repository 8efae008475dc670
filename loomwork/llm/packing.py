"""Best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, ranked, written
from .textkit import CACHES, byte_hashes, ranges, raw, slices, spans, tidy

#: Words whose ids a Python worker keeps (some 30 bytes each).
KEPT_WORDS = 1_000_000
#: A control character that the encoder makes one id of its own; marks where a word ends in a list of words.
MARK = "\x01"


class WordEncoder:
    """Ids of whole texts from a tokenizer none of whose tokens holds white space, so that a text's ids are its words' ids one after the other.

    Each distinct word goes to the tokenizer once; words met before are kept up to kept of them, as sorted 64-bit hashes with the place of their ids.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._encode(MARK)
        if len(self.mark) != 1 or self._encode(f"a {MARK} b") != self._encode("a") + self.mark + self._encode("b"):
            raise ValueError("the tokenizer keeps white space; words can't be encoded by themselves")
        #: The tokenizer lower-cases too; texts that may hold special tokens are left as they are.
        self.folds = self._encode("ABCXYZ I\u0307") == self._encode("abcxyz i\u0307")
        self._clear()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self.known, self.starts, self.lengths, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, new: list[bytes]) -> None:
        """Keeps the words whose hashes, in ascending order, are these."""
        plain = [k for k, w in enumerate(new) if b"\x01" not in w]
        odd = [k for k, w in enumerate(new) if b"\x01" in w]
        ids, lengths = [self.ids], []
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            got = np.array(self._encode(f" {MARK} ".join(new[i].decode() for i in part) + f" {MARK}"), dtype=np.uint32)
            ends = np.flatnonzero(got == self.mark[0])
            ids.append(np.delete(got, ends))
            lengths.append(np.diff(ends, prepend=-1) - 1)
        for i in odd:
            ids.append(np.array(self._encode(new[i].decode()), dtype=np.uint32))
            lengths.append(np.array([len(ids[-1])]))
        lengths = np.concatenate(lengths).astype(np.int64)
        order = np.empty(len(new), dtype=np.int64)
        order[plain + odd] = np.arange(len(new))  # of each hash's word, among those encoded
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        at = np.searchsorted(self.known, hashes)
        self.known, self.starts, self.lengths = np.insert(self.known, at, hashes), np.insert(self.starts, at, starts[order]), np.insert(self.lengths, at, lengths[order])
        self.ids = np.concatenate(ids)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of each hash among those known, whether it is there)."""
        at = np.searchsorted(self.known, hashes)
        return at, self.known[np.minimum(at, len(self.known) - 1)] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, first id of each text and the number of all)."""
        buf, offsets = raw(column)
        data = buf.tobytes()
        if self.folds and b"<|" not in data:
            data = data.lower()  # A-Z only
        if len(self.known) > self.kept:
            self._clear()
        buf = np.frombuffer(data, dtype=np.uint8)
        starts, ends = spans(buf, offsets)  # parted at ASCII white space only
        every, one, back = np.unique(byte_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at, there = self._places(every)
        if not there.all():
            new = one[~there]
            self._learn(every[~there], [data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at, _ = self._places(every)
        at = at[back]
        lengths = self.lengths[at].astype(np.int64)
        before = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(lengths, out=before[1:])
        return self.ids[ranges(self.starts[at], lengths)], before[np.searchsorted(starts, offsets)]


@lru_cache(2)
def _encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path, kept)


CACHES.append(_encoder.cache_clear)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document's ids and then end_id; longer ones are cut every capacity ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = _encoder(tokenizer, kept)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, 1):
                ids, first = encoder.encode(part.column(1))
                owner, piece, start, length, crc = [], [], [], [], []
                for d in range(part.num_rows):
                    own = np.concatenate([ids[first[d] : first[d + 1]], end]).astype("<u4")
                    for k, a in enumerate(range(0, len(own), capacity)):
                        owner.append(d)
                        piece.append(k)
                        start.append(a)
                        length.append(min(capacity, len(own) - a))
                        crc.append(zlib.crc32(own[a : a + capacity]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy(run, keeps=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit for classes of equal lengths: intervals (length, first rank, first sequence, step, offset).

    One sweep per length, the longest first. It goes up the sorted gaps from the successor of its length; the
    documents of the length, by rank, take the sequences with that gap, as many of them each as it holds;
    who finds none goes on to the next gap, and at last to new sequences. Then the gaps are updated. There
    are at most capacity lengths and as many gaps, and every loop runs over these or over runs of sequences
    with a common history, never over documents.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan, opened = [], 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(order, length)
            gap = order[k] if k < len(order) else capacity
            each = gap // length
            if k < len(order):
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                first, n = opened, -(-left // each)
                opened += n
            if n * each > left:  # some stay as they were or get fewer
                full, rest = divmod(left, each)
                if k < len(order) or gap < capacity:
                    free(gap, first + full + (rest > 0), n - full - (rest > 0))
            else:
                full, rest = n, 0
            for layer in range(each):
                takers = full + (layer < rest)
                if takers:
                    plan.append((length, rank, first, 1, capacity - gap + layer * length))
                    rank += takers
            left -= full * each + rest
            free(gap - each * length, first, full)
            if rest:
                free(gap - rest * length, first + full, 1)
    return plan


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end_id. Pieces never share a sequence's places and leave no gap before them.
    Rows that share an id each get their own places. No documents: no rows. kept: words whose ids a Python worker keeps.

    Bulk-synchronous: pieces of one length are interchangeable, so documents and gaps are sorted as classes, and each sweep
    matches a whole length at once with the gaps that follow it and settles who gets which sequence by rank. Only the counts
    by length (capacity rows at most) reach the driver, which makes the sweeps on them. A class is ranked in as many
    parts as its count asks for; pieces of capacity fill a sequence each, in any order.
    """
    rows = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, kept), "pieces")
    counts = {int(n): int(c) for n, c in rows.groupBy("length").count().collect()}
    rows = ranked(rows, "length", counts, F.lit(0), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.struct("doc_id", "piece", "ids_crc32"))
    rows = placed(rows, "length", sweeps(counts, capacity), ["sequence_id", "offset"])
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
