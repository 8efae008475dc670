"""Token ids in binary files: independent zstandard frames, a checksum each, and a seek table at the end.

A file is in the public seekable format of zstandard, so plain tools decompress it too:

* data frames: ids as unsigned 32-bit integers, little-endian. A frame ends before a document that would make it exceed
  FRAME_IDS ids; a longer document is cut every FRAME_IDS ids;
* index frames: an ENTRY (id, whether it is null, number of ids) per document, in the order of the data;
* a trailer frame: TRAILER;
* a skippable frame with the seek table: sizes of every frame before and after decompression and the low half of XXH64 of
  its content, then the number of frames, a descriptor and a magic number.

A reader takes the tail, the index frames and those frames that hold the documents it was asked for.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import qualified
from .common import running
from .packing import WordEncoder
from .packing import _encoder as word_encoder
from .textkit import CACHES, slices, tidy

#: Ids of a data frame and entries of an index frame.
FRAME_IDS = 1 << 16
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 1 << 26
#: Bytes of text of a task's range of documents, at most and (where shuffle partitions would idle) at least.
RANGE_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: Words whose ids a Python worker keeps; with 2,000,000 an executor of 3000 MB was once too small.
KEPT_WORDS = 1_500_000
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])
TRAILER = struct.Struct("<8sIIQQ")  # name, data frames, index frames, documents, ids
NAME = b"LOOMTOK1"
# fixed values of the public format
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = "part long, file string, place long, doc_id long, n_tokens long"


class Writer:
    """Writes documents to a sink (anything with write); close() ends the file, not the sink."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.sink, self.frame_ids = sink, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.frames: list[tuple[int, int, int]] = []
        self.parts: list[np.ndarray] = []
        self.held = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > self.frame_ids:
            self._flush()
        for a in range(0, len(ids), self.frame_ids):
            part = ids[a : a + self.frame_ids]
            self.parts.append(part)
            self.held += len(part)
            if self.held >= self.frame_ids:
                self._flush()
        self.entries.append((doc_id or 0, doc_id is None, len(ids)))
        self.ids += len(ids)

    def _flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.parts).astype("<u4").tobytes())
            self.parts, self.held = [], 0

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.pack.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        data, entries = len(self.frames), np.array(self.entries, dtype=ENTRY)
        for a in range(0, len(entries), self.frame_ids):
            self._frame(entries[a : a + self.frame_ids].tobytes())
        self._frame(TRAILER.pack(NAME, data, len(self.frames) - data, len(entries), self.ids))
        table = np.array(self.frames, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads a file (anything with read and seek) by its seek table; a frame whose checksum differs raises ValueError."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(max(0, end - 9))
        frames, kind, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or kind != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        source.seek(end - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.read_frames = 0
        name, data, index, documents, ids = TRAILER.unpack(self._frame(frames - 1))
        if name != NAME:
            raise ValueError("no token file")
        self.entries = np.concatenate([np.zeros(0, ENTRY), *(np.frombuffer(self._frame(data + k), dtype=ENTRY) for k in range(index))])
        self.ends = np.cumsum(self.entries["n"].astype(np.int64))
        self.frame_ends = np.cumsum(self.table[:data, 1] // 4)
        if len(self.entries) != documents or (self.ends[-1] if documents else 0) != ids or (self.frame_ends[-1] if data else 0) != ids:
            raise ValueError("index and data differ")
        self._kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        self.source.seek(int(self.at[k]))
        data = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: wrong checksum")
        self.read_frames += 1
        return data

    def _ids(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            self._kept = (k, np.frombuffer(self._frame(k), dtype="<u4"))
        return self._kept[1]

    def document(self, place: int) -> tuple[int | None, int, np.ndarray]:
        """(id, ids before it, its ids) of the document at a place of the file; reads its own frames only."""
        entry, end = self.entries[place], int(self.ends[place])
        start = end - int(entry["n"])
        parts = []
        if end > start:
            for k in range(*(np.searchsorted(self.frame_ends, [start, end - 1], side="right") + [0, 1]).tolist()):
                first = int(self.frame_ends[k - 1]) if k else 0
                parts.append(self._ids(k)[max(0, start - first) : end - first])
        return None if entry["null"] else int(entry["doc_id"]), start, parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts])


def filesystem(uri: str):
    """Arrow's file system of a folder and the folder's path in it. Executors open the same uri, so it must be shared."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class PlainEncoder:
    """Ids of whole texts from any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)
        lists = [np.array(x.ids, dtype=np.uint32) for x in found]
        return np.concatenate([np.zeros(0, np.uint32), *lists]), np.cumsum([0, *map(len, lists)])


@lru_cache(1)
def _encoder(path: str, kept: int) -> WordEncoder | PlainEncoder:
    try:
        return word_encoder(path, kept)
    except ValueError:  # its tokens hold white space
        return PlainEncoder(path)


CACHES.append(_encoder.cache_clear)


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, file_ids: int = FILE_IDS, frame_ids: int = FRAME_IDS, kept: int = KEPT_WORDS) -> None:
    """Writes the ids of every whole text, end_id after each, to files in the folder path and an index of them (INDEX) to path/index.

    Documents ascend by id (an integer; null first) over the files' parts. A null text is empty and leaves end_id alone. Rows of one
    id are documents of their own, by text hash, then as they are read; docs must give its rows in the same order
    when read again, as written tables do. No documents: no files and an empty index.

    Ranges of at most about range_bytes of text, as many as shuffle partitions if these are more, are dealt to the tasks; rows of one id, null too, may lie in several. Every attempt of a task writes files of
    its own names, and the index, committed by Spark's writer, names those of the attempts that counted: a lost executor leaves unnamed files at most.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_own", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_own")]
    ranges = max(1, -(-size // range_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    path = qualified(docs.sparkSession, path)
    store, folder = filesystem(path)
    store.create_dir(folder, recursive=True)

    def run(batches):
        store, folder = filesystem(path)
        encoder, end = _encoder(tokenizer, kept), np.array([end_id], dtype=np.uint32)
        part = TaskContext.get().partitionId() << 20
        sink = writer = name = None
        for batch in batches:
            for piece in slices(batch, 1):
                ids, first = encoder.encode(piece.column(1))
                told = []
                for d, doc_id in enumerate(piece.column(0).to_pylist()):
                    if writer is None:
                        name = f"ids-{part >> 20:06d}-{part & 0xFFFFF:04d}-{uuid.uuid4().hex}.zst"
                        sink = store.open_output_stream(f"{folder}/{name}", compression=None)
                        writer = Writer(sink, frame_ids)
                    own = np.concatenate([ids[first[d] : first[d + 1]], end])
                    told.append((part, name, len(writer.entries), doc_id, len(own)))
                    writer.add(doc_id, own)
                    if writer.ids >= file_ids:
                        writer.close()
                        sink.close()
                        writer, part = None, part + 1
                columns = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "place", "doc_id", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()

    dealt.mapInArrow(tidy(run, keeps=True), INDEX).write.parquet(f"{path}/index")


def _read(path: str, rows: Iterator[tuple[str, int, int | None]]) -> Iterator[pa.RecordBatch]:
    """Documents of (file, ids before the file, place or None for all of the file); a file's rows follow each other."""
    store, folder = filesystem(path)
    opened, reader = None, None
    told: list[tuple] = []
    size = 0

    def batch(told):
        columns = zip(*told, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids"])

    for name, before, place in rows:
        if name != opened:
            opened, reader = name, Reader(store.open_input_file(f"{folder}/{name}"))
        for k in range(len(reader.entries)) if place is None else (place,):
            doc_id, start, ids = reader.document(k)
            told.append((doc_id, before + start, ids.tobytes()))
            size += len(told[-1][2])
            if size >= 4 << 20 or len(told) >= 10_000:
                yield batch(told)
                told, size = [], 0
    if told:
        yield batch(told)


def files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: part, file, n_docs, n_tokens, before (ids of all files before it)."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    found = index.groupBy("part", "file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return running(found, "part", "n_tokens", "before", shift=30)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), ids (bytes of unsigned 32-bit integers). A task reads one file, frame by frame."""
    path = qualified(spark, path)
    found = files(spark, path).select("part", "file", "before")
    n = spark.read.schema(INDEX).parquet(f"{path}/index").select("part").distinct().count()

    def run(batches):
        yield from _read(path, ((name, before, None) for b in batches for name, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))

    return found.repartitionByRange(max(1, n), "part").mapInArrow(tidy(run), "doc_id long, start long, ids binary")


def fetch(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is in wanted (repeats count once, null finds nothing), as read() gives them; only frames that hold one are decompressed."""
    path = qualified(spark, path)
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    index = spark.read.schema(INDEX).parquet(f"{path}/index").join(ids, "doc_id", "left_semi")
    rows = index.join(files(spark, path).select("file", "before"), "file").select("file", "before", "place")

    def run(batches):
        yield from _read(path, (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)))

    return rows.repartition("file").sortWithinPartitions("file", "place").mapInArrow(tidy(run), "doc_id long, start long, ids binary")
