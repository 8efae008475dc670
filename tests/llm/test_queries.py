"""The registered opN_ queries over the smallest tables: against their SQL, or against what their contract says of the result."""

import glob
import hashlib
import os
import zlib

import numpy as np
import pytest

from loomwork.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, tmp_path, name):
    out = queries.QUERIES[name](spark, DATA)
    out.write.parquet(f"{tmp_path}/out")
    columns = ", ".join(f'"{c}"' for c in sorted(out.columns))
    duck.sql(f"CREATE OR REPLACE TABLE a AS SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    duck.sql(f"CREATE OR REPLACE TABLE b AS SELECT {columns} FROM ({queries.SQL[name]})")
    n, more, less = duck.sql("SELECT (SELECT count(*) FROM b), (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))").fetchall()[0]
    assert n > 0 and (more, less) == (0, 0)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours(spark, duck, size):
    data = f"/root/testdata/{size}"
    rows = duck.sql(f"SELECT vec_id, embedding FROM '{data}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    found = {}
    for r in queries.op6_neighbours(spark, data).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(ids[ids % 20 == 0].tolist())
    hits = total = 0
    for q, got in found.items():
        got.sort()
        scores = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        best = [v for _, v in sorted((-s, v) for s, v in zip(scores, ids.tolist(), strict=True) if v != q)[:20]]
        assert [r for r, _, _ in got] == list(range(1, len(best) + 1))
        assert got == [(k + 1, v, s) for k, (_, v, s) in enumerate(sorted(got, key=lambda x: (-x[2], x[1])))]
        assert all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, s in got)
        hits += len(set(best) & {v for _, v, _ in got})
        total += len(best)
    assert hits >= 0.95 * total


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")).encode
    ids = {d: [*encode(t or "", add_special_tokens=False).ids, 0] for d, t in documents}
    rows = queries.op7_packing(spark, DATA).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, min(2048, len(ids[d]) - a)) for k, a in enumerate(range(0, len(ids[d]), 2048))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert (len(sequences) - 1) * 2048 <= 1.02 * sum(map(len, ids.values()))


def test_language(spark, duck):
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    rows = queries.op8_language_id(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    learned = {v for d, v in langs.items() if v is not None and zlib.crc32(str(d).encode()) % 4 != 2}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred in learned if lettered else r.lang_pred == "und"
    held = [r for r in rows if r.held_out and langs[r.doc_id] is not None and r.lang_pred != "und"]
    assert held and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)


def test_fingerprints(spark, documents):
    order = sorted(documents, key=lambda r: -r[0])
    texts = {d: t or "" for d, t in documents}
    rows = {r.doc_id: r for r in queries.op9_fingerprints(spark, DATA).collect()}
    assert set(rows) == set(texts)
    prints = {}
    for k, (d, _) in enumerate(order):
        own, after = texts[d], order[(k + 1) % len(order)][0]
        half = len(own) // 2
        edited = own[: len(own) - half] + texts[after][:half]
        r = rows[d]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint
        if edited == own:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.3


def test_sharding(spark, documents):
    rows = queries.op10_sharding(spark, DATA).collect()
    texts = {d: (t or "").encode() for d, t in documents}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {k: [] for k in range(40)}
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
