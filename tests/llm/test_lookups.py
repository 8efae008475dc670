"""Token files, lexical search and the Merkle manifest against brute force, with odd rows."""

import hashlib
import io
import math
import re
from itertools import groupby

import numpy as np
import pytest

from loomwork.llm import lexical, merkle, tokenfiles
from loomwork.llm.common import shared_dir, written
from loomwork.llm.queries import vocabulary

from .corpus import SCHEMA, documents, frame

WORDS = vocabulary("word_bpe_49k.json")


def odd_rows():
    """Null and repeated ids, equal rows, empty and very long texts, and columns with clashing names."""
    rows = documents()
    rows += [(None, "null id one", "en", "a", 3, 7, "n", 1, 9), (None, None, None, None, None, 7, "n", 1, 9), (None, "null id one", "en", "a", 3, 7, "n", 1, 9)]
    rows += [(4, "another text of four", "de", "b", 5, 7, "n", 1, 9), (4, "another text of four", "de", "b", 5, 7, "n", 1, 9), (-(1 << 63), "least", "en", "é", 2, 7, "n", 1, 9)]
    rows.append((10_000, "Long " * 90_000, "en", "a", 450_000, 7, "n", 1, 9))
    return rows


# ---- token files


def encoded(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def token_path(spark):
    path = f"{shared_dir(spark)}/token-test"
    tokenfiles.write(frame(spark, odd_rows()), path, WORDS, file_ids=2000, frame_ids=1000)
    return path


def test_token_files_round_trip(spark, token_path):
    got = sorted(tokenfiles.read(spark, token_path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in odd_rows()], key=lambda d: (d is not None, d or 0))
    at, seen = 0, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and ids[-1] == 2
        at += len(ids)
        seen.setdefault(r.doc_id, []).append(ids)
    want = {}
    for d, text, *_ in odd_rows():
        want.setdefault(d, []).append(encoded(text))
    assert {d: sorted(x) for d, x in seen.items()} == {d: sorted(x) for d, x in want.items()}
    assert tokenfiles.files(spark, token_path).count() >= 3


def test_token_files_fetch(spark, token_path):
    wanted = spark.createDataFrame([(4,), (4,), (10_000,), (77_777,), (None,)], "doc_id long")
    whole = {(r.doc_id, r.start): r.ids for r in tokenfiles.read(spark, token_path).collect() if r.doc_id in (4, 10_000)}
    assert {(r.doc_id, r.start): r.ids for r in tokenfiles.fetch(spark, token_path, wanted).collect()} == whole and len(whole) == 4


def test_token_files_of_nothing_and_of_equal_rows(spark):
    path = f"{shared_dir(spark)}/token-none"
    tokenfiles.write(frame(spark, []), path, WORDS)
    assert tokenfiles.read(spark, path).collect() == []
    path = f"{shared_dir(spark)}/token-equal"
    tokenfiles.write(spark.range(30_000).selectExpr("cast(null as long) doc_id", "repeat('equal text ', 30) text"), path, WORDS, range_bytes=1 << 20)
    got = tokenfiles.files(spark, path).collect()
    assert len(got) >= 8 and sum(r.n_docs for r in got) == 30_000 and max(r.n_docs for r in got) < 8000  # rows of one id and text lie in several ranges


def test_a_reader_decompresses_only_frames_of_its_documents():
    import zstandard

    sink, rng = io.BytesIO(), np.random.default_rng(1)
    docs = [rng.integers(0, 49_000, n).astype(np.uint32) for n in (5, 0, 900, 40, 2500, 1, 999, 1000, 3)]
    w = tokenfiles.Writer(sink, frame_ids=1000)
    for k, d in enumerate(docs):
        w.add(None if k == 3 else k, d)
    w.close()
    reader = tokenfiles.Reader(io.BytesIO(sink.getvalue()))
    tail = reader.read_frames
    doc_id, start, ids = reader.document(6)
    assert (doc_id, start, ids.tolist()) == (6, sum(map(len, docs[:6])), docs[6].tolist()) and reader.read_frames - tail <= 2 < len(reader.frame_ends)
    assert reader.document(3)[0] is None and reader.document(1)[2].tolist() == []
    assert [reader.document(k)[2].tolist() for k in range(9)] == [d.tolist() for d in docs]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert plain.startswith(np.concatenate(docs).astype("<u4").tobytes())  # any tool reads the ids
    broken = bytearray(sink.getvalue())
    broken[40] ^= 1
    with pytest.raises(Exception, match="checksum|decompress|Data corruption"):
        tokenfiles.Reader(io.BytesIO(bytes(broken))).document(0)


def test_a_failed_attempt_leaves_no_document_twice(spark, tmp_path):
    """Files of other attempts lie in the folder; the index names those that count."""
    path = str(tmp_path / "t")
    docs = frame(spark, documents()[:9])
    tokenfiles.write(docs, path, WORDS)
    first = next((tmp_path / "t").glob("ids-*.zst"))
    (tmp_path / "t" / "ids-000000-0000-lost.zst").write_bytes(first.read_bytes())
    assert tokenfiles.read(spark, path).count() == 9


# ---- lexical search


def brute_force(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    held = [(d, cut(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    for i, words in asked.items():
        scored = []
        for d, w in held:
            m = 10 + (90 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in words if t in df and t in w)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out[i] = [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return {i: x for i, x in out.items() if x}


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query, []).append((r["rank"], r.doc_id, r.score))
    return {i: sorted(x) for i, x in out.items()}


def test_search_equals_brute_force(spark):
    rows = odd_rows()
    texts = [r[1] for r in rows if r[1]]
    items = [(k, " ".join((t or "").split()[:25])) for k, t in enumerate(texts)] + [(1000, None), (1001, "  ,. "), (1002, "zzz unheard of"), (None, "Pad passage é"), (5, texts[9][:80]), (1003, "PAD, pad. pad")]
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, score int, shard int")
    index = written(lexical.index(frame(spark, rows).repartition(3), shard_terms=2000, shard_docs=20), "lexical-test")
    want = brute_force([(r[0], r[1]) for r in rows], items)
    assert found(lexical.search(index, asked).collect()) == want
    assert found(lexical.search(index, asked, per_shard=7).collect()) == want
    assert index.select("shard").distinct().count() > 5


def test_search_of_nothing(spark):
    empty = frame(spark, [])
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(spark, empty, asked).collect() == []
    assert lexical.ranked_search(spark, frame(spark, documents()), asked.limit(0)).collect() == []
    assert lexical.ranked_search(spark, frame(spark, [(1, None, "en", "a", 0, 7, "n", 1, 9)]), asked).collect() == []


def best_cuts(scores, docs):
    """The least cost over all ways to cut one list."""
    size = int(lexical.cell_size(np.array(len(scores))))
    cells = [range(a, min(a + size, len(scores))) for a in range(0, len(scores), size)]
    cost = lambda s, e: max(scores[cells[s][0] : cells[e - 1][-1] + 1]) * (docs[cells[e - 1][-1]] + 1 - docs[cells[s][0]])
    best = [0.0]
    for end in range(1, len(cells) + 1):
        best.append(min(best[s] + cost(s, end) + lexical.BLOCK_COST * max(scores) for s in range(max(0, end - lexical.LONGEST), end)))
    return best[-1]


def test_blocks_have_the_least_bound_error():
    rng = np.random.default_rng(3)
    sizes = [1, 7, 8, 9, 16, 100, 333, 1000, 40, 2500, 2]
    scores = np.concatenate([rng.integers(1, 50, n) * (1 + 9 * (rng.random(n) < 0.03)) for n in sizes]).astype(np.float64)
    docs = np.concatenate([np.sort(rng.choice(3000, n, replace=False)) for n in sizes])
    first = np.cumsum([0, *sizes])
    start = lexical.cuts(scores, docs, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        edges = start[(start >= a) & (start <= b)]
        assert edges[0] == a and edges[-1] == b and all((edges[1:-1] - a) % lexical.cell_size(b - a) == 0)
        cost = sum(scores[x:y].max() * (docs[y - 1] + 1 - docs[x]) + lexical.BLOCK_COST * scores[a:b].max() for x, y in zip(edges[:-1], edges[1:], strict=True))
        assert cost == pytest.approx(best_cuts(scores[a:b].tolist(), docs[a:b].tolist()))


def test_a_shard_skips_blocks():
    rng = np.random.default_rng(5)
    n, lists = 40_000, 12
    docs, scores = [], []
    for k in range(lists):
        own = np.flatnonzero(rng.random(n) < (0.3 if k < 6 else 0.002))
        docs.append(own)
        scores.append(rng.integers(1, 100, len(own)) * (1 if k < 6 else 40))
    first = np.cumsum([0, *map(len, docs)])
    shard = lexical.Shard(np.concatenate(docs), np.concatenate(scores).astype(np.int64), first, np.arange(n)[::-1].copy())
    got, best = shard.top(np.arange(lists), 10)
    total = np.zeros(n, np.int64)
    np.add.at(total, np.concatenate(docs), np.concatenate(scores))
    want = np.lexsort((np.arange(n)[::-1], -total))[:10]
    assert got.tolist() == want.tolist() and best.tolist() == total[want].tolist()
    assert shard.read < 0.5 * first[-1]


# ---- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, siblings of every node from its level up, with their side)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append("" if other >= len(level) else ("<" if other < i else ">") + level[other])
            at[k] = i // 2
        level = [h(*level[a : a + 2]) for a in range(0, len(level), 2)]
    return level[0] if level else None, paths


@pytest.mark.parametrize("fan", [1, 2, 10])
def test_manifest_equals_brute_force(spark, fan):
    rows = odd_rows()
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    place = SCHEMA.replace(",", "").split()[::2]
    leaf = lambda r: h(*("-" if r[place.index(c)] is None else f"{len(str(r[place.index(c)]).encode())}:{r[place.index(c)]}" for c in fields))
    every = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r), r[0]) for r in rows))
    groups = [list(x) for _, x in groupby(every, key=lambda x: x[:2])]
    trees = [tree([x[4] for x in g]) for g in groups]
    root, over = tree([t[0] for t in trees])
    want = sorted((str(x[5]), x[4], t[0], root, "|".join(p + up)) for g, t, up in zip(groups, trees, over, strict=True) for x, p in zip(g, t[1], strict=True))
    from pyspark.sql import functions as F

    docs = frame(spark, rows).repartition(5).withColumns({"g": F.lit(1), "idx": F.lit(2), "steps": F.lit("x"), "leaf": F.lit("y")})
    got = merkle.manifest(written(docs, "merkle-test"), fields, fan=fan, also={"claimed": F.sha2("text", 256)}).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, "|".join(r.steps)) for r in got) == want
    assert all(r.folded == root for r in got)
    bad = merkle.manifest(written(docs, "merkle-test"), fields, fan=fan).withColumn("folded", merkle.fold(F.sha2("leaf", 256), F.col("steps"))).collect()
    assert all(r.folded != root for r in bad)


def test_manifest_of_nothing_and_of_one(spark):
    fields = ["doc_id", "text"]
    assert merkle.manifest(frame(spark, []), fields).collect() == []
    (r,) = merkle.manifest(frame(spark, documents()[:1]), fields).collect()
    assert r.leaf == r.subroot == r.root and r.steps == []
