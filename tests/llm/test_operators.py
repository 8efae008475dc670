import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, components, fingerprints, langid, mixing, neardup, neighbours, packing, sharding, substrings, textkit, urls
from loomwork.llm.queries import vocabulary

from .corpus import SCHEMA, documents, frame

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1: near duplicates


def shingle_set(text, size):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute_classes(rows, size, percent):
    sets = [(d, shingle_set(t, size)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(d), root(e)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_classes(docs, rows, size, percent):
    got = sorted(map(tuple, neardup.classes(docs, size=size, percent=percent).collect()))
    assert got == brute_classes(rows, size, percent)


def test_classes_of_blocks_and_trees(spark, monkeypatch):
    rng = random.Random(3)
    rows, base = [], [f"w{i}" for i in range(80)]
    for k in range(140):  # a chain of near copies, most too far from the first
        base[rng.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(base)))
    monkeypatch.setattr(neardup, "BLOCK", 24)
    monkeypatch.setattr(neardup, "SPLIT", 10)
    monkeypatch.setattr(neardup, "HOT", 3)
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=80).collect()))
    assert got == brute_classes(rows, 3, 80)


def test_tree_prunes_no_pair():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 62, 60) for _ in range(8)]
    sets = [np.unique(np.concatenate([b[rng.random(60) < 0.97], rng.integers(0, 1 << 62, rng.integers(0, 3))])) for b in base for _ in range(15)]
    sig = np.zeros((len(sets), neardup.BITS), dtype=bool)
    for i, s in enumerate(sets):
        sig[i, s % neardup.BITS] = True
    n = np.array([len(s) for s in sets])
    group = np.repeat(np.arange(4), [1, 2, 40, len(sets) - 43])
    forest = neardup.Forest(group, np.packbits(sig, axis=1), n, np.arange(len(sets)))
    pairs = lambda star: {(i, j) for a, b in neardup.traverse(forest, 90, np.array([False, False, False, star]), most=50) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    found = pairs(False)
    assert pairs(True) == {(i, j) for i, j in found if group[i] < 3 or i == 43}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    want = {(i, j) for i, j in want if group[i] == group[j]}
    assert want and want <= found
    assert all(group[i] == group[j] for i, j in found) and len(found) < len(sets) * (len(sets) - 1) / 4


def test_classes_odd(spark, empty):
    assert neardup.classes(empty).count() == 0
    same = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, neardup.classes(same).collect()), key=str) == sorted([(5, 1, None), (5, 1, None), (None, 1, None), (9, 0, 9)], key=str)


def test_classes_of_ids_with_several_texts(spark):
    """A copy takes only its own text out of the search, not the others of its id."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    d = spark.createDataFrame([(3, one), (5, one), (5, two), (7, two + " tail"), (9, "c d e f g h")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(d).collect()}
    assert got == {3: 3, 5: 3, 7: 3, 9: 9}


def regular(n, a, b):
    """The sequence of n letters (a power of two) on which polynomial hashes collide with its complement."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_classes_of_long_texts_and_words(spark):
    """Words that differ although regular, texts of 20,000 words, columns with the operator's own names."""
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    near, far = list(long), list(long)
    near[77] = "other"
    far[::5] = ["x"] * 4000
    texts = [regular(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "ba")] + [" ".join(t) for t in (long, near, far, long[:10_000], ["pad"] * 20_000)]
    rows = [(k, t, 1, 2, "c", "d") for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, doc long, key long, _several string, head string")
    assert sorted(map(tuple, neardup.classes(d).collect())) == brute_classes([r[:2] for r in rows], 5, 80)


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 70), (7, 7), (100, 50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(1, 31)} | {70: 50, 100: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2: chats


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 2, "user", odd), (1, 3, "assistant", " two\nlines é😀 <\\|x|> <"),
        (2, 0, None, None), (2, 1, "assistant", None), (2, 2, "assistant", ""), (None, 5, "assistant", "|> start"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"),
        (4, 0, "<|im_sep|>", "<|endoftext|>"), (4, 1, "assistant", "x" * 30_000),
    ]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("ids", F.lit(2))
    out = {r["conv_id"]: r for r in chat.format_chats(d, vocabulary("byte_bpe_50k.json")).collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r or "", x or ""))
    assert set(out) == set(by)
    for c, want in by.items():
        want = [(r, x) for _, r, x in sorted(want)]
        assert chat.parse(out[c]["formatted"]) == want
        offsets = np.array(out[c]["offsets"]).reshape(-1, 2)
        assert chat.covered(out[c]["formatted"], offsets, np.array(out[c]["loss"], dtype=bool)) == "".join(x for r, x in want if r == "assistant")
    assert chat.format_chats(d.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|a<|<|", "|><|im_end|>", "<<||>>", "\\<|"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


# 3: mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in order if s not in full]
        total = sum(w[s] for s in rest)
        out |= {s: left * w[s] / total for s in rest}
        over = [s for s in rest if out[s] > most * sizes[s]]
        if not over:
            return out
        for s in over:
            out[s] = most * sizes[s]
            full.add(s)
            left -= out[s]
        if len(full) == len(order):
            return out


def test_mix(docs, rows, empty):
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len((t or "").encode().split())
    want = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(2)).collect()}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2 and again[r["doc_id"]] == r["copies"]
        rate = want[r["source"]] / sizes[r["source"]]
        assert r["copies"] - np.floor(rate) in (0, 1)
        taken[r["source"]] += r["copies"] * r["size"]
    emitted = Counter(r["doc_id"] for r in mixing.emit(docs).collect())
    assert emitted == Counter({d: c for d, c in again.items() if c})
    assert mixing.emit(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, None: 5}, {"a": 0}, {"a": 1, "b": 100, "c": 1000, "d": 3}])
def test_targets(spark, sizes):
    d = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(d, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_draws_are_even(spark):
    x = spark.range(4000).select(mixing.draw("s", F.col("id")).alias("x")).agg(F.min("x"), F.avg("x"), F.max("x")).first()
    assert 0 <= x[0] < 0.01 and abs(x[1] - 0.5) < 0.02 and 0.99 < x[2] < 1


# 4: URL rules


def test_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("net", "/", "block")], "host string, path string, verdict string")
    cases = {
        "http://a.example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://net/": ("net", "/", "net/", "block"),
        "x://foo.net": ("foo.net", "", None, "allow"),
        "http://foonet/": ("foonet", "/", None, "allow"),
        "https://example.com/de/#t": ("example.com", "/de/", "example.com/de/", "block"),
        "https://example.com/de": ("example.com", "/de", None, "allow"),
        "https://ÉX.org/fr/a://b": ("Éx.org", "/fr/a://b", "org/fr/", "allow"),
        "https://a.net?q=http://b.org/fr/": ("a.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = [(i, u, "clash") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "clash")]
    d = spark.createDataFrame(pages, "page_id long, url string, host string")
    got = Counter(map(tuple, urls.judge(d, rules).collect()))
    assert got == Counter((i, *cases[u]) for i, u, _ in pages)
    assert {r["rule"] for r in urls.judge(d, rules.limit(0)).collect()} == {None}
    assert urls.judge(d.limit(0), rules).count() == 0


def test_many_rules_one_block(spark):
    rules = spark.createDataFrame([(f"h{i}.com", "/p", "block") for i in range(500)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p/q") for i in range(1000)], "page_id long, url string")
    got = urls.judge(pages, rules, blocks=2).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] < 500) for r in got)


# 5: repeated windows


def brute_cut(rows, window):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(20, 8, 100), (20, 8, 1), (6, 2, 100), (6, 3, 2), (5, 5, 100)])
def test_substrings(docs, rows, monkeypatch, window, gram, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SLICE", 2000)
    got, repeats = {}, {}
    for r in substrings.dedup(docs, window=window, gram=gram, also=("size", "rank")).collect():
        kept = r["kept"] if r["kept"] is not None else " ".join(x.decode() for x in (r["text"] or "").encode().split())
        assert (r["kept"] is None) == (r["n_removed"] == 0) and (r["size"], r["rank"]) == (7, 1)
        got[r["doc_id"]] = (r["n_words"], r["n_removed"], kept)
        repeats[r["doc_id"]] = [tuple(x) for x in r["repeats"]]
    assert got == brute_cut(rows, window)
    texts = {d: (t or "").encode().split() for d, t, *_ in rows}
    for d, found in repeats.items():
        assert len({i for a, n, *_ in found for i in range(a, a + n)}) == got[d][1]
        for a, n, source, b in found:
            assert n >= window and (source, b) < (d, a) and texts[d][a : a + n] == texts[source][b : b + n]
        assert not any((s, b - a) == (s2, b2 - a2) and a <= a2 <= a + n - window + 1 for i, (a, n, s, b) in enumerate(found) for a2, _, s2, b2 in found[i + 1 :])
    assert any(n > 2 * window for found in repeats.values() for _, n, *_ in found)


def test_substrings_odd(spark, empty):
    assert substrings.dedup(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, long), (1, long), (None, long), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.dedup(d).collect()))
    assert got == [(-1, 30, 0), (1, 30, 30), (1, 30, 30), (2, 0, 0)]


def test_substrings_of_long_texts_and_words(spark):
    rng = random.Random(9)
    one, two = regular(2048, "a", "b"), regular(2048, "b", "a")
    tail = " ".join(f"t{i}" for i in range(19))
    long = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    texts = [f"{one} {tail}", f"{two} {tail}", " ".join(long), " ".join(long[5000:] + ["x"] * 5), f"{one} {tail} end"]
    d = spark.createDataFrame([(k, t, 1, [2]) for k, t in enumerate(texts)], "doc_id long, text string, th long, found array<int>")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"] if r["kept"] is not None else r["text"]) for r in substrings.dedup(d).collect()}
    assert got == brute_cut(list(enumerate(texts)), 20) and got[1][1] == 0


def test_groups_of_many_rows():
    keys = np.repeat([1, 2, 3, 4], [5, 1000, 3, 1])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50])], names=["k"]) for i in range(0, len(keys), 50)]
    parts = [t.column(0).to_numpy() for t in substrings.whole_groups(iter(batches), most=100, enough=10)]
    assert np.concatenate(parts).tolist() == keys.tolist() and max(map(len, parts)) < 200
    assert all((p == 2).sum() == 0 or (p == 2).sum() >= 10 for p in parts) and all((p == k).sum() in (0, n) for p in parts for k, n in ((1, 5), (3, 3)))


def test_substrings_of_one_id(spark, monkeypatch):
    """Texts of one id don't take each other's anchors along."""
    rng = random.Random(4)
    passage = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(30)) for _ in range(50)]
    rows = [(None, passage[k] + f" end{k} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(20))) for k in range(50)] + [(k, passage[k]) for k in range(50)]
    marks, real = [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda d, name: marks.append(real(d, name)) or marks[-1])
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r["n_removed"], r["kept"]) == ((0, None) if r["doc_id"] is None else (30, "")) for r in got) and len(got) == 100
    assert marks[0].groupBy("doc").count().agg({"count": "max"}).first()[0] < 30


# 6: neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, size=(600, 1))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(3, x[3].tolist(), "c"), (1001, None, "c"), (1002, [0.0] * 16, "c"), (1003, [float("nan")] * 16, "c"), (1004, [None, 1.0], "c"), (1005, [1.0, 2.0], "c"), (None, x[5].tolist(), "c"), (1020, [float("inf")] * 16, "c")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in neighbours.nearest(d, d.where("vec_id % 20 = 0"), k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(y == s[v] for _, v, y in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len(set(want.tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    assert neighbours.nearest(d.limit(0), d, k=3).count() == 0
    few = d.where("vec_id < 3")
    assert neighbours.nearest(few, few, k=20).count() == 6


def test_neighbours_of_a_full_shard(spark):
    """Short and long queries, and a few very long vectors among many."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(neighbours.SHARD, 64)), rng.normal(size=(48, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[[5, 600, 7000]] *= [[3], [5], [10]]
    q /= 8 * np.linalg.norm(q, axis=1, keepdims=True)
    q[:16] *= 0.01
    q[16:32] *= 100
    frame = lambda v, first: spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame(x, 0), frame(q, 10_000), k=20).collect()
    hits = Counter(r["query_id"] // 16 for r in got if r["vec_id"] in set(np.argsort(-(x @ q[r["query_id"] - 10_000]))[:20].tolist()))
    assert len(got) == 20 * len(q) and len(hits) == 3
    assert all(n >= 0.95 * 20 * 16 for n in hits.values())


def test_neighbours_all_one_vector(spark):
    rows = [(i, [float(i % 7 - 3), 2.0, 1.0]) for i in range(60)] + [(60, [1.0, 2.0])] + [(i, [0.5, 0.1, 0.2, 0.7]) for i in range(100, 500)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, d.where("vec_id % 20 = 0"), k=3).collect()
    found = {q: sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q) for q in (60, 100, 480)}
    assert found == {60: [], 100: [(1, 101), (2, 102), (3, 103)], 480: [(1, 100), (2, 101), (3, 102)]}
    assert sorted({r["query_id"] for r in got}) == [0, 20, 40, *range(100, 500, 20)]


# 7: packing


def test_pack(docs, rows, empty):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain, cap = Tokenizer.from_file(path), 64
    got = packing.pack(docs, path, capacity=cap).collect()
    by, places = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for d, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        mine = sorted(by[d], key=lambda r: r["piece"])
        cuts = [ids[a : a + cap] for a in range(0, len(ids), cap)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in mine] == [(k, k * cap, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)]
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= cap
    assert len(places) <= total / cap * 1.1 + 1
    assert packing.pack(empty, path).count() == 0


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_are_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([8, 40, 100])) for _ in range(rng.choice([1, 50, 700]))]
    plan, counts = packing.sweeps(Counter(lengths), 100), Counter(lengths)
    used = defaultdict(list)
    for n, c in counts.items():
        mine = sorted(p for p in plan if p[0] == n)
        assert mine[0][1] == 0
        for p, after in zip(mine, [*[q[1] for q in mine[1:]], c], strict=True):
            for rank in range(p[1], after):
                used[p[2] + rank - p[1]].append((p[4], n))
    for p in used.values():
        end = 0
        for offset, n in sorted(p):
            assert offset == end
            end += n
        assert end <= 100
    assert len(used) == best_fit(lengths, 100)


@pytest.mark.parametrize("text", ["Σίσυφος ΟΔΟΣ ς", "e\u0301 \u0301x", "don't 'S 's", "a\u00a0b\u2003c", "<|endoftext|> x<|startoftext|>", "日本語 テキスト 123", "\x01", "a\x01b", "😀👩‍👩‍👧 \ufeff", "  ", "İstanbul ŉ ß"])
def test_words_encode_as_texts(text):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    encoder = packing._encoder(path)
    ids, first = encoder.encode(pa.array([text, None, f"x {text}\n{text}"]))
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in (text, "", f"x {text}\n{text}")]
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want


# 8: languages


def speech(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


def test_langid(spark):
    rng = random.Random(4)
    stems = {"aa": ["ka", "mo", "tiri", "bu"], "bb": ["sch", "ung", "eit", "öl"], "cc": ["qui", "eau", "ré", "ille"]}
    rows = [(k, speech(rng, stems[lang], rng.randint(3, 60)), lang) for k, lang in enumerate(random.Random(1).choices(list(stems), k=400))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit("clash"))
    model = langid.fit(train.where(~langid.held_out(F.col("doc_id"))))
    assert model.languages == sorted(model.languages) and set(model.languages) == set(stems)
    odd = [(-1, None, "aa"), (-2, "123 !!", "aa"), (-3, "", None), (-4, "ЩЖЮЯ ФЫВА ЦУКЕ НГШЩ ЗХЪ " * 5, "bb"), (-5, "schung " * 20_000, "bb")]
    out = langid.predict(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"), model, into="guess")
    got = {r["doc_id"]: r for r in out.collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[d]["guess"]["lang"] == lang for d, _, lang in held) / len(held) > 0.95
    assert not any(got[d]["guess"]["rejected"] for d, *_ in rows)
    for d in (-1, -2, -3):
        assert tuple(got[d]["guess"]) == ("und", 0.0, True)
    assert got[-4]["guess"]["rejected"] and got[-4]["guess"]["lang"] in stems
    assert got[-5]["guess"]["lang"] == "bb" and 0 <= got[-5]["guess"]["score"] <= 1
    none = langid.fit(train.limit(0))
    assert {tuple(r["guess"]) for r in langid.predict(train.limit(5), none, into="guess").collect()} == {("und", 0.0, False)}


def brute_vector(text, idf):
    b = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in (text or "").lower().encode())
    count = Counter()
    factors = [int(f) for f in langid._FACTORS]
    for n in langid.GRAMS:
        for i in range(len(b) - n + 1):
            if b[i : i + n].strip(b" "):
                h = sum(x * f for x, f in zip(b[i : i + n], factors, strict=False)) % 2**64
                count[(h * factors[4]) % 2**64 >> 51] += 1
    v = {k: np.log1p(c) * float(idf[k]) for k, c in count.items()}
    size = sum(x * x for x in v.values()) ** 0.5
    return {k: x / size for k, x in v.items()}


def test_nearest_centroid(spark):
    rng = random.Random(6)
    stems = {"aa": ["ka", "mo", "tiri", "bu"], "bb": ["sch", "ung", "eit", "öl"]}
    rows = [(k, speech(rng, stems[lang], rng.randint(1, 40)).title(), lang) for k, lang in enumerate(random.Random(2).choices(list(stems), k=80))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    for r in langid.predict(d, model, into="guess").collect():
        v = brute_vector(r["text"], model.idf)
        near = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        assert r["guess"]["score"] == pytest.approx(max(near), abs=1e-4) and max(x for x, lang in zip(near, model.languages, strict=True) if lang == r["guess"]["lang"]) >= max(near) - 1e-4


def test_far_languages_are_rejected(spark):
    """An unlearned language of the same script and letters at random go, although a few such texts stand among the learned ones; learned languages stay."""
    rng = random.Random(7)
    stems = {"aa": ["ka", "mo", "tiri", "bu", "re", "na"], "bb": ["sch", "ung", "eit", "ber", "lich", "ge"], "cc": ["qui", "eau", "vre", "ille", "xon", "dor"]}
    text = lambda lang: speech(rng, stems[lang], rng.randint(2, 80))
    junk = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(20, 400)))
    rows = [(k, text(lang), lang) for k, lang in enumerate(random.Random(1).choices(["aa", "bb"], k=600))] + [(1000 + k, junk(), "aa") for k in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    fresh = [("known", text(rng.choice(["aa", "bb"]))) for _ in range(300)] + [("far", text("cc")) for _ in range(100)] + [("junk", junk()) for _ in range(100)]
    out = langid.predict(spark.createDataFrame(fresh, "kind string, text string"), model)
    gone = {r["kind"]: r["share"] for r in out.groupBy("kind").agg(F.avg(F.col("language.rejected").cast("int")).alias("share")).collect()}
    assert gone["known"] <= 0.01 and gone["far"] >= 0.8 and gone["junk"] >= 0.9


# 9: fingerprints


def brute_steps(b, window):
    out = []
    for i in range(len(b) - window + 1):
        s = sum(int(fingerprints._COST[c]) for c in Counter(b[i : i + window]).values())
        out.append(s * fingerprints.STEPS // (int(fingerprints._COST[window]) + 1))
    return out


@pytest.mark.parametrize("window", [64, 16])
def test_entropy_steps(window):
    rng = random.Random(1)
    b = bytes(rng.choice(b"aaab cde") for _ in range(500))
    assert fingerprints.steps(np.frombuffer(b, np.uint8), window).tolist() == brute_steps(b, window)


def brute_features(text, rank):
    b, out = text.encode(), set()
    for (window, area, popular, least, below), own in zip(fingerprints.SCALES, rank, strict=True):
        if least <= len(b) < below:
            r = [(int(own[s]), i) for i, s in enumerate(brute_steps(b, window))]
            noted = Counter(min(r[i : i + area])[1] for i in range(len(r)))
            out |= {b[i : i + window] for i, n in noted.items() if n >= popular}
    return out or {b}


def test_digests():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é\n") for _ in range(n)) for n in (0, 10, 70, 300, 600, 4000, 30_000)] + ["a" * 2000]
    rank = np.stack([np.random.default_rng(k).permutation(fingerprints.STEPS) for k in range(2)])
    filters, chain = fingerprints.digests(pa.array(texts + texts), rank)
    shown = fingerprints.strings(filters, chain)
    assert shown[: len(texts)] == shown[len(texts) :] and shown == [fingerprints.strings(*fingerprints.digests(pa.array([t]), rank))[0] for t in texts + texts]
    for t, n in zip(texts, np.diff(chain), strict=False):
        assert n == -(-len(brute_features(t, rank)) // fingerprints.FEATURES)
    same = fingerprints.likeness(filters, chain, filters, chain)
    assert np.allclose(same, 1)
    other = fingerprints.likeness(filters, chain, *fingerprints.digests(pa.array(texts[1:] + texts[:1] + texts[1:] + texts[:1]), rank))
    assert (other[3:6] < 0.2).all() and ((other >= 0) & (other <= 1)).all()


def test_half_edits_of_short_texts_are_near():
    rng = random.Random(5)
    rank = np.stack([np.arange(fingerprints.STEPS)] * 2)
    for n in (80, 150, 400, 900, 1500, 3000):
        texts = ["".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n)) for _ in range(30)]
        edited = [t[: n - n // 2] + u[: n // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
        own = fingerprints.digests(pa.array(texts), rank)
        near = fingerprints.likeness(*own, *fingerprints.digests(pa.array(edited), rank))
        far = fingerprints.likeness(*own, *fingerprints.digests(pa.array(texts[1:] + texts[:1]), rank))
        assert near.mean() > 0.35 and (near > 0).mean() > 0.9 and far.mean() < 0.1


def test_beside_next(spark, docs, rows, empty):
    rank = fingerprints.rarity(docs)
    got = {r["doc_id"]: r for r in fingerprints.compare_next(docs, rank).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for (d, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        assert got[d]["n_chars"] == len(t) and got[d]["edited"] == t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        one = lambda *x: fingerprints.digests(pa.array(x), rank)
        assert got[d]["fingerprint"] == fingerprints.strings(*one(t))[0] and got[d]["edited_fingerprint"] == fingerprints.strings(*one(got[d]["edited"]))[0]
        assert got[d]["near_edited"] == pytest.approx(fingerprints.likeness(*one(t), *one(got[d]["edited"]))[0])
        assert got[d]["near_next"] == pytest.approx(fingerprints.likeness(*one(t), *one(u))[0])
    assert fingerprints.compare_next(empty, rank).count() == 0
    single = fingerprints.compare_next(docs.where("doc_id = 1"), rank).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1
    twice = docs.where("doc_id < 10").union(docs.where("doc_id = 4"))
    assert fingerprints.compare_next(twice, rank).count() == 4 and fingerprints.digest(docs, rank).count() == len(rows)


# 10: shards


def test_shards(spark, docs, rows, empty):
    copies = spark.createDataFrame([(10_000 + i, "copy", None, None, 4, 1, "", 1, 1) for i in range(100)], SCHEMA)
    every = docs.union(copies)
    got = sharding.shard(every, shards=7, points=5).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) + 100 and set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    texts = {d: t for d, t, *_ in rows} | {10_000 + i: "copy" for i in range(100)}
    for r in got:
        b = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(b) + 16 and r["text_crc32"] == zlib.crc32(b)
    assert {r["doc_id"]: r["shard"] for r in got} == {r["doc_id"]: r["shard"] for r in sharding.shard(every.repartition(5), shards=7, points=5).collect()}
    assert sharding.shard(empty).count() == 0 and sharding.shard(docs.limit(3)).count() == 3


def clockwise(keys, shards, points, capacity):
    """Each key's shard: from its place on clockwise to the first node whose shard has room, nodes in turn, those that come from farther first."""
    nodes = sharding.ring(shards, points)
    left, waiting, out = list(capacity), [], {}
    by = defaultdict(list)
    for pos, key in sorted(keys):
        by[next((i for i, (p, _) in enumerate(nodes) if p >= pos), 0)].append((pos, key))
    for step in range(2 * len(nodes)):
        if step < len(nodes):
            waiting += sorted(by[step])
        shard = nodes[step % len(nodes)][1]
        while waiting and left[shard]:
            out[waiting.pop(0)[1]] = shard
            left[shard] -= 1
    return out


def test_shards_are_those_of_the_walk(spark, docs, rows):
    pos = {r[0]: r[1] for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 32)).collect()}
    for slack, shards in ((0, 7), (0.25, 7), (0.25, 8)):
        got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=shards, points=5, parts=1 << 20, slack=slack).collect()}
        total = int(len(rows) * (1 + slack))
        want = clockwise([(p, d) for d, p in pos.items()], shards, 5, [total // shards + (s < total % shards) for s in range(shards)])
        several = {p for p, n in Counter(pos.values()).items() if n > 1}  # equal texts go by the id's hash
        assert all(got[d] == want[d] for d in pos if pos[d] not in several)
        assert Counter(got.values()) == Counter(want.values())


def test_few_documents_move(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha1(F.col("id").cast("string")).alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(d, shards=n, slack=0.25).collect()} for n in (40, 41))
    assert sum(b[k] != s for k, s in a.items()) < 0.04 * len(a) and sum(b[k] not in (s, 40) for k, s in a.items()) < 0.01 * len(a)


def test_few_move():
    a, b = ([s for _, s in sharding.ring(n, 64)] for n in (40, 41))
    assert len(a) == 40 * 64 and [s for s in b if s != 40] == a


# kernels


def test_word_kernel():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t\n\x0b\x1cé\u2003") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", " "]
    hashes, first = textkit.word_hashes(pa.array(texts).slice(3))
    by = {}
    for t, a, b in zip(texts[3:], first, first[1:], strict=False):
        w = (t or "").encode().split()
        assert len(w) == b - a
        for x, h in zip(w, hashes[a:b].tolist(), strict=True):
            assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    assert hashlib.md5(hashes.tobytes()).hexdigest() == hashlib.md5(textkit.word_hashes(pa.array(texts[3:]))[0].tobytes()).hexdigest()


@pytest.mark.parametrize("n", [300, 500, 1000, 2000, 4000, 16384])
def test_neighbours_are_found_in_bands_of_any_size(n):
    v = np.random.default_rng(n).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index, ids, hits, asked = neighbours.Index(np.arange(n), v, 20), np.arange(n), 0, np.arange(0, n, max(20, n // 64))
    for q in np.array_split(asked, -(-len(asked) // 8)):
        for place, near, _ in index.search(ids[q], v[q]):
            score = v @ v[q[place]]
            score[q[place]] = -np.inf
            hits += len(set(np.argsort(-score, kind="stable")[:20].tolist()) & set(near.tolist()))
    assert hits >= 0.95 * 20 * len(asked)


def test_urls_of_very_many_labels(spark):
    hosts = ["x." * 100_000 + "net", "y" * 1_000_000 + ".net", "." * 50_000 + "org", "a.b.c.example.net"]
    pages = spark.createDataFrame([(k, f"http://{h}/en/p") for k, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("x.x.net", "/en/", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {0: ("x.x.net/en/", "allow"), 1: ("net/", "block"), 2: (None, "allow"), 3: ("example.net/en/", "allow")}


def test_many_url_rules_fill_the_filter_no_more(spark):
    rules = spark.range(200_000).selectExpr("concat('h', id, '.com') host", "'/' path", "'block' verdict")
    pages = spark.range(3000).selectExpr("id page_id", "concat('http://', if(id % 3 = 0, 'h', 'g'), id, '.com/x') url")
    out = urls.judge(pages, rules)
    assert {r.verdict: r["count"] for r in out.groupBy("verdict").count().collect()} == {"block": 1000, "allow": 2000}


def test_likeness_of_very_long_texts_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, (n, fingerprints.BITS // 64), dtype=np.uint64) for n in (2000, 1500))
    b[:700] = a[300:1000]
    tracemalloc.start()
    (got,) = fingerprints.likeness(a, np.array([0, 2000]), b, np.array([0, 1500]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got > 700 / 1500 and peak < 150e6  # all 3,000,000 pairs at once take 1.5 GB


def test_documents_without_an_id_draw_each(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) doc_id", "concat('w', id, ' a b c') text", "if(id % 2 = 0, 'a', 'b') source")
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.06 * r.target for r in got)


def test_langid_learns_from_every_document(spark):
    """A kind of text that few documents of a language have, none among those that k-means starts from, is learned as well."""
    rng = random.Random(6)
    common, rare = ["ka", "mo", "tiri", "bu"], ["zyx", "wvq", "jjg"]
    rows = [(k, speech(rng, common, 30), "aa") for k in range(150)] + [(k, speech(rng, rare, 30), "aa") for k in range(150, 190)] + [(k, speech(rng, ["sch", "ung", "eit"], 30), "bb") for k in range(190, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, more = (langid.fit(docs, sample=n, clusters=1) for n in (4, 8))
    # one centroid a language: the mean of all its documents, whatever the starts
    assert np.allclose(few.centroids, more.centroids, atol=1e-5) and np.allclose(few.floors, more.floors)
    texts = pa.array([t for _, t, lang in rows if lang == "aa"])
    mean = langid.vectors(texts, few.idf).astype(float).sum(axis=0)
    assert np.allclose(few.centroids[few.languages.index("aa")], mean / np.linalg.norm(mean), atol=1e-4)


def test_words_that_are_kept_take_little_memory():
    encoder = packing.WordEncoder(vocabulary("word_bpe_49k.json"))
    encoder.encode(pa.array([" ".join(f"word{k}x" for k in range(20_000))]))
    held = [encoder.known, encoder.starts, encoder.lengths, encoder.ids]
    assert len(encoder.known) == 20_000 and sum(a.nbytes for a in held) < 20_000 * 64


def test_cuts_of_a_text_are_as_near_as_if_cut():
    rng = np.random.default_rng(3)
    idf, c = rng.random(langid.SIZE).astype(np.float32), rng.random((3, langid.SIZE)).astype(np.float32)
    texts = ["", "a", "ab", "abc", "abcd", "é" * 9, "İß Σ日本語 x" * 5, "   ", "b" * 17, "zz 1 2 😀😀😀😀😀", "the cat sat on the mat " * 40]
    cut = pa.array([t[: 1 << k] for t in texts for k in range(2, langid.BINS) if 1 << (k - 1) < len(t)])
    _, length, near = langid.cut_similarities(pa.array(texts), idf, c)
    assert (length == langid.bins(cut)).all() and np.allclose(near, (langid.vectors(cut, idf) @ c.T).max(axis=1), atol=1e-4)
