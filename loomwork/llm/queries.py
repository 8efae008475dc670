"""The registered queries of the numbered operators and their SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, lexical, merkle, mixing, neardup, neighbours, packing, sharding, substrings, tokenfiles, urls
from .common import shared_dir, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), size=3, percent=90)


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x WHERE r.c < e.y)
SELECT r.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY ALL
"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_chats(chats, vocabulary("byte_bpe_50k.json"))

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read_back(formatted: pd.Series, loss: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        rows = []
        for text, m, at in zip(formatted, loss, offsets, strict=True):
            turns = chat.parse(text)
            under = chat.covered(text, np.asarray(at).reshape(-1, 2), np.asarray(m, dtype=bool))
            told = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return out.select("conv_id", read_back("formatted", "loss", "offsets").alias("r")).select("conv_id", "r.*")


OP2_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
x AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length('<|im_start|><|im_sep|><|im_end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM x
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w,
  2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW up AS (ORDER BY cap / w, source IS NULL, source)),
m AS (SELECT max(level) FILTER (WHERE level <= cap / w) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN m.level IS NULL THEN cap ELSE least(cap, m.level * w) END AS target FROM l, m),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate)
  + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), listed)


OP4_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, s, v)),
b AS (SELECT host, path, max_by(struct_pack(rule := h || s, v := v), length(h || s)) AS best FROM (SELECT DISTINCT host, path FROM q) AS u
  JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY host, path)
SELECT page_id, q.host, q.path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM q LEFT JOIN b ON q.host = b.host AND q.path = b.path
"""


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    plain = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", plain), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM v),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS o FROM g),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM o, range(20) AS r(k) WHERE o > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d),
y AS (SELECT x.doc_id, x.i, x.w, c.i IS NOT NULL AS gone FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i),
z AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z ON z.doc_id = d.doc_id
"""


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"))
    out = langid.predict(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fingerprints.compare_next(docs, fingerprints.rarity(docs))
    return out.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/loomwork/tokens-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    out = tokenfiles.read(spark, path)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical.ranked_search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("query", "item_id")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY t, docs),
s AS (SELECT item_id, r, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score FROM q JOIN f ON f.t = q.t JOIN w ON w.t = q.t, c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf([F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in fields])
    out = merkle.manifest(table(spark, sf_dir, "documents"), fields, also={"claimed": F.when(hit, changed)})
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(text) || ':' || text, '-') AS z,
  list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1)))),
    lambda c, b: list_reduce(list_prepend(xor(c::BIGINT, b::BIGINT), range(8)), lambda y, r: xor(y >> 1, (y & 1) * 3988292384))) AS crc FROM documents),
d AS (SELECT doc_id, lang, n_chars, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
  sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) AS changed, xor(crc, 4294967295) % 7 = 0 AS hit FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
t(k, g, i, h) AS (SELECT 0, g, i, leaf FROM o UNION ALL
  SELECT k + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM t) WHERE c > 1 GROUP BY k, g, i // 2),
s AS (SELECT g, max(k) AS k FROM t GROUP BY g),
r AS (SELECT t.g, t.k, t.h FROM t JOIN s ON s.g = t.g AND s.k = t.k),
u(k, i, h) AS (SELECT 0, g, h FROM r UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY k, i // 2),
top AS (SELECT max(k) AS k, max_by(h, k) AS root FROM u),
w(doc_id, leaf, g, i, step, now, told) AS (
  SELECT doc_id, leaf, o.g, CASE WHEN s.k = 0 THEN o.g ELSE i END, 0, CASE WHEN hit AND n_chars IS NOT NULL THEN changed ELSE leaf END, '' FROM o JOIN s ON s.g = o.g UNION ALL
  SELECT w.doc_id, w.leaf, w.g, CASE WHEN step + 1 = s.k THEN w.g ELSE w.i // 2 END, step + 1,
    sha256(CASE WHEN w.i % 2 = 1 THEN coalesce(n.h, m.h, '') || now ELSE now || coalesce(n.h, m.h, '') END), told || coalesce(n.h, m.h, '')
  FROM w JOIN s ON s.g = w.g CROSS JOIN top LEFT JOIN t n ON step < s.k AND n.g = w.g AND n.k = step AND n.i = xor(w.i, 1)
  LEFT JOIN u m ON step >= s.k AND m.k = step - s.k AND m.i = xor(w.i, 1) WHERE step < s.k + top.k)
SELECT doc_id, leaf, r.h AS subroot, root, sha256(told) AS proof_sha256, now AS folded_root, now = root AS verified
FROM w JOIN r ON r.g = w.g CROSS JOIN top WHERE step = r.k + top.k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_duplicates, op2_chat, op3_mixing, op4_url_filter, op5_substrings, op6_neighbours, op7_packing, op8_language_id, op9_fingerprints, op10_sharding, op11_token_files, op12_lexical_search, op13_merkle)}
SQL: dict[str, str] = {"op1_near_duplicates": OP1_SQL, "op2_chat": OP2_SQL, "op5_substrings": OP5_SQL, "op3_mixing": OP3_SQL, "op4_url_filter": OP4_SQL, "op12_lexical_search": OP12_SQL, "op13_merkle": OP13_SQL}
