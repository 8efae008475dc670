"""Ranking chunks for many questions at once: lexical by an inverted index, dense by cosine, rank fusion, boosts, selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..settings import Settings
from ..tables import written


def frequencies(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, df: in how many chunks each token occurs."""
    return chunks.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, df, idf: ln((1 + N) / (1 + df)) + 1."""
    n = chunks.agg(F.count("*").alias("n"))  # one row
    return frequencies(chunks, tokens).join(F.broadcast(n)).select("token", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def ranked(scores: DataFrame, keys: Sequence[str], score: str, chunk: str = "chunk_id", rank: str = "rank", limit: int | None = None) -> DataFrame:
    """Ranks by score within keys, ties by chunk; with a limit the top-k is cut before the shuffle."""
    out = scores.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), chunk)))
    return out.where(F.col(rank) <= limit) if limit else out


#: Postings that a question's rarest tokens are read for until their candidates tell a threshold, and room for rounding in comparisons of scores.
SEEDS, SLACK = 1000, 1e-5
#: Rows that a part of a search holds at most, by measured count; question texts of a block and chunks that a lexical search scores at once.
PART_ROWS, BLOCK, STEP = 20_000, 256, 1000
BONUS = {"company": 2.5, "sheet": 0.5}


class Lexical:
    """The tables of a lexical search whose lists are read by bounds. Each is written once.

    postings: term, chunk_id for the tokens that questions ask for (term: a token's number). terms: a row per question text and token, the rarest first: place, idf, df, rest (the
    idf of this token and all after it) and essential. A posting's gain is its token's idf, so a list's bound is exact for each of its blocks: a chunk whose rarest shared token is
    at some place scores rest at most (and the bonus). The k-th best sum over the rarest tokens, SEEDS postings of them, is a threshold that the k best reach; tokens
    whose rest falls short of it are not essential, and their lists are only looked up for candidates.
    """

    def __init__(self, questions: DataFrame, chunks: DataFrame, k: int, bonus: float, slack: float = SLACK):
        self.k, self.bonus, self.slack = k, bonus, slack
        asked = questions.select("q_id", "question").distinct().withColumn("qk", F.xxhash64(F.to_json(F.struct("q_id", "question"))))
        self.asked = written(asked, "lexical-asked")
        tokens = self.asked.select("qk", "q_id", F.explode(text.tokens(F.col("question"))).alias("token"))
        numbers = written(tokens.select("token").distinct().withColumn("term", F.monotonically_increasing_id()), "lexical-tokens")
        listed = chunks.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("token"))
        self.postings = written(listed.join(numbers, "token").select("term", "chunk_id"), "lexical-postings")
        self.chunks = n = chunks.count()
        lists = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        lists = lists.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
        order = Window.partitionBy("qk").orderBy(F.desc("idf"), "token")
        terms = tokens.join(numbers, "token").join(lists, "term").select(
            "qk", "q_id", "token", "term", "df", "idf", F.row_number().over(order).alias("place"),
            F.sum("idf").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"), F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        )
        terms = written(terms, "lexical-terms")
        seeds = terms.where(F.col("_before") < max(SEEDS, 20 * k)).join(self.postings, "term").groupBy("qk", "q_id", "chunk_id").agg(F.sum("idf").alias("s"))
        kth = seeds.withColumn("_at", F.row_number().over(Window.partitionBy("qk").orderBy(F.desc("s")))).where(F.col("_at") == k)
        # the best of a question's texts counts, so the largest of their thresholds holds for all
        threshold = kth.groupBy("q_id").agg((F.max("s") - slack).alias("threshold"))
        terms = terms.drop("_before").join(threshold, "q_id", "left").withColumn("essential", F.col("threshold").isNull() | (F.col("rest") + bonus >= F.col("threshold")))
        self.terms = written(terms, "lexical-terms")

    def reads(self) -> DataFrame:
        """q_id, postings of its tokens, read (those of the essential ones)."""
        return self.terms.groupBy("q_id").agg(F.sum("df").alias("postings"), F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).alias("read"))

    def scores(self) -> DataFrame:
        """qk, q_id, chunk_id, s of every chunk that may be among the k best.

        Chunks lie in parts of about PART_ROWS with all their postings, question texts in blocks of about BLOCK; each pair of a part and a block is scored by itself, and only
        what may be among the part's k best leaves it, so nothing is shuffled for each pair of a question and a chunk.
        """
        spark = self.postings.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.chunks // PART_ROWS))
        blocks = max(1, -(-self.asked.count() // BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
        held = self.postings.groupBy("chunk_id").agg(F.collect_list("term").alias("terms")).withColumn("part", of("chunk_id", parts)).withColumn("block", every(blocks))
        asked = self.terms.select("qk", "term", "idf", "essential", "threshold").withColumn("block", of("qk", blocks)).withColumn("part", every(parts))
        kind = held.schema["chunk_id"].dataType.simpleString()
        k, bonus, slack = self.k, self.bonus, self.slack

        def best(mine: pa.Table, asking: pa.Table) -> pa.Table:
            return _part_best(mine, asking, k, bonus, slack)

        found = held.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(best, f"qk long, chunk_id {kind}, s double")
        return found.join(self.asked.select("qk", "q_id"), "qk").select("qk", "q_id", "chunk_id", "s")


def _part_best(mine: pa.Table, asking: pa.Table, k: int, bonus: float, slack: float) -> pa.Table:
    """qk, chunk_id, s: of each question text of a block (qk, term, idf, essential, threshold) the chunks of a part (chunk_id, terms) that may be among its k best.

    Lists of essential terms give the candidates, the others are read for these alone.
    """
    plain = lambda c: asking.column(c).to_numpy()
    texts, text_at = np.unique(plain("qk"), return_inverse=True)
    order = np.argsort(plain("term"), kind="stable")
    term, text_at, idf, essential = plain("term")[order], text_at[order], plain("idf")[order], plain("essential").astype(bool)[order]
    least = np.full(len(texts), -np.inf)
    known = ~np.isnan(limit := plain("threshold").astype(float)[order])
    least[text_at[known]] = limit[known]
    late = np.bincount(text_at, weights=np.where(essential, 0.0, idf), minlength=len(texts))
    column = mine.column("terms").combine_chunks()
    ends, flat = np.diff(column.offsets.to_numpy()).cumsum(), column.flatten().to_numpy()
    out = []
    for first in range(0, len(column) if len(texts) else 0, STEP):
        last = min(first + STEP, len(column))
        begin = ends[first - 1] if first else 0
        own, n = flat[begin : ends[last - 1]], np.diff(ends[first:last], prepend=begin)
        a, b = np.searchsorted(term, own), np.searchsorted(term, own, side="right")
        size = b - a
        at = np.repeat(a - (size.cumsum() - size), size) + np.arange(size.sum())  # of each posting, the texts that ask for it
        cell = np.repeat(np.repeat(np.arange(last - first), n), size) * len(texts) + text_at[at]
        sums = lambda take: np.bincount(cell[take], weights=idf[at[take]], minlength=(last - first) * len(texts))  # noqa: E731, B023
        need = essential[at]
        s = sums(need)
        open_ = (s > 0).reshape(-1, len(texts)) & (s.reshape(-1, len(texts)) + late + bonus >= least)
        s = (s + sums(~need & open_.ravel()[cell])).reshape(-1, len(texts))
        out.append(_kept(*np.nonzero(open_), s, first, k, bonus + slack))
    chunk, which, s = (np.concatenate([o[j] for o in out] or [np.zeros(0, float if j == 2 else np.int64)]) for j in range(3))
    # the k-th best of the part, text by text
    order = np.lexsort((-s, which))
    chunk, which, s = chunk[order], which[order], s[order]
    begin = np.searchsorted(which, which)
    kth = np.where(begin + k - 1 < np.searchsorted(which, which, side="right"), s[np.minimum(begin + k - 1, len(s) - 1)], -np.inf)
    keep = s >= kth - bonus - slack
    return pa.table({"qk": pa.array(texts[which[keep]], pa.int64()), "chunk_id": mine.column("chunk_id").take(pa.array(chunk[keep])), "s": pa.array(s[keep], pa.float64())})


def _kept(row: np.ndarray, which: np.ndarray, s: np.ndarray, first: int, k: int, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, text, score) of the open cells but those that k chunks of the step exceed by more than room."""
    value = s[row, which]
    if len(s) > k:
        only = np.full(s.shape, -np.inf)
        only[row, which] = value
        near = value >= np.partition(only, len(s) - k, axis=0)[len(s) - k][which] - room
        row, which, value = row[near], which[near], value[near]
    return row + first, which, value


def lexical(questions: DataFrame, chunks: DataFrame, k: int = 30, company: str | None = None, sheet: str | None = None, digits: int | None = None) -> DataFrame:
    """q_id, chunk_id, lexical_score, lexical_rank: the sum of the idf of shared tokens, + 2.5 if the question names the chunk's company and + 0.5 for its sheet.

    questions (q_id, question, perhaps several rows per q_id: the best counts), chunks (chunk_id, tokens). Exact: only chunks that share a token and
    may be among the k best are scored (Lexical). digits: scores are rounded before they are ranked.
    """
    named = [(c, w) for c, w in ((company, BONUS["company"]), (sheet, BONUS["sheet"])) if c]
    most = float(sum(w for _, w in named))
    index = Lexical(questions, chunks, k, most, SLACK if digits is None else max(SLACK, 2 * 10.0**-digits))
    scores = index.scores()
    if named:
        scores = scores.join(chunks.select("chunk_id", *[c for c, _ in named]), "chunk_id").join(index.asked.select("qk", "question"), "qk")
        padded = F.concat(F.lit(" "), text.normalized(F.col("question")), F.lit(" "))
        for c, w in named:
            name = text.normalized(F.col(c))
            scores = scores.withColumn("s", F.col("s") + F.when((name != "") & F.contains(padded, F.concat(F.lit(" "), name, F.lit(" "))), w).otherwise(0.0))
    best = scores.groupBy("q_id", "chunk_id").agg((F.max("s") if digits is None else F.round(F.max("s"), digits)).alias("lexical_score")).where("lexical_score > 0")
    return ranked(best, ["q_id"], "lexical_score", rank="lexical_rank", limit=k)


def dense(queries: DataFrame, chunks: DataFrame, k: int = 30, *, query: Sequence[str] = ("q_id",), vector: str = "embedding", chunk: str = "chunk_id", parts: int | None = None, digits: int | None = None) -> DataFrame:
    """Exact top k by cosine: the query columns, chunk_id, dense_score, dense_rank. Zero vectors score 0. digits: scores are rounded before they are ranked.

    Queries are stated, not all pairs: they go in blocks to parts of the chunks (about PART_ROWS rows each, if there are
    more than the shuffle partitions take), each part keeps its own top k by one matrix product a block, and these are merged.
    """
    spark = chunks.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // PART_ROWS))
    left = chunks.select(F.col(chunk).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v")).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts).cast("long")))
    right = queries.select(F.to_json(F.struct(*query), {"ignoreNullFields": "false"}).alias("q"), F.col(vector).cast("array<double>").alias("v")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    kind = queries.select(*query).schema.simpleString()
    found = part_scores(left, right, k, digits).withColumn("q", F.from_json("q", kind)).select("q.*", "chunk_id", "dense_score")
    return ranked(found, list(query), "dense_score", rank="dense_rank", limit=k)


def rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    """Scores from 0 on, rounded once and halves up, as SQL does."""
    scale = 10.0**digits
    whole = np.floor(scores * scale)
    return (whole + (scores * scale - whole >= 0.5)) / scale


def part_scores(left: DataFrame, right: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """q, chunk_id, dense_score: the k best chunks of each part (chunk_id, v, part) for each query (q, v, part) of the part, by cosine clipped to 0 and 1 and rounded to digits
    (12, so that the products' rounding parts no equal vectors, if there are none), ties by chunk_id. One matrix product a block of queries; zero vectors score 0."""
    id_kind = left.schema["chunk_id"].dataType.simpleString()

    def unit(column: pd.Series) -> np.ndarray:
        m = np.array(column.to_list(), dtype=float).reshape(len(column), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 1e-12)

    def best(_, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(asked):
            mine = mine.sort_values("chunk_id", kind="stable")
            m, ids = unit(mine["v"]), mine["chunk_id"].to_numpy()
            for s in range(0, len(asked), 256):
                block = asked.iloc[s : s + 256]
                score = rounded(np.clip(unit(block["v"]) @ m.T, 0, 1), 12 if digits is None else digits)
                first = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out += [pd.DataFrame({"q": [q] * len(f), "chunk_id": ids[f], "dense_score": row[f]}) for q, f, row in zip(block["q"], first, score, strict=True)]
        return pd.concat(out) if out else pd.DataFrame({"q": [], "chunk_id": mine["chunk_id"][:0], "dense_score": []}).astype({"q": object, "dense_score": float})

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(best, f"q string, chunk_id {id_kind}, dense_score double")


def fused_queries(hits: DataFrame, k: int = 30, rrf: int = 60) -> DataFrame:
    """Several dense queries of one question: the sum of 1 / (rrf + rank), ranked again; the raw score is the best one."""
    out = hits.groupBy("q_id", "chunk_id").agg(F.sum(1.0 / (F.lit(rrf) + F.col("dense_rank"))).alias("rrf_score"), F.max("dense_score").alias("dense_score"))
    return ranked(out, ["q_id"], "rrf_score", rank="dense_rank", limit=k)


def fused(dense_hits: DataFrame, lexical_hits: DataFrame, *, rrf: int = 60, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """The union of both lists with weight / (rrf + rank) from each (a missing side adds 0): q_id, chunk_id, both scores, final_score."""
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(rrf) + F.col(r)), F.lit(0.0))
    both = dense_hits.select("q_id", "chunk_id", "dense_score", "dense_rank").join(lexical_hits.select("q_id", "chunk_id", "lexical_score", "lexical_rank"), ["q_id", "chunk_id"], "full_outer")
    return both.select("q_id", "chunk_id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), (part(dense_weight, "dense_rank") + part(lexical_weight, "lexical_rank")).alias("final_score"))


_LINKING = fixed.RELATIONSHIP


def boost(question: str = "question", role_terms: Sequence[str] = ()) -> Column:
    """What metadata that the question names adds to a candidate's score (fixed values: the weights and trigger words)."""
    q = text.normalized(F.col(question))
    n = lambda c: text.normalized(F.coalesce(F.col(c), F.lit("")))
    named = lambda c, w: F.when((n(c) != "") & F.contains(q, n(c)), w).otherwise(0.0)
    shared = lambda c: F.size(F.array_intersect(text.tokens(q), text.tokens(n(c))))
    linking, theme = text.contains_any(q, _LINKING), F.col("chunk_type") == "supply_chain_theme"
    when = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    role = F.lit(False)
    for t in role_terms:
        role = role | (F.contains(q, F.lit(t)) & F.contains(n("ev_supply_chain_role"), F.lit(t)))
    summary = F.col("chunk_type") == "derived_analytic_summary"
    return (
        named("company", 0.04) + named("category", 0.04) + named("state", 0.03) + named("location", 0.025) + when(role, 0.05)
        + when(shared("product_service") >= 2, 0.015)
        + when(F.contains(q, F.lit("employment")) & (F.col("chunk_type") == "location_theme"), 0.01)
        + when(theme & text.contains_any(q, ("oem", "hyundai", "kia", "rivian", "mercedes")), 0.015)
        + when(linking & theme, 0.03) + when(linking & (n("primary_oems") != ""), 0.025) + when(linking & (n("category") == "oem"), 0.02)
        + when(linking & F.contains(q, F.lit("within the state")) & (n("location") != ""), 0.01)
        + when((F.col("chunk_type") == "note_reference") & text.contains_any(q, ("define", "definition", "methodology")), 0.03)
        + when(summary, F.least(F.lit(0.06), 0.012 * shared("analysis_title")) + F.least(F.lit(0.04), 0.01 * shared("analysis_type")))
        + when(summary & text.contains_any(q, ("highest", "lowest", "compare", "versus", "vs", "concentration", "cluster", "density", "county")), 0.03)
    )


def reranked(hits: DataFrame, model_score: str | None, *, weight: float = 1.0, rrf: int = 60, top: int = 20) -> DataFrame:
    """Adds weight / (rrf + rank by the model's score) to the first top candidates that it scored; no model: as they are."""
    if not model_score:
        return hits
    hits = ranked(hits, ["q_id"], "final_score", rank="_at")
    scored = F.when((F.col("_at") <= top) & F.col(model_score).isNotNull(), F.col(model_score))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc_nulls_last(scored), "chunk_id"))
    return hits.withColumn("_place", place).withColumn("final_score", F.col("final_score") + F.when(scored.isNotNull(), F.lit(weight) / (F.lit(rrf) + F.col("_place"))).otherwise(0.0)).drop("_at", "_place")


def capped(hits: DataFrame, group: str, cap: int, limit: int, *, score: str = "final_score", priority: str | None = None) -> DataFrame:
    """Per question: the best of each chunk, at most cap of each (non-blank) group, limit in all; rank from 1. Priority comes before score."""
    order = ([F.desc(priority)] if priority else []) + [F.desc(score), F.col("chunk_id")]
    one = hits.withColumn("_n", F.row_number().over(Window.partitionBy("q_id", "chunk_id").orderBy(*order))).where("_n = 1")
    one = one.withColumn("_n", F.row_number().over(Window.partitionBy("q_id", group).orderBy(*order)))
    one = one.where((F.col("_n") <= cap) | F.coalesce(F.trim(group) == "", F.lit(True)))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).where(F.col("rank") <= limit).drop("_n")


def company_cap(question: Column, cap: int, broad: Column) -> Column:
    """How many chunks of a company may be selected: at least 4 for broad and relationship questions, 3 for those about places and repeated records."""
    padded = F.concat(F.lit(" "), text.normalized(question), F.lit(" "))
    places = F.lit(False)
    for term in fixed.PLACES:
        places = places | F.contains(padded, F.lit(f" {term} "))
    return F.when(broad, F.greatest(F.lit(cap), F.lit(4))).when(places, F.greatest(F.lit(cap), F.lit(3))).otherwise(cap)


def select(hits: DataFrame, *, cap: int | Column = 4, limit: int = 12) -> DataFrame:
    """Context for each question: pinned summaries first; then, each row_key once, summaries of other states than the question's left out where its own state has one, at most cap of a company, limit in all.

    hits: q_id, chunk_id, row_key, company, state, chunk_type, analysis_type, question_state, final_score, priority.
    """
    kind = F.col("chunk_type")
    pinned = kind == "structured_match_summary"
    order = [F.desc("priority"), F.desc("final_score"), F.col("chunk_id")]
    key = F.coalesce(F.nullif(F.col("row_key"), F.lit("")), F.col("chunk_id"))
    rest = hits.where(~pinned).withColumn("_n", F.row_number().over(Window.partitionBy("q_id", key).orderBy(*order))).where("_n = 1")
    own = F.max(F.when((kind == "derived_analytic_summary") & (F.col("state") == F.col("question_state")), 1).otherwise(0)).over(Window.partitionBy("q_id", "analysis_type"))
    rest = rest.withColumn("_own", own).where((kind != "derived_analytic_summary") | (F.col("_own") == 0) | (F.col("state") == F.col("question_state")))
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy("q_id", "company").orderBy(*order))).where((F.col("_n") <= cap) | (F.coalesce(F.col("company"), F.lit("")) == ""))
    both = hits.where(pinned).withColumn("_pin", F.lit(0)).unionByName(rest.drop("_n", "_own").withColumn("_pin", F.lit(1)))
    place = Window.partitionBy("q_id").orderBy("_pin", *order)
    return both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit).drop("_pin")


def retrieve(questions: DataFrame, chunks: DataFrame, *, k: int = 30, limit: int = 12, cap: int = 4, rrf: int = 60, settings: Settings | None = None) -> DataFrame:
    """Hybrid retrieval for all questions: questions (q_id, question, embedding), chunks (chunk_id, tokens, embedding, company). settings: theirs instead of the other arguments, with the weights of both lists."""
    weights = {}
    if settings:
        k, limit, cap, rrf = settings.dense_top_k, settings.final_top_k, settings.company_cap, settings.rrf_k
        weights = {"dense_weight": settings.dense_weight, "lexical_weight": settings.lexical_weight}
    hits = fused(dense(questions, chunks, k), lexical(questions, chunks, k), rrf=rrf, **weights)
    return capped(hits.join(chunks.select("chunk_id", "company"), "chunk_id"), "company", cap, limit)


def focused(question: Column, most: int = 12) -> Column:
    """The question's first words without the usual ones, joined: a second dense query."""
    words = F.array_except(text.tokens(question), F.array(*map(F.lit, fixed.STOPWORDS)))
    return F.array_join(F.slice(words, 1, most), " ")
