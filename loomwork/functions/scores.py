"""Scores as columns: similarity, overlap, composites, judge replies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import answer_words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 to 1, rounded to 4 places; 0 if a vector is (nearly) zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms < 1e-9, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms)), 4))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it inside its own lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def exact_match(answer: Column, reference: Column) -> Column:
    """1 if both have something and the same words in the same order, else 0."""
    some = (F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.trim(F.coalesce(reference, F.lit(""))) != "")
    return F.when(some & (answer_words(answer) == answer_words(reference)), 1.0).otherwise(0.0)


def _numbered(words: Column) -> Column:
    """Each word with the number of its occurrence, so that a set of these is a multiset of words."""
    return bound(F.array_sort(words), lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit("\x1f"), (i - F.array_position(s, w)).cast("string"))))


def token_f1(answer: Column, reference: Column) -> Column:
    """F1 of the words of both, each counted as often as it occurs, rounded to 4 places."""

    def f1(x: Column) -> Column:
        common = F.size(F.array_intersect(x["a"], x["b"]))
        p, r = common / F.size(x["a"]), common / F.size(x["b"])
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0) | (common == 0), 0.0).otherwise(F.round(2 * p * r / (p + r), 4))

    return bound(F.struct(_numbered(answer_words(answer)).alias("a"), _numbered(answer_words(reference)).alias("b")), f1)


def weighted(components: dict[str, tuple[float, bool]], least: float) -> Column:
    """The mean of metric columns by weight over those that are there, each clamped to 0..1, times 100; null if too little weight is there."""
    value = lambda name, low: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1.0 - F.col(name)) if low else F.col(name)))
    total = reduce(lambda a, b: a + b, [F.coalesce(w * value(n, low), F.lit(0.0)) for n, (w, low) in components.items()])
    there = reduce(lambda a, b: a + b, [F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, (w, _) in components.items()])
    return F.when(there >= least, F.round(total / there * 100.0, 2))


def rag_composite() -> Column:
    return weighted(fixed.COMPOSITE, fixed.COMPOSITE_LEAST)


def answer_quality() -> Column:
    return weighted(fixed.QUALITY, fixed.QUALITY_LEAST)


def judge_score(reply: Column) -> Column:
    """SCORE=x or a bare number, if it is all there is and lies in 0..1; else null."""
    x = F.regexp_extract(F.trim(reply), r"(?i)^(?:score\s*=\s*)?([0-9]+(?:\.[0-9]+)?|\.[0-9]+)$", 1).try_cast("double")
    return F.when((x >= 0) & (x <= 1), x)


def judge_rating(reply: Column, allowed: tuple[int, ...] = (0, 1, 2)) -> Column:
    n = F.regexp_extract(F.trim(reply), r"(?i)^(?:rating\s*=\s*)?([0-9]+)$", 1).try_cast("int")
    return F.when(n.isin(*allowed), n)


def claim_labels(reply: Column, labels: tuple[str, ...] = ("supported", "unsupported", "contradicted"), key: str = "claim_id") -> Column:
    """{"labels": [{claim_id, label}]} as map<int, string>; null unless every item is well formed. JSON may stand inside other text."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\}|\[.*\])", 1)
    items = F.from_json(body, f"labels array<struct<{key}:int, label:string>>")["labels"]
    fine = F.forall(items, lambda x: x[key].isNotNull() & F.lower(F.trim(x["label"])).isin(*labels))
    last = F.aggregate(items, F.create_map().cast("map<int,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x[key]), F.create_map(x[key], F.lower(F.trim(x["label"])))))
    return F.when(F.coalesce(fine, F.lit(False)), last)


def contexts(text: Column) -> Column:
    """A JSON list of texts, else blocks between blank lines or ---; blank ones dropped."""
    listed = F.from_json(text, "array<string>")
    blocks = F.split(F.coalesce(text, F.lit("")), r"\n\s*(?:---+\s*)?\n")
    return F.filter(F.transform(F.coalesce(listed, blocks), lambda x: F.trim(x)), lambda x: (x != "") & x.isNotNull())


def average_precision(flags: Column) -> Column:
    """Of ranked relevance flags: mean precision at the relevant ones, rounded to 4 places; 0 if none is relevant, null if there are no flags."""
    start = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))
    step = lambda s, f: F.struct((s["rank"] + 1).alias("rank"), (s["hits"] + f.cast("int")).alias("hits"), (s["sum"] + F.when(f, (s["hits"] + 1) / (s["rank"] + 1)).otherwise(0.0)).alias("sum"))
    done = lambda s: F.when(s["hits"] > 0, F.round(s["sum"] / s["hits"], 4)).otherwise(0.0)
    return F.when(F.size(flags) > 0, F.aggregate(flags, start, step, done))
