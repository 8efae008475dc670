"""URL filters: rules on hosts and paths, found by a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, may_hold, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or # or the end. Null or no ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


#: Rules that share a block of the filter, and the most blocks (of 8 bytes) that it has.
BLOCK_RULES, MOST_BLOCKS = 4, 1 << 20


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *, blocks: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    rules (host, path, verdict) are canonical: lower-case host, path from the first /. A rule fits its host
    and all subdomains if the page's path starts with the rule's. The longest fitting host + path wins, of
    equally long ones that with the longer host, then the lesser verdict; repeated rules count once, rules
    with a null do not count. No fitting rule: rule null, verdict allow. Null url: empty host and path.

    A page's possible rules are the host's suffixes of as many labels as rules have, with the path's prefixes of the lengths that
    rules have, so a host of any number of labels has a few. One scan of the pages tries these with the filter (a row of blocks of 64 bits, one for every BLOCK_RULES rules up to
    MOST_BLOCKS, so its size is bounded; false positives stay below 1 in 100 up to some 4 million rules and grow beyond). Pages without possible hits go
    no further. The others' distinct (host, path) meet the rules in an exact hash join, which removes false positives;
    it and the join back to these pages are left to adaptive execution: small measured sides are broadcast, hot hosts are split.
    """
    host, path = parts(F.col(url_col))
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    labels = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) + 1
    rules = written(rules.select(F.concat("host", "path").alias("_key"), F.length("host").alias("_host_n"), labels("host").alias("_labels"), "verdict"), "rules")
    if blocks is None:
        blocks = min(MOST_BLOCKS, 1 << max(6, (rules.count() // BLOCK_RULES).bit_length()))
    known = lambda c: F.array_sort(F.collect_set(c))
    lengths = rules.agg(known(F.length("_key") - F.col("_host_n")).alias("_lengths"), known(F.col("_labels")).alias("_depths"))
    sieve = written(bloom(rules, "_key", blocks).crossJoin(lengths), "sieve")  # one row
    rules = rules.drop("_labels")

    suffixes = F.transform(F.filter("_depths", lambda n: n <= labels(F.col("host"))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    starts = F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.struct(F.concat(h, p).alias("key"), F.length(h).alias("host_n")))))
    possible = F.filter(keys, lambda k: may_hold(F.col("_bloom"), k["key"], blocks))
    seen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).join(F.broadcast(sieve))
    seen = seen.select("page_id", "host", "path", F.when(F.col("host") != "", possible).otherwise(F.array().cast("array<struct<key:string,host_n:int>>")).alias("_possible"))
    seen = written(seen, "pages-seen")

    tried = seen.where(F.size("_possible") > 0).groupBy("host", "path").agg(F.first("_possible").alias("_possible")).select("host", "path", F.explode("_possible").alias("_k"))
    hits = tried.join(rules, (F.col("_k.key") == rules["_key"]) & (F.col("_k.host_n") == rules["_host_n"]))
    order = F.struct(F.length("_key").alias("n"), F.col("_host_n").alias("host_n"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.col("_key").alias("rule"), "verdict"), order).alias("_best"))
    shown = ["page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict")]
    none = F.lit(None).cast("struct<rule:string,verdict:string>").alias("_best")
    missed = seen.where(F.size("_possible") == 0).select("page_id", "host", "path", none).select(*shown)
    return seen.where(F.size("_possible") > 0).drop("_possible").join(best, ["host", "path"], "left").select(*shown).unionByName(missed)
