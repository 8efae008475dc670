"""Documents of a folder tree, with a manifest's titles and addresses; what can't be read is listed, not raised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text

#: Manifest columns that name a file, and those of its title, address and date.
MANIFEST = {"key": ("filepath", "file_path", "filename", "local_filename", "saved_as", "basename"), "title": ("title", "name"), "url": ("url", "source_url"), "retrieved_at": ("retrieved_at", "downloaded_at")}


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """key, title, url, retrieved_at from every *manifest*.csv under root; of a key's rows the last file's, last row's non-blank values count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*manifest*.csv").load(root)
    lines = files.select("path", F.split(F.decode("content", "UTF-8"), r"\r?\n").alias("l"))
    names = F.transform(F.split(F.lower(F.get("l", F.lit(0))), ","), lambda c: F.btrim(F.trim(c), F.lit('"')))
    rows = lines.select("path", names.alias("names"), F.posexplode("l").alias("at", "line")).where("at > 0 and trim(line) <> ''")
    cells = F.transform(F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.btrim(F.trim(c), F.lit('"')))
    rows = rows.select("path", "at", F.map_from_entries(F.arrays_zip(F.slice("names", 1, F.least(F.size("names"), F.size(cells))).alias("k"), F.slice(cells, F.lit(1), F.least(F.size("names"), F.size(cells))).alias("v"))).alias("m"))
    get = lambda k: F.coalesce(*[F.nullif(F.try_element_at("m", F.lit(c)), F.lit("")) for c in MANIFEST[k]])
    rows = rows.select("path", "at", *[get(k).alias(k) for k in MANIFEST]).where("key is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("path", "at"))).alias(c)
    return rows.groupBy("key").agg(*[last(c) for c in ("title", "url", "retrieved_at")])


def load_documents(spark: SparkSession, root: str, source_type: str = "offline") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): filepath (relative), canonical_source, source_type, text, title, url, retrieved_at; and filepath, reason.

    Text and Markdown are taken as they are, HTML by its main part; other suffixes, PDF among them (no reader is
    installed) and blank files are rejects. A manifest row by relative path overrides one by file name, value by value.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    base = root.replace("file://", "").rstrip("/")
    rel = F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 100_000)).otherwise(path)
    rows = files.select(rel.alias("filepath"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content").where(~F.lower("filepath").rlike(r"manifest[^/]*\.csv$"))
    body, html = F.decode("content", "UTF-8"), F.col("suffix").isin(".html", ".htm")
    rows = rows.withColumn("raw", F.when(F.col("suffix").isin(*fixed.DOCUMENT_SUFFIXES) & (F.col("suffix") != ".pdf"), body)).drop("content")
    rows = rows.withColumns({"text": F.when(html, text.html_text(F.col("raw"))).otherwise(text.document_text(F.col("raw"))), "own_title": F.when(html, text.html_title(F.col("raw"))), "own_url": F.when(html, text.html_url(F.col("raw")))})
    reason = F.when(~F.col("suffix").isin(*fixed.DOCUMENT_SUFFIXES), "unsupported suffix").when(F.col("suffix") == ".pdf", "no reader for pdf").when(F.coalesce("text", F.lit("")) == "", "no text")
    rows = rows.withColumn("reason", reason)
    named = manifest(spark, root)
    side = lambda p: named.select(*[F.col(c).alias(f"{p}_{c}") for c in named.columns])
    good = rows.where("reason is null").withColumn("_base", F.regexp_extract("filepath", r"([^/]+)$", 1))
    good = good.join(side("rel"), F.col("filepath") == F.col("rel_key"), "left").join(side("base"), F.col("_base") == F.col("base_key"), "left")
    stem = F.initcap(F.trim(F.regexp_replace(F.regexp_replace("_base", r"\.[^.]+$", ""), r"[_\-]+", " ")))
    url = F.coalesce("rel_url", "base_url", "own_url")
    out = good.select("filepath", F.coalesce(url, F.col("filepath")).alias("canonical_source"), F.lit(source_type).alias("source_type"), "text", F.coalesce("rel_title", "base_title", "own_title", stem).alias("title"), url.alias("url"), F.coalesce("rel_retrieved_at", "base_retrieved_at").alias("retrieved_at"))
    return out, rows.where("reason is not null").select("filepath", "reason")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, fingerprint: the first 16 hex digits of each file's sha256."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"))
