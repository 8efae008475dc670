"""Sheets, questions and golden answers from CSV, JSON, Parquet and xlsx."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
CELLS = "source_file string, sheet_name string, sheet_index int, row_index int, cells array<string>"


def _sheets(content: bytes) -> Iterator[tuple[str, list[tuple[int, list[str | None]]]]]:
    """Name and rows (number from 1, cells) of each sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            rows = []
            for n, row in enumerate(ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iterfind(".//m:row", _NS), 1):
                cells: list[str | None] = []
                for c in row.iterfind("m:c", _NS):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    value = c.findtext("m:v", None, _NS)
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value
                rows.append((int(row.get("r") or n), cells))
            yield sheet.get("name"), rows


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks under a path, one row per sheet row. Each workbook is parsed where it is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(p.rsplit("/", 1)[-1], name, k, n, cells) for k, (name, sheet) in enumerate(_sheets(content)) for n, cells in sheet]
                yield pd.DataFrame(rows, columns=["source_file", "sheet_name", "sheet_index", "row_index", "cells"])

    return files.mapInPandas(parse, CELLS)


def load_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, notes). A sheet of two named columns or more and a row is a table: rows (source_file, sheet_name, row_number from 1, values map without blanks); any other is a note: its cells column by column, joined by line breaks.

    Rows and columns without any value don't count.
    """
    cells = workbook_cells(spark, path).withColumn("cells", F.transform("cells", text.cell)).where(F.exists("cells", lambda c: c != ""))
    sheet = ["source_file", "sheet_name"]
    head = cells.groupBy(*sheet).agg(F.min_by("cells", "row_index").alias("names"), F.min("row_index").alias("_first"), F.count("*").alias("_rows"))
    head = head.withColumn("_table", (F.size(F.filter("names", lambda c: (c != "") & ~c.startswith("Unnamed"))) >= 2) & (F.col("_rows") >= 2))
    both = cells.join(head, sheet)
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.struct(F.get("names", i).alias("key"), F.coalesce(F.get("cells", i), F.lit("")).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    body = both.where(F.col("_table") & (F.col("row_index") > F.col("_first")))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*sheet).orderBy("row_index"))
    distinct = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))
    rows = body.select(*sheet, number.alias("row_number"), distinct.alias("values"))
    items = both.where(~F.col("_table")).select(*sheet, "row_index", F.posexplode("cells").alias("column", "cell")).where("cell <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("column", "row_index", "cell")))
    notes = items.groupBy(*sheet).agg(F.array_join(F.transform(ordered, lambda x: x["cell"]), "\n").alias("text"))
    return rows, notes


def key_of(name: str) -> str:
    return re.sub(r"[\s_]+", " ", name.strip().lower())


def pick(columns: list[str], *wanted: str) -> str | None:
    """The first column that one of the names fits, whatever case, spaces and underscores; names in the order of preference."""
    by_key = {key_of(c): c for c in reversed(columns)}
    return next((by_key[key_of(w)] for w in wanted if key_of(w) in by_key), None)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, JSON (a list, {"questions": [...]} or {id: item}) or Parquet, by suffix; all columns are strings unless Parquet says otherwise."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    if suffix == "json":
        return read_json_items(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{suffix}")


#: The most columns that a file of items may have.
MOST_COLUMNS = 10_000


def read_json_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of a JSON file as columns; of {id: item} the id becomes a column. Items are objects of any values, or texts (column question). More than MOST_COLUMNS different keys are refused."""
    raw = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$.questions"), F.col("value"))
    listed = F.from_json(body, "array<string>")
    keyed = F.map_entries(F.from_json(body, "map<string,string>"))
    as_items = F.when(F.ltrim(body).startswith("["), F.transform(listed, lambda x, i: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))).otherwise(F.transform(keyed, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    items = raw.select(F.posexplode(as_items).alias("at", "item")).select("at", "item.*")
    obj = F.coalesce(F.from_json("value", "map<string,string>"), F.create_map(F.lit("question"), F.col("value")))
    items = items.select("at", F.when(F.col("key").isNull(), obj).otherwise(F.map_concat(F.map_filter(obj, lambda k, v: k != "id"), F.create_map(F.lit("id"), F.col("key")))).alias("m"))
    names = sorted(r[0] for r in items.select(F.explode(F.map_keys("m"))).distinct().limit(MOST_COLUMNS + 1).collect())
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"{path} has items of over {MOST_COLUMNS} different keys")
    return items.select("at", *[F.col("m")[n].alias(n) for n in names]).orderBy("at").drop("at")


def promoted(rows: DataFrame, cells: str = "cells", order: str = "row_index", within: int = 10) -> DataFrame:
    """A table whose header is the first of its first rows (within) that has a question-like cell; without one the first row."""
    first = rows.orderBy(order).limit(within).select(order, cells).collect()
    wanted = {key_of(x) for x in fixed.SYNONYMS["question"]}
    at = next((k for k, r in enumerate(first) if any(key_of(c or "") in wanted for c in r[cells])), 0)
    names = [c or f"_{k}" for k, c in enumerate(first[at][cells])] if first else []
    return rows.where(F.col(order) > (first[at][order] if first else 0)).select(order, *[F.get(cells, F.lit(k)).alias(n) for k, n in enumerate(names)])


def questions(table: DataFrame, order: str | None = None, most: int | None = None) -> DataFrame:
    """q_id, question, golden_answer, key_facts from a table with any of their synonyms. Questions under 5 characters go; without an id: Q and the row's number. Repeated questions stay."""
    from pyspark.sql import Window

    find = {k: pick(table.columns, *v) for k, v in fixed.SYNONYMS.items()}
    if not find["question"]:
        raise ValueError("no question column")
    number = F.row_number().over(Window.orderBy(order if order else F.monotonically_increasing_id()))  # a question list is small
    get = lambda k: F.col(f"`{find[k]}`").cast("string") if find[k] else F.lit(None).cast("string")
    rows = table.withColumn("_n", number).select("_n", text.cell(get("question")).alias("question"), text.question_id(get("q_id")).alias("q_id"), text.answer_text(get("answer")).alias("golden_answer"), get("key_facts").alias("key_facts"))
    rows = rows.where(F.length("question") >= 5).withColumn("q_id", F.coalesce(F.nullif(F.trim("q_id"), F.lit("")), F.format_string("Q%02d", "_n")))
    rows = rows.orderBy("_n")
    return (rows.limit(most) if most else rows).select("q_id", "question", "golden_answer", "key_facts")


def validate(rows: DataFrame) -> DataFrame:
    """One row per sheet: rows, whether it has coordinates and updated locations."""
    keys = F.transform(F.flatten(F.collect_set(F.map_keys("values"))), lambda k: F.lower(k))
    has = lambda c, *w: F.exists(c, lambda k: k.isin(*w))
    return rows.groupBy("source_file", "sheet_name").agg(F.count("*").alias("rows"), keys.alias("k")).select("source_file", "sheet_name", "rows", (has("k", "latitude", "lat") & has("k", "longitude", "long", "lon", "lng")).alias("has_coordinates"), has("k", "updated location").alias("has_updated_location"))


def resolve(spark: SparkSession, candidates: list[str], hint: str | None = None, label: str = "file") -> str:
    """The hint if it is given, else the first candidate that Spark can list; names all that were tried otherwise."""
    for path in [hint] if hint else candidates:
        try:
            if spark.read.format("binaryFile").load(path).select("path").limit(1).count():
                return path
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"no {label} at {', '.join([hint] if hint else candidates)}")
