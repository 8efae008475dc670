"""Workbooks (xlsx) as a data source: a partition for every sheet, sheets and files left out before anything is read, and a writer whose commit assembles the sheets.

spark.dataSource.register(Workbook) makes it known as "workbook". Files are opened by Arrow's file systems, on executors too, so they lie in a shared folder.
"""

from __future__ import annotations

import json
import re
import shutil
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..tables import qualified
from .ordinals import ordinal

MAIN, LINKS, PACKAGE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
CELLS = "source_file string, sheet_name string, sheet_index int, row_index int, cells array<string>"
#: Rows that the format allows in a sheet; more are refused, so a workbook is small enough to be put together in one place.
MOST_ROWS = 1_048_576
#: Characters that a sheet's name may not hold, and its longest length.
NAME_BARRED, NAME_LENGTH = r"[\[\]:*?/\\]", 31


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    store, at = _place(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".xlsx") and not f.base_name.startswith(("~", "_", ".")))


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


@dataclass
class Sheet(InputPartition):
    file: str
    name: str
    index: int
    target: str

    def __init__(self, file: str, name: str, index: int, target: str):
        super().__init__(index)
        self.file, self.name, self.index, self.target = file, name, index, target


class Reader(DataSourceReader):
    """Plans from the workbooks' directories alone; a task reads its own sheet and the shared texts, row by row."""

    def __init__(self, path: str, only: dict[str, list[str]]):
        self.path, self.only = path, only

    def partitions(self) -> list[Sheet]:
        store, _ = _place(self.path)
        out = []
        for file in _files(self.path):
            if file.rsplit("/", 1)[-1] not in self.only.get("source_file", {file.rsplit("/", 1)[-1]}):
                continue
            with store.open_input_file(file) as source, zipfile.ZipFile(source) as z:
                targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                for k, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(_tag("sheet"))):
                    target = targets[sheet.get(f"{{{LINKS}}}id")]
                    if sheet.get("name") in self.only.get("sheet_name", {sheet.get("name")}):
                        out.append(Sheet(file, sheet.get("name"), k, target if target.startswith("xl/") else f"xl/{target}"))
        return out

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if partition is None:  # nothing is left to read
            return
        store, _ = _place(self.path)
        with store.open_input_file(partition.file) as source, zipfile.ZipFile(source) as z:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in z.namelist():
                for _, e in ET.iterparse(z.open("xl/sharedStrings.xml")):
                    if e.tag == _tag("si"):
                        shared.append("".join(t.text or "" for t in e.iter(_tag("t"))))
                        e.clear()
            n = 0
            for _, row in ET.iterparse(z.open(partition.target)):
                if row.tag != _tag("row"):
                    continue
                n = int(row.get("r") or n + 1)
                cells: list[str | None] = []
                for c in row.iter(_tag("c")):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    value = c.findtext(_tag("v"))
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(_tag("t")))
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value
                yield partition.file.rsplit("/", 1)[-1], partition.name, partition.index, n, cells
                row.clear()


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[int, str, int, int, str]]  # sheet index and name, first and last row, file


class Writer(DataSourceWriter):
    """Tasks write their rows as pieces of XML into a folder beside the file; the commit joins the pieces by sheet and row and puts the file in its place. Failed jobs leave nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        store, at = _place(path)
        self.folder = f"{at}._parts-{uuid.uuid4().hex}"
        store.create_dir(self.folder, recursive=True)  # by the driver alone: a task that outlives an abort finds no folder

    def write(self, iterator) -> Written:
        store, _ = _place(self.path)
        parts, sink, now = [], None, None
        for row in iterator:
            if row.sheet_name != now:
                if sink:
                    sink.close()
                now, name = row.sheet_name, f"{self.folder}/{uuid.uuid4().hex}"
                sink = store.open_output_stream(name)
                parts.append([row.sheet_index, now, row.row_index, row.row_index, name])
            if row.row_index > MOST_ROWS:
                raise ValueError(f"{now}: a sheet holds {MOST_ROWS} rows at most")
            cells = (f"<c><v>{escape(v)}</v></c>" if number else f'<c t="inlineStr"><is><t xml:space="preserve">{_plain(v)}</t></is></c>' if v is not None else "<c/>" for v, number in zip(row.cells, row.numbers, strict=True))
            sink.write(f'<row r="{row.row_index}">{"".join(cells)}</row>'.encode())
            parts[-1][2:4] = [min(parts[-1][2], row.row_index), max(parts[-1][3], row.row_index)]
        if sink:
            sink.close()
        return Written([tuple(p) for p in parts])

    def commit(self, messages) -> None:
        store, at = _place(self.path)
        try:
            if store.get_file_info(at).type != fs.FileType.NotFound and not self.overwrite:
                raise FileExistsError(self.path)
            sheets: dict[tuple[int, str], list] = {}
            for m in messages:
                for index, name, low, high, part in m.parts if m else []:
                    sheets.setdefault((index, name), []).append((low, high, part))
            ready = f"{self.folder}.xlsx"
            with store.open_output_stream(ready) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                _head(z, [name for _, name in sorted(sheets)])
                for k, key in enumerate(sorted(sheets), 1):
                    with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                        out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                        last = 0
                        for low, high, part in sorted(sheets[key]):
                            if low <= last:
                                raise ValueError(f"{key[1]}: rows are dealt over tasks out of order")
                            last = high
                            with store.open_input_stream(part) as piece:
                                shutil.copyfileobj(piece, out)
                        out.write(b"</sheetData></worksheet>")
            store.move(ready, at)
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        store, _ = _place(self.path)
        if store.get_file_info(self.folder).type == fs.FileType.Directory:
            store.delete_dir(self.folder)
        if store.get_file_info(f"{self.folder}.xlsx").type == fs.FileType.File:
            store.delete_file(f"{self.folder}.xlsx")


def _plain(v: str) -> str:
    """Text without the control characters that XML can't hold."""
    return escape(re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "", v))


def _head(z: zipfile.ZipFile, names: list[str]) -> None:
    xml = '<?xml version="1.0" encoding="UTF-8"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    quoted = [escape(n, {'"': "&quot;"}) for n in names]
    z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1)) + "</Types>")
    z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(quoted, 1)) + "</sheets></workbook>")
    z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="rId{k}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")


class Workbook(DataSource):
    """Reads CELLS from a workbook or a folder of them (options sheets and files: JSON lists of the only ones wanted); writes sheet_index, sheet_name, row_index, cells, numbers (whether a cell is a number), dealt by sheet and row."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], {k: json.loads(self.options[v]) for k, v in (("sheet_name", "sheets"), ("source_file", "files")) if v in self.options})

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def cells(spark: SparkSession, path: str, *, sheets: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """CELLS of all workbooks under a path, of some sheets and files only where these are named. They are options and no pushed filters: the engine keeps the first filters pushed into a source like this for later queries of the same frame."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    for name, only in (("sheets", sheets), ("files", files)):
        reader = reader if only is None else reader.option(name, json.dumps(only))
    return reader.load(qualified(spark, path))


def write_workbook(tables: dict[str, DataFrame], path: str, order: dict[str, list[str]] | None = None) -> None:
    """A workbook with a sheet for every table in the order given: a row of names, then the rows, by order's columns where it names the table, else by all columns from left to right. An existing file is replaced."""
    spark = next(iter(tables.values())).sparkSession
    spark.dataSource.register(Workbook)
    used: list[DataFrame] = []
    for k, (name, d) in enumerate(tables.items()):
        if re.search(NAME_BARRED, name) or not 0 < len(name) <= NAME_LENGTH:
            raise ValueError(f"{name!r} can't name a sheet")
        kinds = dict(d.dtypes)
        number = [kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal") for c in d.columns]
        simple = [F.col(f"`{c}`").cast("string") if not kinds[c].startswith(("array", "map", "struct")) else F.to_json(F.col(f"`{c}`")) for c in d.columns]
        # what is no finite number is text
        finite = [F.col("cells")[i].isNotNull() & ~F.col("cells")[i].isin("NaN", "Infinity", "-Infinity") if n else F.lit(False) for i, n in enumerate(number)]
        placed = ordinal(d.select(F.array(*simple).alias("cells"), F.struct(*[F.col(f"`{c}`") for c in (order or {}).get(name, [c for c in d.columns if not kinds[c].startswith("map")])]).alias("_by")), "_by", into="_row")
        body = placed.select((F.col("_row") + 2).cast("int").alias("row_index"), "cells", F.array(*finite).alias("numbers"))
        head = spark.createDataFrame([(1, d.columns, [False] * len(d.columns))], "row_index int, cells array<string>, numbers array<boolean>")
        used.append(head.unionByName(body).select(F.lit(k).alias("sheet_index"), F.lit(name).alias("sheet_name"), "row_index", "cells", "numbers"))
    every = used[0]
    for d in used[1:]:
        every = every.unionByName(d)
    every.repartitionByRange("sheet_index", "row_index").sortWithinPartitions("sheet_index", "row_index").write.format("workbook").mode("overwrite").save(qualified(spark, path))


def single_run(responses: DataFrame) -> str:
    """The one run that a report of a single model has; none or several are refused."""
    found = [r[0] for r in responses.select("run_name").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("a report of one model needs responses of exactly one run")
    return found[0]
