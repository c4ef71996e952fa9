"""Spreadsheets (.xlsx) as tables of strings, by their XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """0-based column of a cell reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_rows(data: bytes, sheet: str) -> Iterator[list[str]]:
    """Rows of a sheet as they are stored, so codes keep their zeros where they are text; '' for empty cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(_LINK) for s in book.iter(f"{_MAIN}sheet")}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet}; there are {sorted(ids)}")
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        target = parts[ids[sheet]]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str] = []
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    value = cell.find(f"{_MAIN}v")
                    text = (value.text or "") if value is not None else _text(cell)
                    if cell.get("t") == "s" and text:
                        text = shared[int(text)]
                    out += [""] * (at + 1 - len(out))
                    out[at] = text
                yield out
                row.clear()


def read_sheets(spark: SparkSession, path: str, sheets: list[str], columns: list[str]) -> DataFrame:
    """The named columns of sheets that begin with a header row, and ``sheet``, all as strings.

    A workbook is read by one task, a sheet's rows as they come; ``path`` may be anything that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                for sheet in sheets:
                    rows = sheet_rows(data, sheet)
                    header = [h.strip() for h in next(rows, [])]
                    missing = [c for c in columns if c not in header]
                    if missing:
                        raise ValueError(f"sheet {sheet} has no column {missing}")
                    at = [header.index(c) for c in columns]
                    found = [[r[k] if k < len(r) else "" for k in at] for r in rows]
                    yield pa.record_batch([pa.array([r[k] for r in found], pa.string()) for k in range(len(at))] + [pa.array([sheet] * len(found), pa.string())], [*columns, "sheet"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in [*columns, "sheet"]))


def read_code_table(spark: SparkSession, path: str, townships: bool = True, areas: str = "省市区", streets: str = "乡镇街道") -> tuple[DataFrame, DataFrame | None]:
    """Code tables (code, name) of the sheet of provinces to counties, and of the one of townships."""
    rows = read_sheets(spark, path, [areas, *([streets] if townships else [])], ["code", "name"])
    of = lambda sheet: rows.where((F.col("sheet") == sheet) & (F.trim("code") != "")).select("code", "name")
    return of(areas), of(streets) if townships else None
