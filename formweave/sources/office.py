"""Sources of forms: OOXML files, framed messages. Parsing runs in Arrow batches; rows leave, not objects."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formweave.operators.matching import rules
from formweave.sources.shared import written

MOST_MESSAGE = 64 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx_cells(raw: bytes) -> list[tuple[int, int, int, str]]:
    """(table, row, column, text) of all table cells; paragraphs outside tables are table -1, one a row."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _member(z, "word/document.xml").find(f"{_W}body")
    out, tables, line = [], 0, 0
    for node in body:
        if node.tag == f"{_W}tbl":
            out += [(tables, r, c, _text(cell, f"{_W}t")) for r, row in enumerate(node.findall(f"{_W}tr")) for c, cell in enumerate(row.findall(f"{_W}tc"))]
            tables += 1
        elif node.tag == f"{_W}p" and (text := _text(node, f"{_W}t")):
            out.append((-1, line, 0, text))
            line += 1
    return out


#: Bytes of a package's member, unpacked, at most: a larger one raises ValueError.
MOST_MEMBER = 256 << 20
_PACKAGE_ROWS = "doc string, name string, rid string, part string, at long, row int, col int, kind string, text string, tag string"


def _member(z: zipfile.ZipFile, name: str) -> ET.Element:
    if z.getinfo(name).file_size > MOST_MEMBER:
        raise ValueError(f"{name} is too long")
    return ET.fromstring(z.read(name))


def column_of(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_rows(raw: bytes) -> Iterator[dict]:
    """The rows of a book's members by tag: sheet (name, rid), relation (rid, part), shared (at, text), cell (part, row, col,
    kind, text); members are parsed one by one."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for member in z.namelist():
            if member == "xl/workbook.xml":
                yield from ({"tag": "sheet", "name": x.get("name"), "rid": x.get(_R)} for x in _member(z, member).iter(f"{_S}sheet"))
            elif member == "xl/_rels/workbook.xml.rels":
                for x in _member(z, member):
                    target = x.get("Target").lstrip("/")
                    yield {"tag": "relation", "rid": x.get("Id"), "part": target if target.startswith("xl/") else f"xl/{target}"}
            elif member == "xl/sharedStrings.xml":
                yield from ({"tag": "shared", "at": k, "text": _text(x, f"{_S}t")} for k, x in enumerate(_member(z, member)))
            elif member.startswith("xl/worksheets/") and member.endswith(".xml"):
                for cell in _member(z, member).iter(f"{_S}c"):
                    letters, kind, value = cell.get("r").rstrip("0123456789"), cell.get("t") or "n", cell.findtext(f"{_S}v")
                    place = {"row": int(cell.get("r")[len(letters) :]), "col": column_of(letters)}
                    if kind == "inlineStr":
                        yield {"tag": "cell", "part": member, "kind": kind, "text": _text(cell, f"{_S}t"), **place}
                    elif value is not None:
                        yield {"tag": "cell", "part": member, "kind": kind, "at": int(value) if kind == "s" else None, "text": value, **place}


def workbook_cells(files: DataFrame, doc: str = "path", content: str = "content") -> DataFrame:
    """(doc, sheet, row, col, text) of all filled cells of spreadsheets, such as spark.read.format("binaryFile") gives.

    One pass unpacks the books into rows by tag, in a written table; then a sheet's name meets its relation, that its part
    and so the cells, and shared strings are looked up by a join, so no book's strings are held beside its cells."""
    names = [c.split()[0] for c in _PACKAGE_ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for n, c in zip(names, _PACKAGE_ROWS.split(", "), strict=True)])
        for b in batches:
            for k, raw in zip(b.column("doc").to_pylist(), b.column("content"), strict=True):
                rows = workbook_rows(raw.as_py())
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist([{"doc": k, **r} for r in some], schema)

    found = files.select(F.col(doc).cast("string").alias("doc"), F.col(content).alias("content")).mapInArrow(run, _PACKAGE_ROWS)
    rows = written(found, "workbooks", "tag")
    of = lambda tag, *columns: rows.where(F.col("tag") == tag).select("doc", *columns)
    sheets = of("sheet", F.col("name").alias("sheet"), "rid").join(of("relation", "rid", "part"), ["doc", "rid"])
    cells = of("cell", "part", "row", "col", "kind", "at", F.col("text").alias("raw")).join(sheets.drop("rid"), ["doc", "part"])
    said = cells.join(of("shared", "at", F.col("text").alias("shared")), ["doc", "at"], "left")
    text = F.when(F.col("kind") == "s", F.col("shared")).otherwise(F.col("raw"))
    return said.select("doc", "sheet", "row", "col", text.alias("text")).where("text <> ''")


def document_cells(files: DataFrame, doc: str = "path", content: str = "content") -> DataFrame:
    """(doc, tbl, row, col, text) of text documents: see `docx_cells`."""
    src = files.select(F.col(doc).cast("string").alias("doc"), F.col(content).alias("content"))
    return explode_with(src, "doc", "content", docx_cells, "tbl int, row int, col int, text string")


def frames(raw: bytes) -> list[bytes]:
    """Messages of a stream: little-endian length, payload; a clean end is no error, anything else raises."""
    out, at = [], 0
    while at < len(raw):
        if at + 4 > len(raw):
            raise ValueError("the stream ends within a length")
        (n,) = struct.unpack_from("<I", raw, at)
        if n > MOST_MESSAGE:
            raise ValueError("a message is too long")
        if at + 4 + n > len(raw):
            raise ValueError("the stream ends within a message")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def frame(payload: bytes) -> bytes:
    return struct.pack("<I", len(payload)) + payload


def explode_with(df: DataFrame, key: str, column: str, parse, fields: str) -> DataFrame:
    """One row for every row that `parse` makes of a value, in Arrow batches."""
    names = [key, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, v in zip(b[key], b[column], strict=True) for r in parse(v)]
            yield pd.DataFrame(rows, columns=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(run, f"{key} {kind}, {fields}")


def next_empty_cell(cells: DataFrame) -> DataFrame:
    """(doc, tbl, row, label, col): the empty cell right of a filled one in its row."""
    w = Window.partitionBy("doc", "tbl", "row").orderBy("col")
    return cells.withColumns({"nc": F.lead("col").over(w), "nt": F.lead("text").over(w)}).where("trim(text) <> '' AND nt IS NOT NULL AND trim(nt) = ''").select("doc", "tbl", "row", F.col("text").alias("label"), F.col("nc").alias("col"))


def neighbour_cell(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, sheet, label, row, col): the place right of a label's cell if it is free, else the one below. `labels` is a rule
    table; only the cells beside labels are looked at."""
    at = cells.join(rules(labels), F.lower("text") == F.col("label"))
    right = cells.select("doc", "sheet", "row", (F.col("col") - 1).alias("col"), F.lit(True).alias("full"))
    met = at.join(right, ["doc", "sheet", "row", "col"], "left")
    full = F.col("full").isNotNull()
    return met.select("doc", "sheet", "label", (F.col("row") + full.cast("int")).alias("row"), (F.col("col") + (~full).cast("int")).alias("col"))
