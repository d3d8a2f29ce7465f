"""Files of results: CSV through Spark's committer, a workbook for each section image.

A workbook is made where its rows are and holds numbers as they were measured; four decimals are
a matter of how a cell is shown.
"""

from __future__ import annotations

import io
import math
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..operators.report import GRID, headers
from .files import SectionFiles, folder_name

#: Fixed by the file format: namespaces, content types and relations of a workbook's parts.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML 1.0 does not allow.
_FORBIDDEN = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")

#: Looks of a cell: (font, fill, number format, wrapped).
LOOKS = {
    "plain": (0, 0, 0, False),
    "bold": (1, 0, 0, False),
    "italic": (2, 0, 0, False),
    "number": (0, 0, 1, False),
    "bold number": (1, 0, 1, False),
    "header": (1, 1, 0, False),
    "wrapped": (0, 0, 0, True),
}
SHOWN_AS = "0.0000"
LEAST_WIDTH, MOST_WIDTH = 8.0, 90.0


def xml(text: str) -> str:
    """Escaped for XML, without the characters that it does not allow."""
    kept = _FORBIDDEN.sub("", text)
    return kept.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def reference(row: int, column: int) -> str:
    """A1-style name of a cell; letters count without a zero."""
    letters, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


@dataclass
class Sheet:
    """Rows of (value, look); the first ``frozen`` (columns, rows) stay in sight."""

    name: str
    frozen: tuple[int, int] = (0, 0)
    rows: list[list[tuple[object, str]]] = field(default_factory=list)

    def xml(self) -> str:
        widths: dict[int, float] = {}
        lines = []
        for i, row in enumerate(self.rows):
            cells = []
            for j, (value, look) in enumerate(row):
                at = f'r="{reference(i, j)}" s="{list(LOOKS).index(look)}"'
                if isinstance(value, str):
                    cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{xml(value)}</t></is></c>')
                elif value is not None and math.isfinite(value):
                    cells.append(f"<c {at}><v>{value!r}</v></c>")
                elif look != "plain":
                    cells.append(f"<c {at}/>")
                shown = value if isinstance(value, str) else "" if value is None else f"{value:.4f}"
                longest = max(map(len, shown.split("\n")))
                widths[j] = max(widths.get(j, LEAST_WIDTH), min(MOST_WIDTH, longest * 1.1 + 2))
            lines.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
        columns = "".join(f'<col min="{j + 1}" max="{j + 1}" width="{w:.2f}" customWidth="1"/>' for j, w in sorted(widths.items()))
        return f'{_HEAD}<worksheet xmlns="{_MAIN}">{self._view()}{f"<cols>{columns}</cols>" if columns else ""}<sheetData>{"".join(lines)}</sheetData></worksheet>'

    def _view(self) -> str:
        across, down = self.frozen
        if not across and not down:
            return ""
        split = (f' xSplit="{across}"' if across else "") + (f' ySplit="{down}"' if down else "")
        pane = ("bottom" if down else "top") + ("Right" if across else "Left")
        return f'<sheetViews><sheetView workbookViewId="0"><pane{split} topLeftCell="{reference(down, across)}" activePane="{pane}" state="frozen"/></sheetView></sheetViews>'


def _styles() -> str:
    face = '<sz val="11"/><name val="Calibri"/>'
    fonts = f"<font>{face}</font><font><b/>{face}</font><font><i/>{face}</font>"
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E2F3"/></patternFill></fill>'
    look = "".join(
        f'<xf numFmtId="{164 if number else 0}" fontId="{font}" fillId="{2 if fill else 0}" borderId="0" xfId="0" applyFont="1" applyFill="1" applyNumberFormat="1"'
        + (' applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf>' if wrapped else "/>")
        for font, fill, number, wrapped in LOOKS.values()
    )
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="{SHOWN_AS}"/></numFmts><fonts count="3">{fonts}</fonts><fills count="3">{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(LOOKS)}">{look}</cellXfs></styleSheet>'
    )


def workbook(sheets: Iterable[Sheet]) -> bytes:
    """The file of some sheets."""
    sheets = list(sheets)
    numbered = list(enumerate(sheets, 1))
    override = lambda part, kind: f'<Override PartName="/{part}" ContentType="{_KIND}.{kind}+xml"/>'
    related = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>'
    relations = lambda inner: f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{inner}</Relationships>'
    parts = {f"xl/worksheets/sheet{i}.xml": s.xml() for i, s in numbered}
    kinds = [*(override(p, "worksheet") for p in parts), override("xl/workbook.xml", "sheet.main"), override("xl/styles.xml", "styles")]
    named = "".join(f'<sheet name="{xml(s.name)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in numbered)
    parts["xl/styles.xml"] = _styles()
    parts["xl/workbook.xml"] = f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{named}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = relations("".join(related(i, "worksheet", f"worksheets/sheet{i}.xml") for i, _ in numbered) + related(len(sheets) + 1, "styles", "styles.xml"))
    parts["_rels/.rels"] = relations(related(1, "officeDocument", "xl/workbook.xml"))
    plain = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    first = {"[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{plain}{"".join(kinds)}</Types>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (first | parts).items():
            z.writestr(name, text)
    return out.getvalue()


def result_sheets(totals: dict, parts: list[dict], info: list[tuple[str, str]], messages: list[tuple[str, str]]) -> list[Sheet]:
    """The two sheets of an image: what was measured, and how the run went."""
    table = Sheet("Results", (1, 1))
    table.rows.append([(text, "header") for text in headers(totals["area_unit"], totals["length_unit"])])
    areas = ("cerebellum", "grey", "granular", "molecular", "purkinje_area")
    table.rows.append([("Area", "bold"), *((totals[c], "bold number") for c in areas)])
    table.rows.append([("Length", "bold"), *[(None, "bold")] * (len(areas) - 1), (totals["purkinje_len"], "bold number")])
    for part in parts:
        table.rows.append([(part["name"], "italic"), (None, "plain"), (None, "plain"), *((part[c], "number") for c in ("granular", "molecular", "purkinje"))])
    about = Sheet("Run Info", (0, 1))
    about.rows.append([("Field", "header"), ("Value", "header")])
    about.rows += [[(name, "bold"), (value, "wrapped")] for name, value in info]
    about.rows += [[(level.capitalize(), "bold"), (text, "wrapped")] for level, text in messages]
    return [table, about]


def workbooks(totals: DataFrame, parts: DataFrame, info: DataFrame, messages: DataFrame) -> DataFrame:
    """section_id, content: the workbook of each image of ``totals``.

    ``parts``, ``info`` (seq, field, value) and ``messages`` (seq, level, message) are a few rows for each image.
    """
    listed = lambda df, order, *columns: df.groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("l"))
    rows = totals
    for name, df in (
        ("parts", listed(parts, "ord", "name", "granular", "molecular", "purkinje")),
        ("info", listed(info, "seq", "field", "value")),
        ("messages", listed(messages, "seq", "level", "message")),
    ):
        rows = rows.join(df.withColumnRenamed("l", name), "section_id", "left")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [
                workbook(result_sheets(r, r["parts"] or [], [(x["field"], x["value"] or "") for x in r["info"] or []], [(x["level"], x["message"]) for x in r["messages"] or []]))
                for r in b.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("section_id"), pa.array(made, pa.binary())], names=["section_id", "content"])

    return rows.mapInArrow(make, f"section_id {totals.schema['section_id'].dataType.simpleString()}, content binary")


def write_workbooks(books: DataFrame, folder: str, base: str) -> None:
    """Files ``<folder>/<section_id>/<base>.xlsx`` (ids as in URLs), written where the rows are.

    ``folder`` is one that all machines see as files. The files appear once all tasks are done, or not at all.
    """
    books.sparkSession.dataSource.register(SectionFiles)
    books.select("section_id", "content").write.format("section_files").mode("append").option("folder", folder).option("file", f"{base}.xlsx").save()


def workbook_paths(sections: DataFrame, folder: str, base: str) -> DataFrame:
    """section_id, path of the file that ``write_workbooks`` makes for each of ``sections``."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [None if s is None else os.path.join(folder, folder_name(str(s)), f"{base}.xlsx") for s in b.column("section_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("section_id"), pa.array(paths, pa.string())], names=["section_id", "path"])

    return sections.select("section_id").mapInArrow(name, f"section_id {sections.schema['section_id'].dataType.simpleString()}, path string")


def csv_lines(grid: DataFrame) -> DataFrame:
    """section_id, row_idx, line: the grid's rows as CSV text."""
    cells = [csv_cell(F.col(c)) for c in GRID]
    return grid.select("section_id", "row_idx", F.concat_ws(",", *cells).alias("line"))


def write_csv(grid: DataFrame, path: str) -> None:
    """One folder a section; each section's rows are in one file, in order. Sections that ``grid`` has not keep their files."""
    lines = csv_lines(grid).repartition("section_id").sortWithinPartitions("section_id", "row_idx")
    lines.select("section_id", F.col("line").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section_id").text(path)
