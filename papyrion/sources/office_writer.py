"""Blocks and cells written as word-processor files, workbooks and archives: small, complete files of their formats."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the formats' parts.
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
CORE_NS = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: The time of every member, so that equal contents give equal files.
WRITTEN = (1980, 1, 1, 0, 0, 0)


def archive(parts: dict[str, str | bytes]) -> bytes:
    """An archive of the parts, in their order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, WRITTEN), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _clean(text: str | None) -> str:
    """Text that XML can hold."""
    return escape("".join(c for c in text or "" if c in "\t\n" or c >= " " and c not in "￾￿" and not "\ud800" <= c <= "\udfff"))


def _links(links: dict[str, tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id={quoteattr(i)} Type="{LINK_NS}/{kind}" Target={quoteattr(target)}/>' for i, (kind, target) in links.items())
    return f'{HEAD}<Relationships xmlns="{RELS_NS}">{rows}</Relationships>'


def word_file(title: str | None, paragraphs: list[tuple[int | None, str | None]], images: list[tuple[str, str]] = ()) -> bytes:
    """A word-processor file of (heading level or None, text) paragraphs. Headings have a style with an outline level,
    those of the first level large and bold letters. Images are (part that shows it: header or content, name)."""
    body = []
    for level, text in paragraphs:
        style = f'<w:pPr><w:pStyle w:val="H{level}"/></w:pPr>' if level else ""
        look = "<w:rPr><w:b/><w:sz w:val=\"40\"/></w:rPr>" if level == 1 else ""
        body.append(f'<w:p>{style}<w:r>{look}<w:t xml:space="preserve">{_clean(text)}</w:t></w:r></w:p>')
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr></w:style>' for k in range(1, 10))
    parts = {
        "word/document.xml": f'{HEAD}<w:document xmlns:w="{WORD_NS}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/styles.xml": f'{HEAD}<w:styles xmlns:w="{WORD_NS}">{styles}</w:styles>',
        "docProps/core.xml": f'{HEAD}<cp:coreProperties xmlns:cp="{CORE_NS}" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_clean(title)}</dc:title></cp:coreProperties>',
    }
    links: dict[str, dict[str, tuple[str, str]]] = {"document": {}, "header1": {}}
    for i, (where, name) in enumerate(images):
        links["header1" if where == "header" else "document"][f"r{i}"] = ("image", f"media/{name}")
        parts[f"word/media/{name}"] = name.encode()
    if links["header1"]:
        parts["word/header1.xml"] = f'{HEAD}<w:hdr xmlns:w="{WORD_NS}"/>'
    for part, own in links.items():
        if own:
            parts[f"word/_rels/{part}.xml.rels"] = _links(own)
    return archive(parts)


def column_name(n: int) -> str:
    """A, B, … Z, AA of a column from 1."""
    name = ""
    while n:
        n, digit = divmod(n - 1, 26)
        name = chr(65 + digit) + name
    return name


def workbook_file(sheets: list[tuple[str, list[tuple[int, int, str]]]]) -> bytes:
    """A workbook of (name, cells) sheets; a cell is (row, column, text) from 1, one that begins with ``=`` a formula."""
    parts, links, names = {}, {}, []
    for i, (name, cells) in enumerate(sheets, 1):
        rows: dict[int, list[str]] = {}
        for r, c, text in sorted(cells):
            place = f"{column_name(c)}{r}"
            inner = f"<f>{_clean(text[1:])}</f>" if text.startswith("=") and len(text) > 1 else f'<is><t xml:space="preserve">{_clean(text)}</t></is>'
            rows.setdefault(r, []).append(f'<c r="{place}"{"" if inner.startswith("<f>") else " t=" + quoteattr("inlineStr")}>{inner}</c>')
        data = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in sorted(rows.items()))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{HEAD}<worksheet xmlns="{SHEET_NS}"><sheetData>{data}</sheetData></worksheet>'
        links[f"r{i}"] = ("worksheet", f"worksheets/sheet{i}.xml")
        names.append(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="r{i}"/>')
    book = f'{HEAD}<workbook xmlns="{SHEET_NS}" xmlns:r="{LINK_NS}"><sheets>{"".join(names)}</sheets></workbook>'
    return archive({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _links(links), **parts})


def files_of(rows: DataFrame, path: str, make: Callable[[dict], bytes]) -> DataFrame:
    """``path, content``: the file that ``make`` gives for each row; one row holds all that goes into a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row[path]], pa.string()), pa.array([make(row)], pa.binary())], ["path", "content"])

    return rows.withColumn(path, F.col(path).cast("string")).mapInArrow(write, "path string, content binary")


def word_files(documents: DataFrame) -> DataFrame:
    """Files of documents ``path, title, paragraphs array<struct<no,level,text>>, images array<struct<role,name>>``."""
    return files_of(documents, "path", lambda r: word_file(r["title"], [(p["level"], p["text"]) for p in r["paragraphs"]], [(i["role"], i["name"]) for i in r["images"]]))


def workbooks(cells: DataFrame) -> DataFrame:
    """Files of cells ``path, sheet, row_no, column_no, cell``, sheets in the order of their names."""
    sheets = cells.groupBy("path", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_no", "column_no", "cell"))).alias("cells"))
    books = sheets.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sheet", "cells"))).alias("sheets"))
    return files_of(books, "path", lambda r: workbook_file([(str(s["sheet"]), [(c["row_no"], c["column_no"], c["cell"] or "") for c in s["cells"]]) for s in r["sheets"]]))
