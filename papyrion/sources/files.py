"""Files to rows: discovery, text decoding, CSV, plain text, archives and the parts of office files.

Everything starts from Spark's ``binaryFile`` source (or any table with ``path`` and ``content``), so that files are
read where they lie and in parallel; a file that can't be read gives a row with ``error``, not a failed job.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from posixpath import dirname, join, normpath
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions.scalars import extension, package_name, supported

ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
SNIFFED = 65_536

# Namespaces and markers of office files.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MARKERS = {
    "drawing": r"<(?:w:)?drawing\b",
    "legacy_vml_picture": r"<(?:w:)?pict\b",
    "vml_shape": r"<v:shape\b",
    "chart": r"<c:chart\b",
    "diagram": r"<dgm:relIds\b",
    "shape": r"<(?:wps:wsp|p:sp)\b",
    "connector": r"<p:cxnSp\b",
    "group_shape": r"<(?:wpg:wgp|p:grpSp)\b",
    "alternate_content": r"<mc:AlternateContent\b",
}


def discover(spark: SparkSession, folder: str, wanted: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Supported files below a folder with their bytes: ``path, ext, package_dir, length, content``, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.col("path")
    return files.where(supported(path, wanted)).select("path", extension(path).alias("ext"), package_name(path).alias("package_dir"), "length", "content").orderBy("path")


def decode(content: bytes) -> tuple[str, str]:
    """(text, encoding): the first of the encodings that fits; the last always does."""
    for name in ENCODINGS:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("the last encoding reads any bytes")


def delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:SNIFFED], delimiters=",;\t|").delimiter
    except csv.Error:
        return ";" if text[:SNIFFED].count(";") > text[:SNIFFED].count(",") else ","


def _each(df: DataFrame, columns: str, types: list[pa.DataType], read: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows ``path, …, error`` that ``read`` gives for each file."""
    names = ["path", *[c.split()[0] for c in columns.split(", ")], "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = [(path, *row, None) for row in read(path, content)]
                except Exception as e:  # whatever a file holds
                    found = [(path, *[None] * len(types), f"{type(e).__name__}: {e}"[:500])]
                if found:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.string(), *types, pa.string()], strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select("path", "content").mapInArrow(run, f"path string, {columns}, error string")


def texts(files: DataFrame) -> DataFrame:
    """``path, text, encoding`` of each file."""
    return _each(files, "text string, encoding string", [pa.string(), pa.string()], lambda p, c: iter([decode(c)]))


def csv_rows(files: DataFrame) -> DataFrame:
    """``path, row_no, header, cells, encoding, delimiter``: all cells text, rows filled to the widest. Lines are split
    before they are read, so a line break within quotes is lost, not its row."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        text, encoding = decode(content)
        sign = delimiter(text)
        rows = list(csv.reader(text.splitlines(), delimiter=sign))
        width = max((len(r) for r in rows), default=0)
        for i, r in enumerate(rows):
            yield i + 1, i == 0, r + [""] * (width - len(r)), encoding, sign

    return _each(files, "row_no int, header boolean, cells array<string>, encoding string, delimiter string", [pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string()], read)


def members(files: DataFrame, pattern: str = ".*") -> DataFrame:
    """``path, member, size, bytes`` of the files in archives whose names match."""
    wanted = re.compile(pattern)

    def read(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir() and wanted.search(info.filename):
                    yield info.filename, info.file_size, z.read(info)

    return _each(files, "member string, size long, bytes binary", [pa.string(), pa.int64(), pa.binary()], read)


def archive_paths(rows: DataFrame) -> DataFrame:
    """Adds ``inner``, the member's path below the one folder all members lie in, if there is one."""
    top = F.split("member", "/")[0]
    own = rows.where(~F.col("member").startswith("__MACOSX/"))
    roots = own.groupBy("path").agg(F.count_distinct(top).alias("tops"), F.min(F.col("member").contains("/")).alias("nested"))
    return own.join(roots, "path").withColumn("inner", F.when((F.col("tops") == 1) & F.col("nested"), F.regexp_replace("member", r"^[^/]+/", "")).otherwise(F.col("member"))).drop("tops", "nested")


# ---------------------------------------------------------------- office files


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(z.read(name))
    except KeyError:
        return None


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Ids of a part's relations and the parts they point to."""
    folder, _, name = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    return {r.get("Id", ""): normpath(join(dirname(part), r.get("Target", ""))) if not r.get("Target", "").startswith("/") else r.get("Target", "")[1:] for r in root or [] if r.get("TargetMode") != "External"}


def office_parts(files: DataFrame) -> DataFrame:
    """``path, media, role, sha256`` of the media of office files, by which part refers to it: header, footer, content or
    other; ``markers`` counts what can't be shown as text."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        from hashlib import sha256

        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            role: dict[str, str] = {}
            for kind, pattern in (("content", r"(?:word/document|ppt/slides/slide\d+|xl/worksheets/sheet\d+)\.xml"), ("footer", r"word/footer\d*\.xml"), ("header", r"word/header\d*\.xml")):
                for part in names:
                    if re.fullmatch(pattern, part):
                        role |= {t: kind for t in relations(z, part).values() if "/media/" in t and role.get(t) != "content"}
            texts = [z.read(n).decode("utf-8", "replace") for n in names if n.endswith(".xml")]
            found = {k: sum(len(re.findall(p, t)) for t in texts) for k, p in MARKERS.items()}
            media = sorted(n for n in names if "/media/" in n)
            for n in media or [None]:
                yield n, role.get(n, "other") if n else None, sha256(z.read(n)).hexdigest() if n else None, list(found.items())

    return _each(files, "media string, role string, sha256 string, markers map<string,int>", [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.int32())], read)


def _heading_styles(z: zipfile.ZipFile) -> dict[str, int]:
    """Levels of paragraph styles: by their outline level, their name, or the style they are based on."""
    root = _xml(z, "word/styles.xml")
    level: dict[str, int] = {}
    based: dict[str, str] = {}
    for s in root.iter(f"{WORD}style") if root is not None else []:
        key = s.get(f"{WORD}styleId", "")
        own = s.find(f"{WORD}pPr/{WORD}outlineLvl")
        name = s.find(f"{WORD}name")
        named = re.fullmatch(r"(?:heading|titre|überschrift|título)\s*([1-9])", (name.get(f"{WORD}val", "") if name is not None else "").strip(), re.I)
        if own is not None and own.get(f"{WORD}val", "").isdigit():
            level[key] = int(own.get(f"{WORD}val")) + 1
        elif named:
            level[key] = int(named[1])
        parent = s.find(f"{WORD}basedOn")
        if parent is not None:
            based[key] = parent.get(f"{WORD}val", "")
    for key in based:
        seen, at = set(), key
        while at not in level and at in based and at not in seen:
            seen.add(at)
            at = based[at]
        if at in level:
            level.setdefault(key, level[at])
    return {k: v for k, v in level.items() if v <= 9}


def word_paragraphs(files: DataFrame) -> DataFrame:
    """``path, paragraph_no, level, number_id, number_level, bold, size, style, align, text`` of word-processor files; level is
    a heading's, by the paragraph's own outline level or its style's."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            styles = _heading_styles(z)
            body = _xml(z, "word/document.xml")
            if body is None:
                raise ValueError("no document part")
            for i, p in enumerate(body.iter(f"{WORD}p"), 1):
                prop = p.find(f"{WORD}pPr")
                find = lambda tag, of=prop: of.find("/".join(f"{WORD}{t}" for t in tag.split("/"))) if of is not None else None
                value = lambda e: e.get(f"{WORD}val") if e is not None else None
                style, own = value(find("pStyle")), value(find("outlineLvl"))
                level = int(own) + 1 if own and own.isdigit() and int(own) < 9 else styles.get(style or "")
                runs = list(p.iter(f"{WORD}r"))
                text = "".join(t.text or "" for r in runs for t in r.iter(f"{WORD}t"))
                full = [r for r in runs if "".join(t.text or "" for t in r.iter(f"{WORD}t")).strip()]
                heavy = sum(r.find(f"{WORD}rPr/{WORD}b") is not None for r in full)
                sizes = [int(v) / 2 for r in runs if (v := value(r.find(f"{WORD}rPr/{WORD}sz"))) and v.isdigit()]
                n, nl = value(find("numPr/numId")), value(find("numPr/ilvl"))
                yield i, level, n, int(nl) if nl and nl.isdigit() else None, bool(full) and heavy >= 0.6 * len(full), max(sizes, default=None), style, value(find("jc")), text

    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.string(), pa.string(), pa.string()]
    return _each(files, "paragraph_no int, level int, number_id string, number_level int, bold boolean, size double, style string, align string, text string", types, read)


def core_titles(files: DataFrame) -> DataFrame:
    """``path, title`` of the core properties of office files."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = _xml(z, "docProps/core.xml")
            yield (next((e.text for e in root.iter() if e.tag.endswith("}title") and e.text), None) if root is not None else None,)

    return _each(files, "title string", [pa.string()], read)


def column_number(reference: str) -> tuple[int, int]:
    """(row, column) of a cell's name, from 1."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", reference)
    if not m:
        raise ValueError(f"no cell: {reference}")
    n = 0
    for c in m[1].upper():
        n = n * 26 + ord(c) - 64
    return int(m[2]), n


def cell_range(formula: str) -> tuple[str, int, int, int, int] | None:
    """(sheet, first row, first column, last row, last column) of a reference such as ``'Sheet 1'!$B$2:$B$9``."""
    m = re.fullmatch(r"(?:'((?:[^']|'')+)'|([^!']+))!(\$?[A-Za-z]+\$?\d+)(?::(\$?[A-Za-z]+\$?\d+))?", formula.strip())
    if not m:
        return None
    (r1, c1), (r2, c2) = column_number(m[3]), column_number(m[4] or m[3])
    return (m[1].replace("''", "'") if m[1] else m[2]), min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def workbook_cells(files: DataFrame) -> DataFrame:
    """``path, sheet, sheet_no, row_no, column_no, value, formula`` of the cells of workbooks: values as text, booleans
    in capitals, a formula's last value."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            strings = _xml(z, "xl/sharedStrings.xml")
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in strings.iter(f"{SHEET}si")] if strings is not None else []
            book, parts = _xml(z, "xl/workbook.xml"), relations(z, "xl/workbook.xml")
            if book is None:
                raise ValueError("no workbook part")
            for no, sheet in enumerate(book.iter(f"{SHEET}sheet"), 1):
                root = _xml(z, parts.get(sheet.get(f"{RELATION}id", ""), ""))
                for c in root.iter(f"{SHEET}c") if root is not None else []:
                    v, f, inline = c.find(f"{SHEET}v"), c.find(f"{SHEET}f"), c.find(f"{SHEET}is")
                    raw = v.text if v is not None else None
                    kind = c.get("t", "n")
                    if kind == "s" and raw is not None:
                        raw = shared[int(raw)]
                    elif kind == "b" and raw is not None:
                        raw = "TRUE" if raw == "1" else "FALSE"
                    elif inline is not None:
                        raw = "".join(t.text or "" for t in inline.iter(f"{SHEET}t"))
                    if raw is not None or f is not None:
                        yield sheet.get("name"), no, *column_number(c.get("r", "A1")), raw, "=" + f.text if f is not None and f.text else None

    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    return _each(files, "sheet string, sheet_no int, row_no int, column_no int, value string, formula string", types, read)
