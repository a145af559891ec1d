import io
import zipfile

import pytest

from papyrion.operators import relations as R
from papyrion.sources import files as S
from papyrion.streaming import stream_chunks, stream_state


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def table(spark, files):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in files.items()], "path string, content binary")


def test_discovery_filters_in_any_case(spark, tmp_path):
    for name in ("a.pdf", "b.XLSX", "sub/c.PDF", "d.exe"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in S.discover(spark, str(tmp_path), ["pdf"]).collect()] == ["a.pdf", "c.PDF"]
    assert S.discover(spark, str(tmp_path), recursive=False).count() == 2
    with pytest.raises(ValueError):
        S.discover(spark, str(tmp_path), ["exe"])


def test_csv(spark):
    files = {"a.csv": "Nom;Valeur\nAlpha;1\nBeta\n".encode(), "b.csv": 'a,b\n"x\ny",2\n'.encode(), "c.csv": "é;ü\n".encode("cp1252"), "d.csv": b""}
    got = {}
    for r in S.csv_rows(table(spark, files)).collect():
        got.setdefault(r.path, []).append((r.header, r.cells, r.delimiter, r.encoding))
    assert got["a.csv"] == [(True, ["Nom", "Valeur"], ";", "utf-8-sig"), (False, ["Alpha", "1"], ";", "utf-8-sig"), (False, ["Beta", ""], ";", "utf-8-sig")]
    assert [c for _, c, *_ in got["b.csv"]] == [["a", "b"], ["xy", "2"]] and got["c.csv"][0][1] == ["é", "ü"] and got["c.csv"][0][3] == "cp1252" and "d.csv" not in got


def test_archives_and_bad_files(spark):
    files = {"a.zip": zipped({"top/x.md": "# X", "top/sub/y.md": "y", "__MACOSX/z": ""}), "b.zip": b"no archive"}
    rows = S.members(table(spark, files))
    assert {r.path for r in rows.collect() if r.error} == {"b.zip"}
    assert sorted(r.inner for r in S.archive_paths(rows.where("error is null")).collect()) == ["sub/y.md", "x.md"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def test_word_files(spark):
    doc = zipped({
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="K"><w:basedOn w:val="H"/></w:style></w:styles>',
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="K"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:outlineLvl w:val="0"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="40"/></w:rPr><w:t>Big</w:t></w:r></w:p><w:p/><w:drawing/></w:body></w:document>',
        "word/_rels/document.xml.rels": RELS.format('<Relationship Id="r1" Target="media/a.png"/>'), "word/_rels/header1.xml.rels": RELS.format('<Relationship Id="r1" Target="media/h.png"/>'),
        "word/header1.xml": f"<w:hdr {W}/>", "word/media/a.png": "a", "word/media/h.png": "h", "word/media/o.png": "o",
        "docProps/core.xml": '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Core</dc:title></c>',
    })
    df = table(spark, {"a.docx": doc, "bad.docx": b"x"})
    got = [(r.level, r.number_id, r.number_level, r.bold, r["size"], r.text) for r in S.word_paragraphs(df).collect() if r.error is None]
    assert got == [(2, None, None, False, None, "Head"), (1, "7", 1, True, 20.0, "Big"), (None, None, None, False, None, "")]
    parts = {r.media: (r.role, r.markers["drawing"]) for r in S.office_parts(df).collect() if r.error is None}
    assert parts == {"word/media/a.png": ("content", 1), "word/media/h.png": ("header", 1), "word/media/o.png": ("other", 1)}
    assert {r.path: r.title for r in S.core_titles(df).collect()} == {"a.docx": "Core", "bad.docx": None}


def test_workbooks_and_chart_ranges(spark):
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = zipped({
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="Budget" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Target="worksheets/sheet1.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {s}><si><t>Month</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B2"><v>2</v></c><c r="B3"><v>3</v></c><c r="B4"><f>SUM(B2:B3)</f><v>5</v></c><c r="C1" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })
    cells = S.workbook_cells(table(spark, {"a.xlsx": book}))
    got = {(c.row_no, c.column_no): (c.value, c.formula) for c in cells.collect()}
    assert got == {(1, 1): ("Month", None), (2, 2): ("2", None), (3, 2): ("3", None), (4, 2): ("5", "=SUM(B2:B3)"), (1, 3): ("TRUE", None)}
    sheet, r1, c1, r2, c2 = S.cell_range("Budget!$B$2:$B$3")
    ranges = spark.createDataFrame([(sheet, r1, r2, c1, c2)], "sheet string, r1 int, r2 int, c1 int, c2 int")
    inside = R.in_range(cells, ranges, "row_no", "r1", "r2", 16, ["sheet"]).where("column_no between c1 and c2")
    assert sorted(c.value for c in inside.collect()) == ["2", "3"]
    assert S.cell_range("'It''s'!A1") == ("It's", 1, 1, 1, 1) and S.cell_range("x") is None


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "# A\n\nb")], "doc long, text string").coalesce(1).write.parquet(src)
    docs = spark.readStream.schema("doc long, text string").parquet(src)
    stream_chunks(docs, "text", ["doc"], str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    state = str(tmp_path / "state")
    for n in range(2):
        spark.createDataFrame([("k", n, f"v{n}")], "k string, version int, x string").coalesce(1).write.mode("append").parquet(str(tmp_path / "ch"))
        changes = spark.readStream.schema("k string, version int, x string").parquet(str(tmp_path / "ch"))
        stream_state(changes, ["k"], ["version"], state, str(tmp_path / "c2")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{state}/version=1").collect()] == [("k", 1, "v1")]
