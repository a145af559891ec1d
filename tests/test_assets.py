import json
import struct

import pytest
from pyspark.sql import functions as F

from papyrion.operators import assets as A
from papyrion.operators import issues as I
from papyrion.sources import packages as P


def test_references_resolve_in_order_of_sureness(spark):
    text = "![a](media/x.png) ![b](other/y.png) ![c](image_3.png) ![d](gone.png) ![e](https://h/z.png)"
    refs = A.references(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, t string"), "t", ["doc"])
    saved = spark.createDataFrame([(1, 1, "media/x.png", "f1"), (1, 2, "media/y.png", "f2"), (1, 3, "media/w.png", "f3"), (1, 4, "media/x.png", "f4")], "doc long, position int, source_name string, file string")
    got = {r.target: r.file for r in A.resolved(refs, saved, "doc").collect()}
    assert got == {"media/x.png": "f4", "other/y.png": "f2", "image_3.png": "f3", "gone.png": "f1", "https://h/z.png": "f2"}
    files = spark.createDataFrame([(1, "media/x.png")], "doc long, file string")
    assert sorted(r.target for r in A.broken(refs, files, ["doc"]).collect()) == ["gone.png", "image_3.png", "other/y.png"]


def test_content_joins_and_recovery(spark):
    members = spark.createDataFrame([(1, "word/media/a.png", "h1"), (1, "word/media/b.png", "h2"), (1, "word/media/c.png", "h2"), (1, "word/media/z.png", "h9")], "doc long, member string, sha256 string")
    saved = spark.createDataFrame([(1, "i1.png", "h1", "d1"), (1, "i0.png", "h1", "d2"), (1, "i2.png", "h5", "d2")], "doc long, file string, sha256 string, dhash string")
    assert {r.member[-5:]: r.file for r in A.by_content(members, saved, "doc").collect()} == {"a.png": "i0.png", "b.png": None, "c.png": None, "z.png": None}
    refs = spark.createDataFrame([(1, "x/b.png"), (1, "c.png"), (1, "a.png")], "doc long, target string")
    assert [(r.sha256, r.file) for r in A.recovered(members, saved, refs, "doc", "media").collect()] == [("h2", "media_001.png")]
    payloads = spark.createDataFrame([(1, "h5", None), (1, "hx", "d1"), (1, "hy", "d2"), (1, "hz", None)], "doc long, sha256 string, dhash string")
    assert {r.sha256: r.file for r in A.matched(payloads, saved, "doc").collect()} == {"h5": "i2.png", "hx": "i1.png", "hy": None, "hz": None}


def test_roles_and_rewriting(spark):
    a = spark.createDataFrame([(1, "x", "header"), (1, "x", "footer"), (1, "y", "header"), (1, "y", "body")], "doc long, file string, role string")
    assert {r.file: r.furniture for r in A.roles(a, "doc").collect()} == {"x": True, "y": False}
    t = spark.createDataFrame([("a\n\n![h](h(1).png)\n\n![b](b.png)",)], "t string")
    assert t.select(A.without_images(F.col("t"), F.array(F.lit("b.png")))).first()[0] == "a\n\n![h](h(1).png)\n\n"
    pairs = F.array(F.struct(F.lit("b.png").alias("target"), F.lit("images/1.png").alias("file")))
    assert t.select(A.rewritten(F.col("t"), pairs)).first()[0].endswith("![b](images/1.png)")


@pytest.mark.parametrize("content,size", [
    (b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9), (7, 9)), (b"GIF89a" + struct.pack("<HH", 3, 4), (3, 4)),
    (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 8, (6, 5)), (b"", None), (b"\x89PNG", None), (b"text", None),
])
def test_image_size(content, size):
    assert A.image_size(content) == size


def test_issue_document(spark):
    issues = spark.createDataFrame([("K-1", "Sum", "Bug", None, "P", "", "Text", 3)], "key string, summary string, issue_type string, status string, project string, assignee string, description string, comment_total int")
    c = "issue string, comment_id string, author string, created string, body string"
    one = spark.createDataFrame([("K-1", "1", "a", "2024-01-02", "x")], c)
    two = spark.createDataFrame([("K-1", "1", "a", "2024-01-02", "other"), ("K-1", None, "b", "2024-01-01", "y"), ("K-1", None, "b", "2024-01-01", "y")], c)
    comments = I.comments_of([one, two])
    assert sorted((r.comment_id or "", r.body) for r in comments.collect()) == [("", "y"), ("1", "x")]
    assert I.missing_comments(issues, comments).count() == 1
    files = spark.createDataFrame([("K-1", "f/1.png", "p.png", "image/png"), ("K-1", "f/2.pdf", "d_1.pdf", "application/pdf")], "issue string, file string, filename string, mime_type string")
    rows = sorted(I.issue_blocks(issues, comments, files).collect(), key=lambda r: (r.section, r.position))
    assert [r.txt for r in rows] == ["Sum", "Issue: K-1", "Type: Bug", "Project: P", "Text", "Comments", "b — 2024-01-01", "y", "a — 2024-01-02", "x", "Attachments", "p.png", "[d\\_1.pdf](f/2.pdf)"]


def test_packages_and_corpus(spark, tmp_path):
    for name, outputs in (("a", {"rag_markdown": "own.md"}), ("b", {}), ("c", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps({"outputs": outputs, "source": {"sha256": "f" * 64}}) if outputs is not None else "{bad")
        (tmp_path / name / ("own.md" if name == "a" else f"{name}.rag.md")).write_text("# T\n\nx")
    packages = P.manifests(spark, str(tmp_path))
    found = P.outputs(spark, str(tmp_path), packages, "rag_markdown", r"\.rag\.md$")
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["b.rag.md", "c.rag.md", "own.md"]
    docs = spark.createDataFrame([("p1", "f" * 64, "# A\n\nb"), ("p2", None, "c"), ("p3", "", "")], "package string, sha string, t string")
    P.write_corpus(docs, "t", "package", "sha", str(tmp_path / "corpus"))
    assert tuple(spark.read.json(str(tmp_path / "corpus/summary")).select("documents", "chunks").first()) == (2, 2)
    assert {r.document_id for r in spark.read.json(str(tmp_path / "corpus/index")).collect()} == {"f" * 16, "p2"}
