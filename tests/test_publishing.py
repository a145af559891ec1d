import json

import oracle
import pytest
from pyspark.sql import functions as F

from papyrion.functions import scalars
from papyrion.operators import issues, outline
from papyrion.operators import publishing as P
from papyrion.plans import files as plans
from papyrion.sources import packages

PACKAGES = "package_id long, package string, title string, original_path string, source_sha256 string"
BLOCKS = "package_id long, block_no int, kind string, heading_level int, txt string, src string"


def documents(spark):
    packages = spark.createDataFrame([(1, "a__md", "A", "/x/a b.md", "f" * 64)] * 2 + [(2, "b", None, None, None), (3, "empty", "E", "/x/e.md", None)], PACKAGES)
    blocks = spark.createDataFrame([(1, 0, "heading", 1, "Head", None), (1, 1, "image", None, "alt", "i.png"), (1, 1, "image", None, "alt", "i.png"), (1, 2, "paragraph", None, "a < b", None), (1, 3, "image", None, None, "i.png"), (2, 0, "image", None, None, None)], BLOCKS)
    return P.package_documents(packages, blocks, "package_id")


def test_files_of_a_package(spark, tmp_path):
    files = P.package_files(documents(spark), "package_id")
    got = {(r.package_id, r.file): r.content for r in files.collect()}
    assert len(got) == 12 and {k for k, _ in got} == {1, 2}
    assert got[1, "render_document.md"] == "# Head\n\n![alt](i.png)\n\na < b\n\n![](i.png)\n"
    assert got[1, "render_document.rag.md"] == "# Head\n\n![alt](i.png)\n\na < b\n"
    assert got[1, "render_document.html"].split("\n")[:3] == ["<h1>Head</h1>", '<img src="i.png" alt="alt"/>', "<p>a &lt; b</p>"]
    assert [b["kind"] for b in json.loads(got[1, "document.json"])["blocks"]] == ["heading", "image", "paragraph", "image"]
    manifest = json.loads(got[1, "manifest.json"])
    assert manifest["source"] == {"sha256": "f" * 64, "original_path": "/x/a b.md"} and manifest["images"] == ["i.png"] and manifest["outputs"]["chunks"] == "chunks.jsonl"
    assert [json.loads(x)["id"] for x in got[1, "chunks.jsonl"].split("\n") if x] == list(range(1, 1 + manifest["n_chunks"]))
    P.write_packages(files, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).where("file = 'render_document.md' and package like 'a b__md%'").collect()
    assert [r.value for r in back] == [got[1, "render_document.md"] + "\n"]
    assert P.package_files(documents(spark).limit(0), "package_id").count() == 0


def test_bundles_hold_every_file_and_make_folders(spark, tmp_path):
    files = P.package_files(documents(spark), "package_id")
    P.write_bundles(files, str(tmp_path / "bundles"))
    back = packages.bundled_files(spark, str(tmp_path / "bundles"))
    assert sorted(map(tuple, back.collect())) == sorted((str(r.package_id), r.package_dir, r.file, r.content) for r in files.collect())
    found = {r.key: r for r in packages.bundled_manifests(spark, str(tmp_path / "bundles")).collect()}
    assert set(found) == {"1", "2"} and found["1"].source.original_path == "/x/a b.md" and found["1"].rag_ready and len(found["1"].outputs) == 5
    P.write_packages(back.where("key = '1'"), str(tmp_path / "folders"))
    assert [r.source.sha256 for r in packages.written_manifests(spark, str(tmp_path / "folders")).collect()] == ["f" * 64]


def test_bundles_on_disk_do_not_grow_with_packages(spark, tmp_path):
    # write_packages makes a file and a folder of each, and none of no package at all
    n = 300
    files = spark.range(n, numPartitions=2).select("id", F.lit("p").alias("package_dir"), F.explode(F.array(F.lit("manifest.json"), F.lit("a.md"))).alias("file"), F.lit("{}").alias("content"))
    for name, rows, most in (("all", files, 4), ("none", files.limit(0), 1)):
        target = tmp_path / name
        P.write_bundles(rows, str(target))
        assert packages.bundled_manifests(spark, str(target)).count() == (n if name == "all" else 0)
        assert len([p for p in target.rglob("*.parquet") if p.is_file()]) <= most


def test_written_packages_are_few_files_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(plans, "shared_path", lambda spark, label: str(tmp_path / label))
    found = plans.packages_written(spark, str(oracle.DATA)).count()
    assert found > 30 and len([p for p in (tmp_path / "packages").rglob("*") if p.is_file()]) < found


def test_legacy_view(spark):
    text = "![a](h.png)\n\n![b](x.png) and ![c](x.png)\n\n**\n\n\n\ntail ![d](y.png 'z')\n"
    df = spark.createDataFrame([(text,), ("",)], "t string")
    got = [r[0] for r in df.select(P.legacy_view(F.col("t"), F.array(F.lit("h.png")))).collect()]
    assert got == ["![b](x.png) and\n\ntail ![d](y.png 'z')\n".replace("and\n", "and \n"), "\n"]


def test_state_of_primaries_and_copies(spark):
    s = "instance string, space string, parent_id string, page_id string, title string, source string, role string, at int"
    state = spark.createDataFrame([("i", "S", "1", "10", "old", "a.md", None, 1), ("i", "S", "1", "11", "copy", "a.md", "copy", 1)], s)
    new = spark.createDataFrame([("i", "S", "1", "12", "new", "a.md", "primary", 2), ("i", "S", "1", "11", "copy again", "a.md", "copy", 2), ("i", "S", "2", "13", "other", "a.md", "primary", 2)], s)
    assert sorted((r.page_id, r.title, r.role) for r in P.publication_state(state, new, ["at"]).collect()) == [("11", "copy again", "copy"), ("12", "new", "primary"), ("13", "other", "primary")]


def test_inputs_named_by_manifests_win(spark):
    files = spark.createDataFrame([("p/a.md",), ("p/b.md",), ("q/c.rag.md",), ("q/d.raw.md",), ("q/E.MD",), ("q/f.txt",)], "path string")
    assert {r.path for r in P.publication_inputs(files).collect()} == {"p/a.md", "p/b.md", "q/E.MD"}
    assert {r.path for r in P.publication_inputs(files, spark.createDataFrame([("p", "b.md")], "dir string, name string")).collect()} == {"p/b.md"}
    assert {r.path for r in P.publication_inputs(files, spark.createDataFrame([("z", "b.md")], "dir string, name string")).collect()} == {"p/a.md", "p/b.md", "q/E.MD"}


def test_text_to_publish(spark):
    df = spark.createDataFrame([("---\ntitle: old\nspace_key: S\nowner: me\n---\n<!-- confluence-page-id: 7 -->\nbody\n\n",), ("plain",)], "t string")
    got = [r[0] for r in df.select(P.publication_text(F.col("t"), F.lit('A "b"'), F.lit("9"))).collect()]
    assert got == ['---\nowner: me\ntitle: "A \\"b\\""\npage_id: "9"\n---\n\nbody\n', '---\ntitle: "A \\"b\\""\npage_id: "9"\n---\n\nplain\n']


def test_more_than_999_names(spark):
    media = spark.range(1102).select(F.lit(1).alias("doc"), F.col("id").cast("string").alias("sha256"), F.lit("header").alias("role"), F.format_string("%05d.png", "id").alias("name"))
    files = {r.file for r in P.header_media(media, media.limit(0).select("doc", "sha256", F.col("name").alias("file")), "doc").collect()}
    assert len(files) == 1102 and {"header_001.png", "header_999.png", "header_1000.png", "header_1102.png"} <= files


def test_media_and_attachments(spark):
    a = "doc long, position int, saved boolean, file string, attachment_id string, content string, thumbnail string, self string, filename string, mime_type string"
    own = spark.createDataFrame([(1, 1, True, "attachments/p.png", "77", "https://t/content/77", None, None, "p.png", "image/png"), (1, 2, True, "attachments/d.pdf", "78", None, None, None, "d.pdf", None), (1, 3, False, "attachments/lost.png", "79", None, None, None, "lost.png", "image/png")], a)
    refs = spark.createDataFrame([(1, 1, "https://t/x/77", "", None), (1, 2, "uuid", "d.pdf", None), (1, 3, "uuid", "", "77"), (1, 4, "lost.png", "", None), (2, 5, "77", "", None)], "doc long, ref_no int, target string, alt string, media_id string")
    assert {r.ref_no: r.file for r in issues.rewritten_media(refs, own, "doc").collect()} == {1: "attachments/p.png", 2: "attachments/d.pdf", 3: "attachments/p.png", 4: None, 5: None}
    shown = spark.createDataFrame([(1, "attachments/lost.png")], "doc long, src string")
    assert sorted((r.position, r.kind, r.src) for r in issues.attachment_blocks(own, shown, "doc").collect()) == [(1, "image", "attachments/p.png"), (2, "paragraph", None), (3, "paragraph", None)]


def test_heading_numbers_by_definition():
    forms = {"5": {0: (1, "upperRoman", "%1."), 1: (3, "decimal", "%1.%2"), 2: (1, "lowerLetter", "(%3)")}}
    assert outline.numbers([("5", 0), ("5", 1), ("5", 1), ("5", 2), ("5", 0), ("5", 2), (None, 0), ("0", 1), ("9", 0)], forms) == ["I.", "I.3", "I.4", "(a)", "II.", "(a)", "", "", "1."]
    assert outline.numbers([("1", 0), ("1", 2), ("1", 1)]) == ["1", "1.1.1", "1.2"]
    assert outline.shown_number(18279, "upperLetter") == "AAAA" and outline.shown_number(4, "lowerRoman") == "iv"


def test_headings_meet_in_order(spark):
    assert outline.merged([("One", "1"), ("Two", "2"), ("One", "3")], ["one", "Three", "ONE", "two"]) == ["1", None, "3", None]
    heads = spark.createDataFrame([(1, 1, "One"), (1, 2, "2 Two"), (2, 1, "x")], "doc long, position long, heading string")
    source = spark.createDataFrame([(1, 1, "One", "1"), (1, 2, "Two", "2")], "doc long, position long, title string, number string")
    assert {(r.doc, r.position): r.heading for r in outline.numbered_headings(source, heads, "doc").collect()} == {(1, 1): "1 One", (1, 2): "2 Two", (2, 1): "x"}


def test_styles_of_cells_and_outline_sources(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "c")], "t long, row_no int, cell_no int, txt string")
    styles = spark.createDataFrame([(1, 1, 1, True, "up"), (1, 1, 2, False, "s1"), (1, 1, 3, None, "s2")], "t long, row_no int, cell_no int, merged boolean, style string")
    assert sorted((r.txt, r.style) for r in outline.cell_styles(cells, styles, ["t"]).collect()) == [("a", "s1"), ("b", "s2")]
    df = spark.createDataFrame([([], ["m"]), (None, None)], "a array<string>, b array<string>")
    name, entries = outline.dispatched(first=F.col("a"), second=F.col("b"))
    assert [tuple(r) for r in df.select(name, entries).collect()] == [("second", ["m"]), ("none", [])]


def test_levels_of_a_numbering(spark):
    numbers = spark.createDataFrame([(1, "5", "a1")], "doc long, number_id string, abstract_id string")
    abstracts = spark.createDataFrame([(1, "a1", 0, 1, "upperRoman", "%1."), (1, "a2", 0, 1, "decimal", "%1")], "doc long, abstract_id string, level int, start int, form string, text string")
    levels = outline.numbering_levels(numbers, abstracts)
    heads = spark.createDataFrame([(1, 1, "One", "5", 0), (1, 2, "Two", "5", 0)], "doc long, position long, title string, number_id string, number_level int")
    assert [(r.position, r.number) for r in outline.source_numbers(heads, levels, "doc").collect()] == [(1, "I."), (2, "II.")]


def test_replaced_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "package")
    write = lambda n: lambda to: spark.range(n).write.parquet(to)
    packages.replaced(spark, target, write(1))
    packages.replaced(spark, target, write(2), lambda old, new: spark.read.parquet(old).write.parquet(f"{new}/carried"))
    assert spark.read.parquet(f"{target}/*.parquet").count() == 2 and spark.read.parquet(f"{target}/carried").count() == 1

    def fails(to):
        write(3)(to)
        raise RuntimeError("no")

    for build, carry in ((fails, None), (write(4), lambda old, new: fails(f"{new}/x"))):
        with pytest.raises(RuntimeError):
            packages.replaced(spark, target, build, carry)
    assert spark.read.parquet(f"{target}/*.parquet").count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["package"]


def test_errors_in_one_line():
    try:
        try:
            raise KeyError()
        except KeyError as e:
            raise ValueError("bad\n  value") from e
    except ValueError as e:
        assert scalars.error_text(e) == "bad value (KeyError)"
