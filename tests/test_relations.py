from pyspark.sql import functions as F

from papyrion.functions import scalars as S
from papyrion.operators import flat
from papyrion.operators import relations as R


def test_free_titles_finds_the_first_gap(spark):
    remote = spark.createDataFrame([("s", t) for t in ("A", "a (2)", "A (4)", "B (2)")], "space string, title string")
    asked = spark.createDataFrame([(1, "s", "A"), (2, "s", "B"), (3, "t", "A")], "request_id long, space string, title string")
    assert {r.request_id: r.free_title for r in R.free_titles(asked, remote).collect()} == {1: "A (3)", 2: "B", 3: "A"}


def test_publish_plan_decisions(spark):
    remote = spark.createDataFrame([("s", "1", "A"), ("s", "2", "B"), ("s", "3", "b")], "space string, page_id string, title string")
    asked = spark.createDataFrame([(1, "s", "a", None), (2, "s", "B", None), (3, "s", "New", None), (4, "s", "Other", "1"), (5, "s", "A", "2"), (6, "s", "New", "99")], "request_id long, space string, title string, known_page string")
    plan = {r.request_id: (r.action, r.page_id) for r in R.publish_plan(asked, remote, "replace").collect()}
    assert plan == {1: ("update", "1"), 2: ("error", None), 3: ("create", None), 4: ("update", "1"), 5: ("error", None), 6: ("create", None)}
    assert {r.request_id: r.title for r in R.publish_plan(asked.where("request_id in (1, 3)"), remote, "add").collect()} == {1: "a (2)", 3: "New"}


def test_clamped_positions(spark, rows):
    left = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 1)], "k string, i int")
    right = spark.createDataFrame([("a", 10), ("a", 11)], "k string, j int")
    right = right.withColumnRenamed("j", "occ")
    left = left.withColumnRenamed("k", "src")
    right = right.withColumnRenamed("k", "src")
    assert rows(R.clamped_positions(left, right, ["src"], ["i"], ["occ"]), "i", "occ") == [(0, 10), (1, 11), (2, 11), (3, 11)]


def test_heading_numbers_with_skipped_levels(spark):
    levels = [1, 3, 2, 2, 1, 2, 3, 3, 1]
    df = spark.createDataFrame([(1, i, lv) for i, lv in enumerate(levels)], "doc int, at int, level int")
    got = [r.number for r in sorted(R.heading_numbers(df, ["doc"], "at", "level", 3).collect(), key=lambda r: r["at"])]
    assert got == ["1", "1.1.1", "1.2", "1.3", "2", "2.1", "2.1.1", "2.1.2", "3"]


def test_upsert_and_union(spark, rows):
    state = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept"), (None, 1, "n")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("c", 1, "c"), ("a", 2, "new")], "k string, v int, x string")
    assert rows(R.upsert(state, new, ["k"], ["v"]), "k", "x") == sorted([("a", "new"), ("b", "kept"), ("c", "c"), (None, "n")], key=repr)
    assert rows(R.union_first([new.where("k = 'c'"), new], ["k"], ["v", "x"]), "k", "source_no") == [("a", 1), ("b", 1), ("c", 0)]


def test_scalars(spark):
    df = spark.createDataFrame([("Color: RED; color : blue;x;font:",)], "css string")
    r = df.select(S.style_map(F.col("css")).alias("m"), S.hex_color(F.lit("#a0b1C2")).alias("h"), S.hex_color(F.lit("auto")).alias("n"), S.safe_stem(F.lit("  ü?.md ")).alias("s"), S.safe_stem(F.lit("??")).alias("d")).first()
    assert (r.m, r.h, r.n, r.s, r.d) == ({"color": "blue"}, "#A0B1C2", None, "md", "document")
    g = df.select(S.git_provider(F.lit("https://github.com/a/b.git")).alias("a"), S.git_provider(F.lit("https://git.x.org/g/sub/p/")).alias("b")).first()
    assert tuple(g.a) == ("github", "github.com", "a/b") and tuple(g.b) == ("gitlab", "git.x.org", "g/sub/p")
    t = df.select(S.clean_title(F.lit(" Document1 ")).alias("a"), S.clean_title(F.lit("Microsoft Word - x.docx")).alias("b"), S.clean_title(F.lit("a\n b")).alias("c")).first()
    assert tuple(t) == (None, None, "a b")
    n = spark.range(1, 1200).select("id", S.numeral(F.col("id"), F.lit("lowerRoman")).alias("r"), S.numeral(F.col("id"), F.lit("upperLetter")).alias("l")).collect()
    named = {x.id: (x.r, x.l) for x in n}
    assert named[4][0] == "iv" and named[1194][0] == "mcxciv" and named[26][1] == "Z" and named[27][1] == "AA" and named[702][1] == "ZZ" and named[703][1] == "AAA"
    z = spark.createDataFrame([(5, 10), (4000, 1000), (100, 50), (None, 3)], "w int, h int").select(S.display_size(F.col("w"), F.col("h"), 12, 1800).alias("s")).collect()
    assert [tuple(x.s) if x.s else None for x in z] == [(6, 12), (1800, 450), (100, 50), None]
    f = spark.createDataFrame([("Éa  –’", "abcd", "bcde")], "a string, b string, c string").select(S.folded("a").alias("f"), S.likeness("b", "c").alias("r")).first()
    assert f.f == "ea -'" and f.r == 0.75


def test_storage_and_front_matter(spark):
    s = spark.createDataFrame([('<ac:structured-macro ac:name="toc"/><ac:image><ri:attachment ri:filename="a.png"/></ac:image><ac:rich-text-body>x</ac:rich-text-body>', "---\ntitle: T\n---\n# H\n", "a/my_file.md")], "s string, m string, p string")
    head, body = S.front_matter(F.col("m"))
    r = s.select(S.storage_to_html(F.col("s")).alias("h"), head.alias("a"), body.alias("b"), S.page_title_of(F.col("m"), F.col("p")).alias("t")).first()
    assert r.h == '<p>[[_TOC_]]</p><img src="attachments/a.png"/><div>x</div>' and (r.a, r.b, r.t) == ("title: T", "# H\n", "T")


def test_image_extension(spark):
    df = spark.createDataFrame([("x.PNG", None, None), ("x", "image/gif", None), (None, None, bytearray(b"\xff\xd8\xff\x00")), (None, None, None)], "n string, m string, b binary")
    assert [r.e for r in df.select(S.image_extension(F.col("n"), F.col("m"), F.col("b")).alias("e")).collect()] == [".png", ".gif", ".jpg", ".bin"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "package_id long, block_no int, kind string, heading_level int, txt string, src string")
    assert flat.documents(none, "package_id", "block_no").count() == 0
    assert R.duplicate_stats(none.select(F.col("txt").alias("d")), "d").first().duplicates == 0


def test_letters_of_any_length(spark):
    def letters(n):
        out = ""
        while n:
            n, rem = divmod(n - 1, 26)
            out = chr(65 + rem) + out
        return out

    numbers = [1, 26, 27, 702, 703, 18278, 18279, 20000, 475254, 475255, 10**12, 2**63 - 1]
    got = {r.n: r.l for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", S.numeral(F.col("n"), F.lit("upperLetter")).alias("l")).collect()}
    assert got == {n: letters(n) for n in numbers}


def test_whole_tables_for_numerals_and_cascade(spark, tmp_path):
    from papyrion.plans import catalogue

    spark.createDataFrame([(n,) for n in (1, 3999, 4000, 20000, 20000)], "l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(r.n for r in catalogue.QUERIES["numerals"](spark, str(tmp_path)).collect()) == [1, 3999, 4000, 20000]
    spark.createDataFrame([(1, "s", "en", "md"), (2, "s", "en", "pdf"), (7, "t", "fr", "md")], "package_id long, space_key string, lang string, source_format string").write.parquet(str(tmp_path / "packages.parquet"))
    got = {r.request_id: (r.value, r.level) for r in catalogue.QUERIES["state_cascade"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 7: (7, 0)}
