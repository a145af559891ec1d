"""Queries over images and other assets of packages, cell styles and numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import scalars as S
from papyrion.operators import assets, flat, outline
from papyrion.operators import publishing as P
from papyrion.plans.tables import FLAT
from papyrion.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


IMAGES = """WITH i AS (SELECT DISTINCT package_id, block_no, src, coalesce(txt, '') AS txt, sha256(src) AS sha256 FROM blocks WHERE kind = 'image' AND src IS NOT NULL)"""


def _images(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "blocks").where("kind = 'image' and src is not null")
    return rows.select("package_id", "block_no", "src", F.coalesce("txt", F.lit("")).alias("txt"), F.sha2("src", 256).alias("sha256")).distinct()


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return P.package_documents(table(spark, folder, "packages"), table(spark, folder, "blocks"), "package_id").select("package_id", F.col("publication_markdown").alias("text"))


@query(IMAGES + """ SELECT package_id, CAST(row_number() OVER (PARTITION BY package_id ORDER BY block_no) AS INTEGER) AS ref_no, txt AS alt, src AS target FROM i WHERE package_id IN (SELECT package_id FROM packages)""")
def image_references(spark: SparkSession, folder: str) -> DataFrame:
    return assets.references(_texts(spark, folder), "text", ["package_id"])


@query(IMAGES + """ SELECT DISTINCT package_id, src AS target FROM i WHERE package_id IN (SELECT package_id FROM packages) AND block_no > 2 AND NOT EXISTS (SELECT 1 FROM i j WHERE j.package_id = i.package_id AND j.src = i.src AND j.block_no <= 5)
AND NOT regexp_matches(src, '^(?:https?://|data:|#|/)')""")
def images_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Images shown from the third block on whose file is not among those of the first six."""
    images = _images(spark, folder).join(table(spark, folder, "packages").select("package_id").distinct(), "package_id", "left_semi")
    files = images.where("block_no <= 5").select("package_id", F.col("src").alias("file"))
    return assets.broken(images.where("block_no > 2").select("package_id", F.col("src").alias("target")), files, ["package_id"])


@query(IMAGES + """, a AS (SELECT package_id, block_no, src, 'kept/' || block_no || '.png' AS file, row_number() OVER (PARTITION BY package_id ORDER BY block_no) AS position FROM i), p AS (SELECT package_id, src, arg_max(file, position) AS file FROM a GROUP BY ALL)
SELECT i.package_id, i.block_no AS ref_no, p.file FROM i JOIN p ON p.package_id = i.package_id AND p.src = i.src""")
def images_resolved(spark: SparkSession, folder: str) -> DataFrame:
    images = _images(spark, folder)
    no = F.row_number().over(assets.Window.partitionBy("package_id").orderBy("block_no"))
    saved = images.select("package_id", no.alias("position"), F.col("src").alias("source_name"), F.concat(F.lit("kept/"), F.col("block_no").cast("string"), F.lit(".png")).alias("file"))
    refs = images.select("package_id", F.col("block_no").alias("ref_no"), F.col("src").alias("target"))
    return assets.resolved(refs, saved, "package_id").select("package_id", "ref_no", "file")


@query(IMAGES + """, s AS (SELECT package_id, sha256, min(src) AS file FROM i WHERE block_no < 10 GROUP BY ALL) SELECT i.package_id, i.block_no, s.file FROM i LEFT JOIN s ON s.package_id = i.package_id AND s.sha256 = i.sha256""")
def members_by_content(spark: SparkSession, folder: str) -> DataFrame:
    images = _images(spark, folder)
    saved = images.where("block_no < 10").select("package_id", "sha256", F.col("src").alias("file"))
    return assets.by_content(images, saved, "package_id").select("package_id", "block_no", "file")


@query(IMAGES + r""", n AS (SELECT i.package_id, sha256, min(src) AS member FROM i WHERE NOT EXISTS (SELECT 1 FROM i s WHERE s.package_id = i.package_id AND s.sha256 = i.sha256 AND s.block_no < 10) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY member) AS k FROM n)
SELECT package_id, sha256, member, 'recovered_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || regexp_extract(member, '(\.[^./]+)$', 1) AS file FROM k""")
def members_recovered(spark: SparkSession, folder: str) -> DataFrame:
    images = _images(spark, folder)
    saved = images.where("block_no < 10").select("package_id", "sha256", F.col("src").alias("file"))
    refs = images.select("package_id", F.col("src").alias("target"))
    return assets.recovered(images.select("package_id", "sha256", F.col("src").alias("member")), saved, refs, "package_id", "recovered")


@query(IMAGES + """, a AS (SELECT package_id, sha256, substr(sha256, 1, 1) AS dhash, src AS file FROM i WHERE block_no < 10), e AS (SELECT package_id, sha256, min(file) AS f FROM a GROUP BY ALL), d AS (SELECT package_id, dhash, min(file) AS f FROM a GROUP BY ALL HAVING count(*) = 1)
SELECT i.package_id, i.block_no, coalesce(e.f, d.f) AS file FROM i LEFT JOIN e ON e.package_id = i.package_id AND e.sha256 = i.sha256 LEFT JOIN d ON d.package_id = i.package_id AND d.dhash = substr(i.sha256, 1, 1)""")
def payloads_matched(spark: SparkSession, folder: str) -> DataFrame:
    images = _images(spark, folder).withColumn("dhash", F.substring("sha256", 1, 1))
    known = images.where("block_no < 10").select("package_id", "sha256", "dhash", F.col("src").alias("file"))
    return assets.matched(images, known, "package_id").select("package_id", "block_no", "file")


@query(IMAGES + """, r AS (SELECT DISTINCT package_id, src, CASE WHEN block_no < 3 THEN 'header' WHEN block_no > 12 THEN 'footer' ELSE 'body' END AS role FROM i) SELECT package_id, src AS file, string_agg(role, ',' ORDER BY role) AS roles, bool_and(role <> 'body') AS furniture FROM r GROUP BY package_id, src""")
def image_roles(spark: SparkSession, folder: str) -> DataFrame:
    role = F.when(F.col("block_no") < 3, "header").when(F.col("block_no") > 12, "footer").otherwise("body")
    found = assets.roles(_images(spark, folder).select("package_id", F.col("src").alias("file"), role.alias("role")), "package_id")
    return found.select("package_id", "file", F.array_join("roles", ",").alias("roles"), "furniture")


@query(FLAT + r""", t AS (SELECT package_id, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY block_no) FILTER (WHERE md <> ''), '') || chr(10) AS md FROM m WHERE package_id IN (SELECT package_id FROM packages) GROUP BY package_id), g AS (SELECT package_id, list(DISTINCT src) AS srcs FROM b WHERE kind = 'image' AND src IS NOT NULL GROUP BY package_id)
SELECT package_id, regexp_replace(list_reduce(list_prepend(md, srcs), lambda a, s: regexp_replace(a, '!\[[^\]]*\]\(' || regexp_escape(s) || '[^)]*\)', '', 'g')), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM t JOIN g USING (package_id)""")
def texts_without_images(spark: SparkSession, folder: str) -> DataFrame:
    targets = _images(spark, folder).groupBy("package_id").agg(F.collect_set("src").alias("targets"))
    return _texts(spark, folder).join(targets, "package_id").select("package_id", assets.without_images(F.col("text"), F.col("targets")).alias("text"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS width, CAST(p_size + 7 AS INTEGER) AS height FROM part")
def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    word = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), word(F.col("p_size")), word(F.col("p_size") + 7))
    files = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("path"), head.alias("content"))
    return assets.image_sizes(files).select(F.col("path").cast("long").alias("p_partkey"), "width", "height")


# ------------------------------------------------------------ cells and numbers


CELLS = r"""WITH b AS (SELECT DISTINCT package_id, block_no, txt FROM blocks WHERE kind = 'table' AND txt IS NOT NULL), l AS (SELECT package_id, block_no, unnest(string_split(txt, chr(10))) AS line, unnest(range(1, len(string_split(txt, chr(10))) + 1)) AS r FROM b), c AS (SELECT *, string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|') AS cs FROM l WHERE trim(line) <> ''),
x AS (SELECT package_id, block_no, CAST(r AS INTEGER) AS row_no, CAST(unnest(range(1, len(cs) + 1)) AS INTEGER) AS cell_no, trim(unnest(cs)) AS cell FROM c)"""


@query(CELLS + """, s AS (SELECT package_id, block_no, row_no, row_number() OVER (PARTITION BY package_id, block_no, row_no ORDER BY cell_no) AS cell_no, 's' || length(cell) AS style FROM x WHERE NOT regexp_matches(cell, '^[0-9]+$')) SELECT x.*, s.style FROM x JOIN s USING (package_id, block_no, row_no, cell_no)""")
def cell_styles(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with the styles of those in the same place, where cells of a number alone go on with the one above."""
    cells = flat.table_cells(table(spark, folder, "blocks").where("kind = 'table' and txt is not null").select("package_id", "block_no", "txt").distinct(), ["package_id", "block_no"], "txt").withColumnRenamed("column_no", "cell_no")
    styles = cells.select("package_id", "block_no", "row_no", "cell_no", F.col("cell").rlike("^[0-9]+$").alias("merged"), F.concat(F.lit("s"), F.length("cell").cast("string")).alias("style"))
    return outline.cell_styles(cells, styles, ["package_id", "block_no"]).select("package_id", "block_no", "row_no", "cell_no", "cell", "style")


@query("""WITH n AS (SELECT DISTINCT package_id AS doc, space_key AS number_id, source_format AS abstract_id FROM packages), a AS (SELECT DISTINCT package_id AS doc, source_format AS abstract_id, block_count AS level, lang AS form FROM packages) SELECT n.doc, number_id, level, 1 AS start, form, '%1' AS text FROM n JOIN a ON a.doc = n.doc AND a.abstract_id = n.abstract_id""")
def numbering_levels(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "packages")
    numbers = packages.select(F.col("package_id").alias("doc"), F.col("space_key").alias("number_id"), F.col("source_format").alias("abstract_id")).distinct()
    abstracts = packages.select(F.col("package_id").alias("doc"), F.col("source_format").alias("abstract_id"), F.col("block_count").alias("level"), F.lit(1).alias("start"), F.col("lang").alias("form"), F.lit("%1").alias("text")).distinct()
    return outline.numbering_levels(numbers, abstracts)


@query(r"""SELECT DISTINCT package_id, '<p>[[_TOC_]]</p><img src="attachments/' || package || '.png"/><div>' || coalesce(lang, '') || '</div>' AS html FROM packages""")
def storage_pages(spark: SparkSession, folder: str) -> DataFrame:
    storage = F.concat(F.lit('<ac:structured-macro ac:name="toc"/><ac:image ac:width="5"><ri:attachment ri:filename="'), F.col("package"), F.lit('.png"/></ac:image><ac:structured-macro ac:name="info"><ac:rich-text-body>'), F.coalesce("lang", F.lit("")), F.lit("</ac:rich-text-body></ac:structured-macro>"))
    return table(spark, folder, "packages").select("package_id", S.storage_to_html(storage).alias("html")).distinct()


@query(r"""SELECT DISTINCT package_id, 'title: "' || package || '"' AS head, coalesce(lang, 'x') || chr(10) || '---' AS body, package AS title FROM packages""")
def front_matters(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit('---\ntitle: "'), F.col("package"), F.lit('"\n---\n'), F.coalesce("lang", F.lit("x")), F.lit("\n---"))
    head, body = S.front_matter(text)
    return table(spark, folder, "packages").select("package_id", head.alias("head"), body.alias("body"), S.page_title_of(text, F.lit("a.md")).alias("title")).distinct()
