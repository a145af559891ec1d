"""Queries of the scalar functions over columns of the tables, each held against SQL; and of comments and issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import scalars as S
from papyrion.operators import issues, office
from papyrion.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HREF = r"\]\(([^)\s]+)\)"
LINKS = rf"""WITH l AS (SELECT DISTINCT package_id, block_no, unnest(regexp_extract_all(txt, '{HREF}', 1)) AS href FROM web_blocks) """


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "web_blocks").select("package_id", "block_no", F.explode(F.regexp_extract_all("txt", F.lit(HREF), 1)).alias("href")).distinct()


@query(LINKS + """SELECT package_id, block_no, href, CASE WHEN lower(trim(split_part(href, ':', 1))) NOT IN ('javascript', 'data', 'vbscript') THEN href END AS safe, CASE WHEN href = '' OR regexp_matches(href, '^(?:https?://|data:|#|/)') THEN href ELSE 'attachments/' || href END AS below FROM l""")
def link_targets(spark: SparkSession, folder: str) -> DataFrame:
    href = F.col("href")
    return _links(spark, folder).select("package_id", "block_no", "href", S.safe_link(href).alias("safe"), S.with_prefix(href, "attachments/").alias("below"))


@query("""SELECT DISTINCT package_id, CASE WHEN regexp_matches(upper(substr(source_sha256, 1, 6)), '^[0-9A-F]{6}$') THEN '#' || upper(substr(source_sha256, 1, 6)) END AS colour, CASE WHEN regexp_matches(upper(regexp_replace(package, '^#', '')), '^[0-9A-F]{6}$') THEN '#' || upper(package) END AS none FROM packages""")
def colours(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packages").select("package_id", S.hex_color(F.concat(F.lit(" #"), F.substring("source_sha256", 1, 6))).alias("colour"), S.hex_color(F.col("package")).alias("none")).distinct()


@query("""WITH s AS (SELECT p_partkey, p_size * 40.0 AS w, p_retailprice AS h, 4.0 * p_size AS w2 FROM part), u AS (SELECT *, CASE WHEN w < 12 AND h < 12 THEN 12 / greatest(w, h) ELSE 1.0 END AS up, CASE WHEN w2 < 12 AND w2 / 2 < 12 THEN 12 / w2 ELSE 1.0 END AS up2 FROM s)
SELECT p_partkey, CAST(greatest(1, round_even(w * up * least(1.0, 1800 / greatest(w * up, h * up)), 0)) AS INTEGER) AS width, CAST(greatest(1, round_even(h * up * least(1.0, 1800 / greatest(w * up, h * up)), 0)) AS INTEGER) AS height, CAST(greatest(1, round_even(w2 * up2 * least(1.0, 1800 / (w2 * up2)), 0)) AS INTEGER) AS small_width FROM u""")
def display_sizes(spark: SparkSession, folder: str) -> DataFrame:
    size = S.display_size(F.col("p_size") * 40.0, F.col("p_retailprice"), 12, 1800)
    little = S.display_size(F.col("p_size") * 4.0, F.col("p_size") * 2.0, 12, 1800)
    return table(spark, folder, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), little["width"].alias("small_width"))


@query(r"""SELECT DISTINCT package_id, original_path, CASE WHEN e <> '' THEN e WHEN source_format = 'pdf' THEN '.png' WHEN source_format = 'html' THEN '.svg' ELSE '.bin' END AS extension FROM (SELECT *, regexp_extract(lower(coalesce(original_path, '')), '(\.(?:png|jpe?g|gif|webp|svg|bmp|tiff?))$', 1) AS e FROM packages)""")
def image_extensions(spark: SparkSession, folder: str) -> DataFrame:
    mime = F.when(F.col("source_format") == "pdf", "image/png").when(F.col("source_format") == "html", "IMAGE/SVG+XML")
    return table(spark, folder, "packages").select("package_id", "original_path", S.image_extension(F.col("original_path"), mime, F.lit(None).cast("binary")).alias("extension")).distinct()


@query("""SELECT doc_id, strlen(text) AS n_bytes, substr(hex(encode(substr(text, 1, 4))), 1, 4) AS head FROM documents WHERE text <> ''""")
def data_payloads(spark: SparkSession, folder: str) -> DataFrame:
    raw = S.data_bytes(F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8"))))
    rows = table(spark, folder, "documents").where("text <> ''").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.substring(F.hex("raw"), 1, 4).alias("head"))


@query(r"""WITH u AS (SELECT DISTINCT source_url, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([^?#]*)', 1), '^/+|/+$', '', 'g'), '\.git$', '') AS p FROM web_blocks WHERE source_url IS NOT NULL)
SELECT source_url, CASE WHEN host = 'github.com' OR host LIKE '%.github.com' THEN 'github' ELSE 'gitlab' END AS provider, host, p AS path FROM u""")
def repository_addresses(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "web_blocks").where("source_url is not null").select("source_url").distinct()
    return rows.select("source_url", S.git_provider(F.col("source_url")).alias("g")).select("source_url", "g.provider", "g.host", "g.path")


@query(r"""WITH t AS (SELECT DISTINCT package_id, title FROM packages WHERE title IS NOT NULL) SELECT package_id, regexp_replace(trim(strip_accents(replace(replace(replace(replace(lower(title), 'ß', 'ss'), '’', ''''), '–', '-'), '—', '-'))), '\s+', ' ', 'g') AS folded FROM t""")
def folded_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packages").where("title is not null").select("package_id", "title").distinct().select("package_id", S.folded("title").alias("folded"))


@query("""SELECT o_orderkey, upper(CAST(o_orderstatus = 'F' AS VARCHAR)) AS flag, coalesce(CAST(CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS VARCHAR), '') AS number FROM orders""")
def cell_texts(spark: SparkSession, folder: str) -> DataFrame:
    number = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey"))
    return table(spark, folder, "orders").select("o_orderkey", S.cell_text(F.col("o_orderstatus") == "F", "boolean").alias("flag"), S.cell_text(number, "number").alias("number"))


WIDTHS = ("narrow", "étroit", "fixed-width", "wide", "Large", "full", "max", "default", "unset", "")


@query(f"""SELECT n_nationkey, {list(WIDTHS)!r}[n_nationkey % 10 + 1] AS asked, ['default', 'default', 'default', 'full-width', 'full-width', 'full-width', 'max', 'default', '', 'max'][n_nationkey % 10 + 1] AS width, CASE n_nationkey % 10 WHEN 8 THEN '{{}}' ELSE '{{"content-appearance-published":"' || ['default', 'default', 'default', 'full-width', 'full-width', 'full-width', 'max', 'default', '', 'max'][n_nationkey % 10 + 1] || '","content-appearance-draft":"' || ['default', 'default', 'default', 'full-width', 'full-width', 'full-width', 'max', 'default', '', 'max'][n_nationkey % 10 + 1] || '"}}' END AS properties FROM nation""")
def page_widths(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, WIDTHS)), F.col("n_nationkey") % 10 + 1).alias("asked"))
    width = S.page_width(F.col("asked"))
    return rows.select("n_nationkey", "asked", width.alias("width"), S.width_properties(width).alias("properties"))


@query("""SELECT p_partkey, 'color=' || p_brand || '|width=' || p_size || 'px' AS styles FROM part""")
def css_styles(spark: SparkSession, folder: str) -> DataFrame:
    css = F.concat(F.lit("COLOR: red; ; width :"), F.col("p_size").cast("string"), F.lit("px; height: ; nothing; color : "), F.col("p_brand"))
    styles = F.array_sort(F.map_entries(S.style_map(css)))
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.transform(styles, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("styles"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS VARCHAR) ELSE '[no value stored: =SUM(A1)]' END AS shown FROM (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS BIGINT) AS o_totalprice FROM orders)""")
def formula_cells(spark: SparkSession, folder: str) -> DataFrame:
    cached = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", S.formula_display(cached, F.lit("=SUM(A1)")).alias("shown"))


@query(r"""WITH t AS (SELECT DISTINCT export_id, package_id, rag_markdown AS m FROM rag_exports WHERE rag_markdown IS NOT NULL), h AS (SELECT export_id, package_id, regexp_replace(trim(regexp_extract(replace(m, chr(13) || chr(10), chr(10)), '(?m)^#\s+(.+?)\s*$', 1)), '\s+', ' ', 'g') AS h FROM t)
SELECT export_id, CASE WHEN h <> '' AND length(h) <= 240 AND lower(h) NOT IN ('untitled','document','document1','document 1','microsoft word','microsoft word document','powerpoint presentation','presentation','presentation1','presentation 1','adobe acrobat') THEN h ELSE 'Release Notes' END AS title FROM h""")
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rag_exports").where("rag_markdown is not null").select("export_id", "package_id", "rag_markdown").distinct()
    text = F.replace("rag_markdown", F.lit("\r\n"), F.lit("\n"))
    return rows.select("export_id", S.page_title_of(text, F.lit("/a/release_notes.md")).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '☒' ELSE '☐' END || ' ' || o_orderpriority AS text FROM orders""")
def checkboxes(spark: SparkSession, folder: str) -> DataFrame:
    box = F.concat(F.lit('<input type="checkbox"'), F.when(F.col("o_orderstatus") == "F", " checked").otherwise(""), F.lit("/> "), "o_orderpriority")
    return table(spark, folder, "orders").select("o_orderkey", S.checkbox_signs(box).alias("text"))


# ------------------------------------------------------------ issues


@query("""WITH c AS (SELECT 0 AS s, * FROM events WHERE event_type = 'view' UNION ALL SELECT 1, * FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 2, * FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY s) AS k FROM c)
SELECT CAST(user_id AS VARCHAR) AS issue, CAST(event_id AS VARCHAR) AS comment_id, event_type AS author FROM r WHERE k = 1""")
def comments_merged(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("issue"), F.col("event_id").cast("string").alias("comment_id"), F.col("event_type").alias("author"), F.col("ts").cast("string").alias("created"), F.col("props").alias("body"))
    return issues.comments_of([rows.where("author = 'view'"), rows.where("author in ('view', 'click')"), rows]).select("issue", "comment_id", "author")


@query("""WITH n AS (SELECT user_id, count(*) AS found FROM events GROUP BY user_id), c AS (SELECT c_custkey, greatest(0, CAST(c_acctbal / 100 AS INTEGER)) AS total FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS issue, 'the issue reports ' || total || ' comment(s), ' || coalesce(found, 0) || ' found' AS warning FROM c LEFT JOIN n ON user_id = c_custkey WHERE total > coalesce(found, 0)""")
def comments_missing(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("issue"))
    rows = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.greatest(F.lit(0), F.bround(F.col("c_acctbal") / 100).cast("int")).alias("comment_total"))
    return issues.missing_comments(rows, found)


ISSUE_PARTS = """WITH i AS (SELECT CAST(c_custkey AS VARCHAR) AS issue, c_name, c_mktsegment FROM customer), c AS (SELECT CAST(user_id AS VARCHAR) AS issue, event_type, CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_id AS VARCHAR)) - 1 AS k FROM events)
SELECT issue, 0 AS section, CAST(0 AS BIGINT) AS position, 'heading' AS kind, c_name AS txt FROM i UNION ALL SELECT issue, 1, 0, 'paragraph', 'Issue: ' || issue FROM i UNION ALL SELECT issue, 1, 1, 'paragraph', 'Type: ' || c_mktsegment FROM i
UNION ALL SELECT DISTINCT issue, 3, -1, 'heading', 'Comments' FROM c UNION ALL SELECT issue, 3, 2 * k, 'heading', event_type FROM c UNION ALL SELECT issue, 3, 2 * k + 1, 'paragraph', 'said ' || id FROM c"""


@query(ISSUE_PARTS)
def issue_documents(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("summary"), F.col("c_mktsegment").alias("issue_type"), none.alias("status"), none.alias("project"), none.alias("assignee"), none.alias("description"))
    said = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("issue"), F.col("event_id").cast("string").alias("comment_id"), F.col("event_type").alias("author"), none.alias("created"), F.concat(F.lit("said "), F.col("event_id").cast("string")).alias("body"))
    files = said.limit(0).select("issue", none.alias("file"), none.alias("filename"), none.alias("mime_type"))
    return issues.issue_blocks(rows, said, files).select("issue", "section", "position", "kind", "txt")


@query("""WITH i AS (SELECT p_partkey AS doc, 'a.png' AS asset, row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber) AS k, l_orderkey * 10 + l_linenumber AS ref_no FROM (SELECT DISTINCT l_partkey AS p_partkey, l_orderkey, l_linenumber FROM lineitem)), o AS (SELECT ps AS doc, k, 20 + 10 * k AS w FROM (SELECT p_partkey AS ps, unnest([1, 2]) AS k FROM part))
SELECT doc, ref_no, CAST(w AS INTEGER) AS width, 'a_' || w || 'x' || w || '.png' AS variant FROM (SELECT i.doc, i.ref_no, o.w FROM i JOIN o ON o.doc = i.doc AND o.k = least(i.k, 2))""")
def image_variants(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_no"), F.lit("a.png").alias("asset")).distinct()
    seen = table(spark, folder, "part").select(F.col("p_partkey").alias("doc"), F.lit("a.png").alias("asset"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    seen = seen.withColumns({"width": 20 + 10 * F.col("position"), "height": 20 + 10 * F.col("position")})
    return office.image_variants(images, seen, "doc").select("doc", "ref_no", "width", "variant")
