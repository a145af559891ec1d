"""Queries over packages: their files, what publishing them needs, the state of publications, issues and instances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import scalars as S
from papyrion.operators import chunks as C
from papyrion.operators import assets, flat, issues, outline
from papyrion.operators import publishing as P
from papyrion.operators import relations as R
from papyrion.plans.tables import FLAT, FREE, PLAN, publish_tables
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


def _stem_sql(name: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({name}, '[^A-Za-z0-9._ -]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), ''), 'document')"


# ------------------------------------------------------------ files of packages


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return P.package_documents(table(spark, folder, "packages"), table(spark, folder, "blocks"), "package_id")


@query(FLAT + rf""", p AS (SELECT DISTINCT package_id, package, title, original_path, source_sha256 FROM packages), n AS (SELECT package_id, count(*) AS n_blocks, count(DISTINCT CASE WHEN kind = 'image' THEN src END) AS n_images, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY block_no) FILTER (WHERE md <> ''), '') || chr(10) AS md FROM m JOIN b USING (package_id, block_no) GROUP BY package_id)
SELECT package_id, {_stem_sql(r"regexp_replace(regexp_extract(coalesce(original_path, package), '([^/]*)$', 1), '(.)\.[^.]*$', '\1')")} || '__' || coalesce(nullif(lower(regexp_extract(coalesce(original_path, package), '\.([^./\\]+)$', 1)), ''), 'file') AS package_dir,
CASE WHEN coalesce(source_sha256, '') <> '' THEN substr(source_sha256, 1, 16) ELSE {_stem_sql("package")} END AS document_id, n_blocks, CAST(n_images AS INTEGER) AS n_images, sha256(md) AS markdown_sha256 FROM p JOIN n USING (package_id)""")
def package_outputs(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("package_id", "package_dir", "document_id", "n_blocks", F.size("images").alias("n_images"), F.sha2("publication_markdown", 256).alias("markdown_sha256"))


@query()
def package_files(spark: SparkSession, folder: str) -> DataFrame:
    files = P.package_files(_documents(spark, folder), "package_id")
    return files.select("package_id", "package_dir", "file", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@query()
def legacy_rag_view(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("package_id", P.legacy_view(F.col("publication_markdown"), F.array().cast("array<string>")).alias("view"))


@query("""WITH p AS (SELECT DISTINCT parent_id, page_id, coalesce(title, '') AS title, coalesce(child_position, 2147483647) AS pos FROM page_tree WHERE parent_id IS NOT NULL)
SELECT parent_id AS parent, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY pos, page_id, title) AS INTEGER) AS child_no, page_id AS child, title FROM p""")
def child_packages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_tree").select("parent_id", "page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("child_position", F.lit(2**31 - 1)).alias("pos")).distinct()
    return P.child_packages(pages, "parent_id", "page_id", "title", "pos")


@query("""WITH i AS (SELECT DISTINCT package_id, block_no, src FROM blocks WHERE kind = 'image' AND src IS NOT NULL), h AS (SELECT DISTINCT package_id, src FROM i WHERE block_no < 3), n AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.package_id = h.package_id AND i.src = h.src AND i.block_no >= 3))
SELECT package_id, src, CAST(row_number() OVER (PARTITION BY package_id ORDER BY src) AS INTEGER) AS position FROM n""")
def header_images(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "blocks").where("kind = 'image' and src is not null").select("package_id", "block_no", "src").distinct()
    heads = images.where("block_no < 3").select("package_id", F.col("src").alias("file"), F.lit("header").alias("role"))
    return P.header_images(heads, images.where("block_no >= 3"), "package_id").select("package_id", "src", "position")


@query(r"""WITH i AS (SELECT DISTINCT package_id, block_no, src, sha256(src) AS h FROM blocks WHERE kind = 'image' AND src IS NOT NULL), m AS (SELECT package_id, CASE WHEN block_no < 3 THEN 'header' ELSE 'footer' END AS role, h, min(src) AS name FROM i GROUP BY ALL), a AS (SELECT package_id, h, min(src) AS own FROM i WHERE block_no BETWEEN 3 AND 20 GROUP BY ALL),
r AS (SELECT m.*, a.own, row_number() OVER (PARTITION BY m.package_id, role, a.own IS NULL ORDER BY name, m.h) AS k FROM m LEFT JOIN a ON a.package_id = m.package_id AND a.h = m.h)
SELECT package_id, h AS sha256, role, coalesce(own, role || '_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || regexp_extract(name, '(\.[^./]+)$', 1)) AS file, own IS NOT NULL AS known FROM r""")
def header_media(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "blocks").where("kind = 'image' and src is not null").select("package_id", "block_no", "src", F.sha2("src", 256).alias("sha256")).distinct()
    media = images.select("package_id", "sha256", F.when(F.col("block_no") < 3, "header").otherwise("footer").alias("role"), F.col("src").alias("name"))
    return P.header_media(media, images.where("block_no between 3 and 20").select("package_id", "sha256", F.col("src").alias("file")), "package_id")


# ------------------------------------------------------------ inputs and files to send


@query("SELECT DISTINCT original_path AS path FROM packages WHERE lower(regexp_extract(original_path, '([^/]*)$', 1)) LIKE '%.md' AND original_path NOT LIKE '%.rag.md' AND original_path NOT LIKE '%.raw.md'")
def publication_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return P.publication_inputs(table(spark, folder, "packages").select(F.col("original_path").alias("path")))


@query(r"""WITH x AS (SELECT package_id, src AS path FROM blocks WHERE src IS NOT NULL UNION ALL SELECT package_id, unnest(regexp_extract_all(txt, '\]\(([^)\s]+)\)', 1)) FROM web_blocks)
SELECT DISTINCT package_id, regexp_replace(path, '^\./', '') AS path FROM x WHERE path <> '' AND NOT regexp_matches(regexp_replace(path, '^\./', ''), '^(?:https?://|data:|#|/)')""")
def files_to_send(spark: SparkSession, folder: str) -> DataFrame:
    saved = table(spark, folder, "blocks").where("src is not null").select("package_id", F.col("src").alias("file"))
    shown = table(spark, folder, "web_blocks").select("package_id", F.explode(F.regexp_extract_all("txt", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("src"))
    return P.files_to_send(saved, shown, "package_id")


@query("""SELECT DISTINCT original_path AS path FROM packages WHERE lower(original_path) LIKE '%.md' AND original_path NOT IN (SELECT original_path FROM packages WHERE lang = 'en' AND original_path IS NOT NULL) AND original_path NOT IN (SELECT original_path FROM packages WHERE lang = 'fr' AND original_path IS NOT NULL)""")
def ignore_additions(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "packages").where("original_path is not null").select("lang", F.col("original_path").alias("path"))
    return P.ignored(files, files.where("lang = 'en'"), files.where("lang = 'fr'"))


@query(r"""SELECT DISTINCT export_id, '---' || chr(10) || array_to_string(list_concat(list_filter(string_split(CASE WHEN f THEN regexp_extract(rag_markdown, '^---\n(.*?)\n---[ \t]*(?:\n(.*))?$', 1, 's') ELSE '' END, chr(10)), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:title|page_id|space_key)\s*:')), ['title: "Export ' || export_id || '"'], CASE WHEN package_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['page_id: "' || package_id || '"'] END), chr(10)) || chr(10) || '---' || chr(10) || chr(10)
|| regexp_replace(CASE WHEN f THEN regexp_extract(rag_markdown, '^---\n(.*?)\n---[ \t]*(?:\n(.*))?$', 2, 's') ELSE rag_markdown END, '\s+$', '') || chr(10) AS text FROM (SELECT *, regexp_matches(rag_markdown, '^---\n(.*?)\n---[ \t]*(?:\n(.*))?$', 's') AS f FROM rag_exports WHERE rag_markdown IS NOT NULL)""")
def publication_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rag_exports").where("rag_markdown is not null")
    text = P.publication_text(F.col("rag_markdown"), F.concat(F.lit("Export "), F.col("export_id").cast("string")), F.col("package_id").cast("string"))
    return rows.select("export_id", text.alias("text")).distinct()


# ------------------------------------------------------------ state of publications


@query(r"""WITH t AS (SELECT DISTINCT space_key AS instance, space_key AS space, coalesce(parent_id, '') AS parent_id, page_id, coalesce(title, '') AS title, coalesce(title, '') AS source, CASE WHEN child_position % 3 = 0 THEN 'copy' ELSE 'primary' END AS role, version_no, coalesce(updated_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS updated_at FROM page_tree),
r AS (SELECT *, row_number() OVER (PARTITION BY role, CASE WHEN role = 'primary' THEN instance || '|' || parent_id || '|' || source ELSE page_id END ORDER BY version_no DESC, updated_at DESC, CASE WHEN version_no = 1 THEN 0 ELSE 1 END DESC, instance DESC, space DESC, parent_id DESC, page_id DESC, title DESC, source DESC) AS k FROM t)
SELECT instance, parent_id, page_id, title, role, version_no FROM r WHERE k = 1""")
def publication_state(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_tree").select(
        F.col("space_key").alias("instance"), F.col("space_key").alias("space"), F.coalesce("parent_id", F.lit("")).alias("parent_id"), "page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("title", F.lit("")).alias("source"),
        F.when(F.col("child_position") % 3 == 0, "copy").otherwise("primary").alias("role"), "version_no", F.coalesce("updated_at", F.lit(0).cast("timestamp")).alias("updated_at"),
    ).distinct()
    state = P.publication_state(pages.where("version_no = 1"), pages.where("version_no <> 1"), ["version_no", "updated_at"])
    return state.select("instance", "parent_id", "page_id", "title", "role", "version_no")


@query("""WITH s AS (SELECT DISTINCT package_id, package AS rel_dir, coalesce(title, '') AS source FROM packages), g AS (SELECT package AS rel_dir, min(package || '.md') AS publication, min(source_sha256) AS fingerprint FROM packages WHERE package_id IN (SELECT package_id FROM blocks) GROUP BY package)
SELECT package_id, rel_dir, coalesce(publication, source) AS source, fingerprint AS source_fingerprint, '1.1' AS schema_version, publication IS NULL AS lost FROM s LEFT JOIN g USING (rel_dir)""")
def state_migrated(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "packages")
    state = packages.select("package_id", F.col("package").alias("rel_dir"), F.coalesce("title", F.lit("")).alias("source")).distinct()
    new = packages.join(table(spark, folder, "blocks").select("package_id").distinct(), "package_id", "left_semi").select(F.col("package").alias("rel_dir"), F.concat("package", F.lit(".md")).alias("publication"), F.col("source_sha256").alias("fingerprint"))
    return P.migrated_state(state, new).select("package_id", "rel_dir", "source", "source_fingerprint", "schema_version", "lost")


@query("""WITH p AS (SELECT DISTINCT page_id, space_key, title, coalesce(parent_id, '') AS parent FROM page_tree), n AS (SELECT space_key, title, parent, count(*) AS n, min(page_id) AS page FROM p GROUP BY ALL)
SELECT p.page_id AS request_id, CASE WHEN n.n = 1 THEN n.page END AS page_id, coalesce(n.n = 1, false) AS confirmed FROM p LEFT JOIN n ON n.space_key = p.space_key AND n.title = p.title AND n.parent = p.parent""")
def publication_verified(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_tree").select("page_id", F.col("space_key").alias("space"), "title", F.coalesce("parent_id", F.lit("")).alias("parent_id")).distinct()
    return P.verified(pages.withColumnRenamed("page_id", "request_id"), pages.withColumn("status", F.lit(None).cast("string")))


@query("""WITH s AS (SELECT package, arg_max({'i': CAST(package_id AS VARCHAR), 't': CASE WHEN lang IS NULL THEN 'issue-created' ELSE 'complete' END, 'f': source_sha256}, {'t': CASE WHEN lang IS NULL THEN 'issue-created' ELSE 'complete' END, 'i': CAST(package_id AS VARCHAR)}) AS s FROM packages WHERE title_source IS NOT NULL GROUP BY package),
q AS (SELECT DISTINCT package_id AS request_id, package, source_sha256 FROM packages), a AS (SELECT DISTINCT CAST(package_id AS VARCHAR) AS issue FROM blocks)
SELECT request_id, CASE WHEN s.s.i IS NULL OR a.issue IS NULL THEN 'create' WHEN s.s.t <> 'complete' THEN 'resume' WHEN source_sha256 = s.s.f THEN 'skip' ELSE 'update' END AS action, CASE WHEN NOT (s.s.i IS NULL OR a.issue IS NULL) THEN s.s.i END AS issue FROM q LEFT JOIN s USING (package) LEFT JOIN a ON a.issue = s.s.i""")
def imports_resumed(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "packages").select("package_id", "package", "source_sha256", "lang", "title_source").distinct()
    state = packages.where("title_source is not null").select(F.col("package").alias("source"), F.col("package_id").cast("string").alias("issue"), F.when(F.col("lang").isNull(), "issue-created").otherwise("complete").alias("status"), F.col("source_sha256").alias("source_fingerprint"))
    requests = packages.select(F.col("package_id").alias("request_id"), F.col("package").alias("source"), F.col("source_sha256").alias("fingerprint")).distinct()
    return P.resumed(requests, state, table(spark, folder, "blocks").select(F.col("package_id").cast("string").alias("issue")))


# ------------------------------------------------------------ instances, issue queries, media


@query("""WITH a AS (SELECT space_key AS name, min(title) AS title, count(*) AS n FROM packages WHERE space_key IS NOT NULL GROUP BY 1), b AS (SELECT space_key AS name, min(title) AS title, count(*) AS n FROM page_tree WHERE space_key IS NOT NULL GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NOT NULL THEN a.title ELSE b.title END AS title, CASE WHEN a.name IS NOT NULL THEN a.n ELSE b.n END AS n FROM a FULL JOIN b ON a.name = b.name""")
def instances_merged(spark: SparkSession, folder: str) -> DataFrame:
    of = lambda name: table(spark, folder, name).where("space_key is not null").groupBy(F.col("space_key").alias("name")).agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n"))
    return issues.merged_instances(of("packages"), of("page_tree"), "name")


@query("""WITH n AS (SELECT DISTINCT source AS name FROM source_targets WHERE source IS NOT NULL), d AS (SELECT DISTINCT doc_id, coalesce(nullif(source, ''), (SELECT min(name) FROM n)) AS w FROM documents)
SELECT doc_id AS request_id, n.name AS instance, CASE WHEN n.name IS NULL THEN 'unknown instance: ' || w END AS error FROM d LEFT JOIN n ON n.name = d.w""")
def instances_resolved(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "documents").select(F.col("doc_id").alias("request_id"), F.col("source").alias("asked"))
    return issues.resolved_instance(requests, table(spark, folder, "source_targets").select(F.col("source").alias("name")), None, only=False)


def _quoted_sql(col: str) -> str:
    return rf"""regexp_replace({col}, '(["\\])', '\\\1', 'g')"""


@query(rf"""WITH p AS (SELECT DISTINCT package_id, coalesce(space_key, '') AS s, regexp_replace(coalesce(source_format, ''), '^\s+|\s+$', '', 'g') AS t, regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') AS w FROM packages)
SELECT package_id, 'project = "' || {_quoted_sql("s")} || '"' || CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^\d+$') THEN ' AND issuetype = ' || t ELSE ' AND issuetype = "' || {_quoted_sql("t")} || '"' END || CASE WHEN w = '' THEN '' ELSE ' AND (' || CASE WHEN contains(w, '-') AND NOT contains(w, ' ') THEN 'key = "' || {_quoted_sql("w")} || '" OR ' ELSE '' END || 'summary ~ "' || {_quoted_sql("w")} || '*" OR text ~ "' || {_quoted_sql("w")} || '*")' END || ' ORDER BY updated DESC' AS query FROM p""")
def issue_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "packages").select("package_id", F.coalesce("space_key", F.lit("")).alias("s"), "source_format", "title").distinct()
    return rows.select("package_id", issues.issue_query(F.col("s"), F.col("source_format"), F.col("title")).alias("query")).distinct()


@query(r"""WITH i AS (SELECT DISTINCT package_id, block_no, src, coalesce(txt, '') AS txt FROM blocks WHERE kind = 'image' AND src IS NOT NULL), k AS (SELECT package_id, block_no, src, unnest([CAST(block_no AS VARCHAR), txt, regexp_extract(src, '([^/]*)$', 1)]) AS probe FROM i), m AS (SELECT package_id, probe, arg_max(src, block_no) AS file FROM k WHERE probe <> '' GROUP BY ALL),
q AS (SELECT package_id, block_no, unnest(['https://x/' || regexp_extract(src, '([^/]*)$', 1), regexp_extract(src, '([^/]*)$', 1), txt, CAST(block_no AS VARCHAR)]) AS probe, unnest([0, 1, 2, 3]) AS p FROM i)
SELECT package_id, block_no AS ref_no, (SELECT arg_min(m.file, q.p) FROM q JOIN m ON m.package_id = q.package_id AND m.probe = q.probe WHERE q.package_id = i.package_id AND q.block_no = i.block_no) AS file FROM i""")
def media_rewritten(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "blocks").where("kind = 'image' and src is not null").select("package_id", "block_no", "src", F.coalesce("txt", F.lit("")).alias("txt")).distinct()
    none, name = F.lit(None).cast("string"), F.regexp_extract("src", "([^/]*)$", 1)
    attachments = images.select("package_id", F.lit(True).alias("saved"), F.col("src").alias("file"), F.col("block_no").alias("position"), F.col("block_no").cast("string").alias("attachment_id"), none.alias("content"), none.alias("thumbnail"), none.alias("self"), F.col("txt").alias("filename"))
    refs = images.select("package_id", F.col("block_no").alias("ref_no"), F.concat(F.lit("https://x/"), name).alias("target"), F.col("txt").alias("alt"), F.col("block_no").cast("string").alias("media_id"))
    return issues.rewritten_media(refs, attachments, "package_id").select("package_id", "ref_no", "file")


@query(r"""WITH i AS (SELECT DISTINCT package_id, block_no, src FROM blocks WHERE kind = 'image' AND src IS NOT NULL), a AS (SELECT *, regexp_extract(src, '([^/]*)$', 1) AS name, row_number() OVER (PARTITION BY package_id, src ORDER BY block_no) AS k FROM i), s AS (SELECT DISTINCT package_id, src FROM i WHERE block_no < 5),
r AS (SELECT a.*, s.src IS NULL AND k = 1 AND lower(a.src) LIKE '%.png' AS image FROM a LEFT JOIN s ON s.package_id = a.package_id AND s.src = a.src)
SELECT package_id, block_no AS position, CASE WHEN image THEN 'image' ELSE 'paragraph' END AS kind, CASE WHEN image THEN name ELSE '[' || name || '](' || src || ')' END AS txt, CASE WHEN image THEN src END AS src FROM r""")
def attachment_blocks(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "blocks").where("kind = 'image' and src is not null").select("package_id", "block_no", "src").distinct()
    attachments = images.select("package_id", F.col("block_no").alias("position"), F.col("src").alias("file"), F.lit(None).cast("string").alias("filename"), F.when(F.lower("src").endswith(".png"), "image/png").otherwise("application/octet-stream").alias("mime_type"))
    return issues.attachment_blocks(attachments, images.where("block_no < 5").select("package_id", "src"), "package_id")


# ------------------------------------------------------------ titles, labels, names, reports


@query(r"""WITH h AS (SELECT package_id, arg_min(t, block_no) AS h FROM (SELECT package_id, block_no, regexp_replace(trim(txt), '\s+', ' ', 'g') AS t FROM blocks WHERE kind = 'heading') WHERE t <> '' AND length(t) <= 240 AND lower(t) NOT IN ('untitled','document','document1','document 1','microsoft word','microsoft word document','powerpoint presentation','presentation','presentation1','presentation 1','adobe acrobat') GROUP BY package_id),
p AS (SELECT DISTINCT package_id, title_source, regexp_replace(regexp_extract(coalesce(original_path, package), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, CASE WHEN length(t) BETWEEN 1 AND 240 AND lower(t) NOT IN ('untitled','document','document1','document 1','microsoft word','microsoft word document','powerpoint presentation','presentation','presentation1','presentation 1','adobe acrobat') THEN t END AS t FROM (SELECT *, regexp_replace(trim(title), '\s+', ' ', 'g') AS t FROM packages))
SELECT package_id, coalesce(CASE WHEN title_source = 'metadata' THEN t END, CASE WHEN title_source = 'provided' THEN t END, h, stem) AS title, CASE WHEN title_source = 'metadata' AND t IS NOT NULL THEN 'core_properties' WHEN title_source = 'provided' AND t IS NOT NULL THEN 'extractor_metadata' WHEN h IS NOT NULL THEN 'document_heading' ELSE 'filename' END AS title_source FROM p LEFT JOIN h USING (package_id)""")
def title_chain(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "blocks").where("kind = 'heading'").select("package_id", "block_no", S.clean_title(F.col("txt")).alias("h")).where("h is not null").groupBy("package_id").agg(F.min_by("h", "block_no").alias("h"))
    rows = table(spark, folder, "packages").select("package_id", "title", "title_source", "original_path", "package").distinct().join(heads, "package_id", "left")
    of = lambda source: F.when(F.col("title_source") == source, F.col("title"))
    title, origin = S.title_chain(core_properties=of("metadata"), extractor_metadata=of("provided"), document_heading=F.col("h"), filename=S.stem(F.coalesce("original_path", "package")))
    return rows.select("package_id", title.alias("title"), origin.alias("title_source"))


@query("""WITH l AS (SELECT DISTINCT lang, CASE WHEN split_part(lower(trim(coalesce(lang, ''))), '-', 1) IN ('en', 'fr', 'de', 'es', 'zh') THEN split_part(lower(trim(coalesce(lang, ''))), '-', 1) ELSE 'en' END AS c FROM documents)
SELECT lang, CASE c WHEN 'fr' THEN 'Commentaires' WHEN 'de' THEN 'Kommentare' WHEN 'es' THEN 'Comentarios' WHEN 'zh' THEN '评论' ELSE 'Comments' END AS comments, CASE c WHEN 'fr' THEN 'Pièces jointes' WHEN 'de' THEN 'Anhänge' WHEN 'es' THEN 'Adjuntos' WHEN 'zh' THEN '附件' ELSE 'Attachments' END AS attachments, 'nothing' AS unknown FROM l""")
def labels_translated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("lang").distinct()
    return rows.select("lang", *[S.translated(F.lit(k), F.col("lang")).alias(n) for n, k in (("comments", "comments"), ("attachments", "attachments"), ("unknown", "nothing"))])


@query(r"""WITH l AS (SELECT package_id, block_no, unnest(regexp_extract_all(txt, '\]\(([^)\s]+)\)', 1)) AS href, unnest(range(1, 1 + len(regexp_extract_all(txt, '\]\(([^)\s]+)\)', 1)))) AS k, source_url FROM web_blocks WHERE source_url IS NOT NULL),
u AS (SELECT *, lower(regexp_extract(regexp_replace(source_url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/(?:.*/)?[^/]*?(\.[^./]+)$', 1)) AS e FROM l)
SELECT package_id, block_no, CAST(k AS INTEGER) AS link_no, 'web_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || CASE WHEN e = '' THEN '.png' WHEN e IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.svg', '.bmp', '.tif', '.tiff') THEN e ELSE '.bin' END AS name FROM u""")
def web_asset_names(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "web_blocks").where("source_url is not null").select("package_id", "block_no", "source_url", F.posexplode(F.regexp_extract_all("txt", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("i", "href"))
    return links.select("package_id", "block_no", (F.col("i") + 1).alias("link_no"), S.web_asset_name(F.col("source_url"), F.col("i") + 1, F.lit("image/png; q=1")).alias("name"))


@query(r"""SELECT DISTINCT package_id, block_no, CAST(k AS INTEGER) AS link_no, regexp_extract(source_url, '^([a-z]+://[^/?#]*)', 1) || href AS address FROM (SELECT package_id, block_no, source_url, unnest(regexp_extract_all(txt, '\]\((/[^/)\s][^)\s]*)\)', 1)) AS href, unnest(range(1, 1 + len(regexp_extract_all(txt, '\]\((/[^/)\s][^)\s]*)\)', 1)))) AS k FROM web_blocks WHERE source_url LIKE 'http%')""")
def link_addresses(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "web_blocks").where("source_url like 'http%'").select("package_id", "block_no", "source_url", F.posexplode(F.regexp_extract_all("txt", F.lit(r"\]\((/[^/)\s][^)\s]*)\)"), 1)).alias("i", "href"))
    return links.select("package_id", "block_no", (F.col("i") + 1).alias("link_no"), S.joined_address(F.col("source_url"), F.col("href")).alias("address")).distinct()


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"text":"<bytes:' || strlen(text) || '>"}' AS json FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL""")
def json_redacted(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null and n_chars is not null")
    return rows.select("doc_id", S.json_safe(doc_id=F.col("doc_id"), n_chars=F.col("n_chars"), text=S.redacted(F.encode("text", "UTF-8"))).alias("json"))


@query("""WITH k AS (SELECT package_id, kind, count(*) AS n FROM (SELECT DISTINCT package_id, block_no, kind FROM blocks) WHERE kind IN ('image', 'table', 'code_block') GROUP BY ALL), p AS (SELECT DISTINCT package_id FROM blocks)
SELECT package_id, coalesce(string_agg(kind || '=' || n, ', ' ORDER BY kind), '') AS summary, CASE WHEN count(n) > 0 THEN 'partial' ELSE 'full' END AS fidelity FROM p LEFT JOIN k USING (package_id) GROUP BY package_id""")
def package_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ("image", "table", "code_block")
    rows = table(spark, folder, "blocks").select("package_id", "block_no", "kind").distinct().groupBy("package_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    counts = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])
    return rows.select("package_id", S.marker_summary(counts).alias("summary"), S.fidelity(counts).alias("fidelity"))


@query("""WITH p AS (SELECT DISTINCT package_id, title IS NULL AS a, lang IS NULL AS b, source_sha256 IS NULL AS c, block_count FROM packages), n AS (SELECT package_id, count(DISTINCT block_no) AS n FROM blocks GROUP BY package_id)
SELECT package_id, concat_ws('; ', CASE WHEN a THEN 'no title' END, CASE WHEN b THEN 'no language' END, CASE WHEN c THEN 'no hash' END, CASE WHEN block_count > coalesce(n, 0) THEN 'blocks missing' END) AS warnings FROM p LEFT JOIN n USING (package_id)""")
def package_warnings(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "blocks").groupBy("package_id").agg(F.count_distinct("block_no").alias("n"))
    rows = table(spark, folder, "packages").select("package_id", "title", "lang", "source_sha256", "block_count").distinct().join(found, "package_id", "left")
    said = [F.when(F.col("title").isNull(), F.lit("no title")), F.when(F.col("lang").isNull(), F.lit("no language")), F.when(F.col("source_sha256").isNull(), F.lit("no hash")), F.when(F.col("block_count") > F.coalesce("n", F.lit(0)), F.lit("blocks missing"))]
    return rows.select("package_id", F.concat_ws("; ", *said).alias("warnings")).distinct()


@query(r"""SELECT package_id, count(*) AS n_links FROM (SELECT DISTINCT package_id, block_no, txt FROM web_blocks), unnest(regexp_extract_all(txt, '\]\((/[^)\s]*)\)', 1)) GROUP BY package_id HAVING count(*) >= 3""")
def link_pages(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "web_blocks").select("package_id", "block_no", "txt").distinct().select("package_id", F.explode(F.regexp_extract_all("txt", F.lit(r"\]\((/[^)\s]*)\)"), 1)))
    return links.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_links")).where("n_links >= 3")


@query("""SELECT event_type, count(*) AS n, lower(coalesce(event_type, 'page')) = 'page' AS is_page FROM events GROUP BY event_type""")
def page_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", "n", S.is_page(F.col("event_type")).alias("is_page"))


@query("""WITH k AS (SELECT DISTINCT lower(source) AS s FROM source_targets WHERE source IS NOT NULL) SELECT doc_id, k.s AS found FROM documents d LEFT JOIN k ON k.s = lower(trim(d.source))""")
def names_in_any_case(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "source_targets").where("source is not null").select(F.lower("source").alias("found")).distinct()
    return table(spark, folder, "documents").join(known, F.lower(F.trim("source")) == F.col("found"), "left").select("doc_id", "found")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 50)""")
def issue_page_after(spark: SparkSession, folder: str) -> DataFrame:
    order = ["o_orderdate", "o_orderkey"]
    orders = table(spark, folder, "orders")
    return flat.page_after(orders, order, flat.page_token(flat.page_of(orders, [F.col(c) for c in order], 50), order), 50).select("o_orderkey", "o_custkey")


@query(r"""WITH h AS (SELECT DISTINCT package_id, block_no, heading_level, txt FROM blocks WHERE kind = 'heading' AND trim(coalesce(txt, '')) <> ''), p AS (SELECT DISTINCT package_id, source_format FROM packages WHERE package_id IN (SELECT package_id FROM blocks)), n AS (SELECT package_id, count(*) AS n FROM h GROUP BY package_id)
SELECT package_id, CASE WHEN n IS NULL THEN 'none' WHEN source_format = 'docx' THEN 'docx_outline' WHEN source_format = 'pptx' THEN 'pptx_slide_titles' WHEN source_format = 'pdf' THEN 'pdf_outline' ELSE 'markdown' END AS outline_source, coalesce(n, 0) AS entries FROM p LEFT JOIN n USING (package_id)""")
def outline_sources(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "blocks").where("kind = 'heading' and trim(coalesce(txt, '')) <> ''").select("package_id", "block_no", "heading_level", "txt").distinct().select("package_id", F.struct("block_no", "heading_level", "txt").alias("entry"))
    packages = table(spark, folder, "packages").join(table(spark, folder, "blocks").select("package_id").distinct(), "package_id", "left_semi").select("package_id", "source_format").distinct()
    by = heads.groupBy("package_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    rows = packages.join(by, "package_id", "left")
    own = lambda formats: F.when(F.col("source_format").isin(*formats), F.col("entries"))
    name, entries = outline.dispatched(docx_outline=own(["docx"]), pdf_outline=own(["pdf"]), pptx_slide_titles=own(["pptx"]), markdown=F.col("entries"))
    return rows.select("package_id", name.alias("outline_source"), F.size(entries).cast("long").alias("entries"))


@query()
def headings_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of each package, with the numbers that the source's numbering gives them."""
    heads = table(spark, folder, "blocks").where("kind = 'heading' and txt is not null").select("package_id", F.col("block_no").cast("long").alias("position"), "heading_level", "txt").distinct()
    specs = outline.source_numbers(heads.select("package_id", "position", F.col("txt").alias("title"), F.lit("1").alias("number_id"), (F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(1))) - 1).alias("number_level")), None, "package_id")
    return outline.numbered_headings(specs, heads.select("package_id", "position", F.col("txt").alias("heading")), "package_id")


@query()
def chunks_of_packages(spark: SparkSession, folder: str) -> DataFrame:
    return C.chunk(_documents(spark, folder), "publication_markdown", ["package_id"]).select("package_id", "chunk_id", F.array_join("heading_path", " > ").alias("heading_path"), "content")


@query(PLAN + FREE + """ SELECT request_id, CASE WHEN c = 1 THEN title ELSE title || ' (' || c || ')' END AS title, 'create' AS action, CAST(NULL AS VARCHAR) AS page_id, CAST(NULL AS VARCHAR) AS reason FROM f""")
def publish_plan_add(spark: SparkSession, folder: str) -> DataFrame:
    """What publishing would do that always adds pages, under free titles."""
    rows = R.publish_plan(*publish_tables(spark, folder), "add")
    return rows.select("request_id", "title", "action", "page_id", F.when(F.col("action") == "error", F.col("reason")).alias("reason"))


IMAGES = """WITH b AS (SELECT DISTINCT package_id, block_no, src FROM blocks WHERE kind = 'image' AND src IS NOT NULL AND package_id IN (SELECT package_id FROM packages)), f AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY first_at, src) AS k FROM (SELECT package_id, src, min(block_no) AS first_at FROM b GROUP BY ALL))"""


@query(IMAGES + r""" SELECT package_id, CAST(row_number() OVER (PARTITION BY package_id ORDER BY block_no) AS INTEGER) AS ref_no, 'assets/image_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || regexp_extract(src, '(\.[^./]+)$', 1) AS target FROM b JOIN f USING (package_id, src)""")
def images_packaged(spark: SparkSession, folder: str) -> DataFrame:
    """The images that each package's text shows once its files are named anew and its references rewritten."""
    named = R.first_seen_names(table(spark, folder, "blocks").where("kind = 'image'"), ["package_id"], "src", "block_no", "assets/image", F.regexp_extract("src", r"(\.[^./]+)$", 1))
    pairs = named.groupBy("package_id").agg(F.collect_list(F.struct(F.col("src").alias("target"), F.col("name").alias("file"))).alias("pairs"))
    texts = _documents(spark, folder).join(pairs, "package_id").select("package_id", assets.rewritten(F.col("publication_markdown"), F.col("pairs")).alias("text"))
    return assets.references(texts, "text", ["package_id"]).select("package_id", "ref_no", "target")
