"""Queries of the language-model operators over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm import boilerplate, leakage, mixing, neardup, scans, spans, split
from papyrion.runtime import store, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.long_sections(table(spark, folder, "rag_exports"), "export_id", "rag_markdown", "chunk_size").select(F.col("key").alias("export_id"), "section_no")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = split.split(table(spark, folder, "rag_exports"), "export_id", "rag_markdown", "chunk_size", "overlap_chars", "chunk_count")
    return rows.withColumnsRenamed({"key": "export_id", "stated": "chunk_count"})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noise(table(spark, folder, "scan_pages"), "package_id", "page_no", "markdown").select(F.col("doc").alias("package_id"), F.col("page").alias("page_no"), "line_no", "noise")


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.readable(table(spark, folder, "scan_pages"), "package_id", "page_no", "markdown").withColumnRenamed("doc", "package_id")


def _site_pages(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.pages(table(spark, folder, "web_blocks"), "package_id", "block_no", "source_url", "kind", "txt", "ingested_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.judge(_site_pages(spark, folder)).where("not main").select("package_id", "block_no")


def p5_main(spark: SparkSession, folder: str) -> DataFrame:
    site_pages = store(_site_pages(spark, folder), "pages")
    return boilerplate.main_text(site_pages, boilerplate.judge(site_pages))


def _package_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of each package that has blocks: the title and one row per block."""
    blocks = table(spark, folder, "blocks")
    titles = table(spark, folder, "packages").select("package_id", F.col("title").alias("text"))
    return blocks.select("package_id", F.col("txt").alias("text")).unionByName(titles.join(blocks.select("package_id").distinct(), "package_id", "left_semi"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = neardup.similar(_package_texts(spark, folder), "package_id", "text", n=3, num=7, den=10)
    return neardup.pairs(members, links).select(F.col("a").alias("package_id_a"), F.col("b").alias("package_id_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    members, links = neardup.similar(_package_texts(spark, folder), "package_id", "text", n=3, num=7, den=10)
    return neardup.groups(members, links).select(F.col("key").alias("package_id"), F.col("group").alias("group_id"), F.col("class").alias("class_id"), "n_links")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "txt")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of all leaks, told apart by their slots, those that are verbatim."""
    return _leaks(spark, folder).where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tokens = store(mixing.token_counts(table(spark, folder, "documents"), "doc_id", "text", "source"), "counted")
    return mixing.mixture(tokens, table(spark, folder, "source_targets"), "source", "target_share", "max_repeats")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"), "doc_id", "text", 300)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.shares(spans.shared_spans(docs, "doc_id", "text", 300), docs, "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_paragraphs, p5_found, p5_main, p6_found, p6_groups, p7_found, p7_leaks, p8_mixture, p8_shares, p9_found, p9_shares)
}

SPANS = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, i, md5(substr(text, i + 1, 300)) AS m FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS i FROM d)),
r AS (SELECT m FROM w GROUP BY m HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i FROM w SEMI JOIN r USING (m)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS new FROM s),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 300 AS INTEGER) AS span_end FROM n GROUP BY doc_id, run)
"""

RUNS = r"""
WITH RECURSIVE t AS (SELECT package_id AS id, txt FROM blocks WHERE txt IS NOT NULL UNION ALL SELECT package_id, title FROM packages WHERE title IS NOT NULL AND package_id IN (SELECT package_id FROM blocks)),
w AS (SELECT id, list_transform(regexp_extract_all(txt, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM t),
s AS (SELECT DISTINCT id, array_to_string(w[i:i+2], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
"""

ORACLE: dict[str, str] = {
    "p1_found": r"""
WITH t AS (SELECT DISTINCT export_id, coalesce(chunk_size, 1600) AS size, string_split(replace(rag_markdown, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM rag_exports WHERE rag_markdown IS NOT NULL),
l AS (SELECT export_id, size, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM t),
f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY export_id, size ORDER BY i) AS fences FROM l),
h AS (SELECT *, sum(CASE WHEN fences % 2 = 0 AND regexp_matches(line, '^#{1,6}[ \t]+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY export_id, size ORDER BY i) AS sec FROM f),
s AS (SELECT export_id, size, sec, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS txt FROM h GROUP BY ALL),
n AS (SELECT export_id, size, txt, row_number() OVER (PARTITION BY export_id, size ORDER BY sec) AS section_no FROM s WHERE txt <> '')
SELECT DISTINCT export_id, CAST(section_no AS INTEGER) AS section_no FROM n WHERE length(txt) > size""",
    "p7_found": r"""
WITH d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id AS id, list_transform(regexp_extract_all(txt, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE txt IS NOT NULL),
dw AS (SELECT id, array_to_string(w[i:i+11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
ew AS (SELECT id, array_to_string(w[i:i+11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT dw.id AS doc_id, ew.id AS item_id FROM dw JOIN ew USING (run)""",
    "p6_found": r"""
WITH t AS (SELECT package_id AS id, txt FROM blocks WHERE txt IS NOT NULL UNION ALL SELECT package_id, title FROM packages WHERE title IS NOT NULL AND package_id IN (SELECT package_id FROM blocks)),
w AS (SELECT id, list_transform(regexp_extract_all(txt, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM t),
s AS (SELECT DISTINCT id, array_to_string(w[i:i+2], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
SELECT a AS package_id_a, b AS package_id_b FROM both_ JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * c >= 7 * (x.n + y.n - c)""",
    "p6_groups": RUNS + """
k AS (SELECT id, md5(string_agg(run, chr(10) ORDER BY run)) AS digest, count(*) AS n FROM s GROUP BY id),
c AS (SELECT id, n, min(id) OVER (PARTITION BY digest, n) AS class FROM k),
m AS (SELECT a.id, coalesce(c.class, a.id) AS class FROM (SELECT DISTINCT package_id AS id FROM blocks) a LEFT JOIN c USING (id)),
f AS (SELECT s.id, s.run, c.n FROM s JOIN c ON c.id = s.id AND c.class = c.id),
p AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.run = b.run AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT DISTINCT a AS id, a AS far FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.far),
l AS (SELECT id, min(far) AS label FROM reach GROUP BY id), g AS (SELECT a AS id, count(*) AS n FROM e GROUP BY a)
SELECT m.id AS package_id, coalesce(l.label, m.class) AS group_id, m.class AS class_id, coalesce(g.n, 0) AS n_links FROM m LEFT JOIN l ON l.id = m.class LEFT JOIN g ON g.id = m.class""",
    "p9_found": SPANS + "SELECT doc_id, span_start, span_end FROM spans",
    "p9_shares": SPANS + ", c AS (SELECT doc_id, sum(span_end - span_start) AS c FROM spans GROUP BY doc_id) SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INTEGER) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, CASE WHEN coalesce(length(d.text), 0) > 0 THEN coalesce(c, 0) / length(d.text) ELSE 0 END AS share FROM (SELECT DISTINCT doc_id, text FROM documents) d LEFT JOIN c USING (doc_id)",
}
