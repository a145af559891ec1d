"""Queries over relations: deduplication, assets, planners, state, trees of blocks, corpus export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions import scalars as S
from papyrion.operators import chunks as C
from papyrion.operators import flat, hierarchy, outline, trees
from papyrion.operators import relations as R
from papyrion.plans.problems import CLIMB
from papyrion.plans.texts import CHUNKS
from papyrion.runtime import store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ deduplication


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))
    return R.keep_first(docs, ["digest"], ["doc_id"]).select("doc_id", "lang", "source")


@query("SELECT count(*) AS occurrences, count(DISTINCT sha256(text)) AS different, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents WHERE text IS NOT NULL")
def dedup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return R.duplicate_stats(table(spark, folder, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_key, min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id AS duplicate FROM documents WHERE text IS NOT NULL")
def duplicate_of(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return R.duplicate_of(docs, "digest", "doc_id").drop("digest")


@query("SELECT txt, count(*) AS n FROM (SELECT DISTINCT * FROM web_blocks) WHERE txt IS NOT NULL GROUP BY txt HAVING count(*) >= 3")
def repeated_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return R.repeated(table(spark, folder, "web_blocks").distinct().where("txt is not null").select("txt"), ["txt"], 3)


@query("""WITH i AS (SELECT DISTINCT package_id, block_no, src FROM blocks WHERE kind = 'image' AND src IS NOT NULL), r AS (SELECT *, count(*) OVER (PARTITION BY src) AS n, row_number() OVER (PARTITION BY src ORDER BY package_id, block_no) AS k FROM i)
SELECT package_id, block_no, src FROM r WHERE n < 3 OR k = 1""")
def repeated_images_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "blocks").where("kind = 'image' and src is not null").select("package_id", "block_no", "src").distinct()
    return R.collapse_repeated(images, ["src"], ["package_id", "block_no"], 3)


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY first_at, src) AS k FROM (SELECT package_id, src, min(block_no) AS first_at FROM blocks WHERE kind = 'image' AND src IS NOT NULL GROUP BY ALL))
SELECT package_id, src, first_at, 'image_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || regexp_extract(src, '(\\.[^./]+)$', 1) AS name FROM i""".replace("\\\\", "\\"))
def image_names(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "blocks").where("kind = 'image'")
    return R.first_seen_names(images, ["package_id"], "src", "block_no", "image", F.regexp_extract("src", r"(\.[^./]+)$", 1))


# ------------------------------------------------------------ joins


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k, l_suppkey AS key FROM lineitem), s AS (SELECT c_nationkey, c_custkey, c_custkey % 97 + 1 AS key, row_number() OVER (PARTITION BY c_custkey % 97 + 1 ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_custkey % 97 + 1) AS n FROM customer)
SELECT l.key, l_orderkey, l_linenumber, l_partkey, s.c_custkey FROM l JOIN s ON l.key = s.key AND s.k = least(l.k, s.n)""")
def positional_clamped_join(spark: SparkSession, folder: str) -> DataFrame:
    left = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", "l_partkey")
    right = table(spark, folder, "customer").select((F.col("c_custkey") % 97 + 1).alias("key"), "c_custkey")
    return R.clamped_positions(left, right, ["key"], ["l_orderkey", "l_linenumber", "l_partkey"], ["c_custkey"]).select("key", "l_orderkey", "l_linenumber", "l_partkey", "c_custkey")


@query("""SELECT DISTINCT o_orderkey, n_nationkey, p.c_custkey FROM (SELECT o_orderkey, o_custkey, o_custkey % 25 AS nation FROM orders) o JOIN (SELECT n_nationkey, n_nationkey * 60 AS lo, n_nationkey * 60 + 89 AS hi FROM nation) n ON o_custkey BETWEEN lo AND hi JOIN customer p ON p.c_custkey = o_custkey""")
def range_lookup(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("at"), F.lit(1).alias("one"))
    ranges = table(spark, folder, "nation").select("n_nationkey", (F.col("n_nationkey") * 60).alias("lo"), (F.col("n_nationkey") * 60 + 89).alias("hi"), F.lit(1).alias("one"))
    found = R.in_range(points, ranges, "at", "lo", "hi", 64, ["one"])
    return found.join(table(spark, folder, "customer").select("c_custkey"), F.col("at") == F.col("c_custkey")).select("o_orderkey", "n_nationkey", "c_custkey").distinct()


@query("""WITH q AS (SELECT DISTINCT package_id, title, package, lower(title) AS k1, package AS k2, CAST(package_id AS VARCHAR) AS k3 FROM packages), l AS (SELECT lower(title) AS k, min(page_id) AS v FROM page_tree WHERE title IS NOT NULL GROUP BY 1)
SELECT package_id, coalesce(min(a.v), min(b.v), min(c.v)) AS page FROM q LEFT JOIN l a ON a.k = k1 LEFT JOIN l b ON b.k = k2 LEFT JOIN l c ON c.k = k3 GROUP BY package_id""")
def prioritised_lookup(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "packages").select("package_id", "title", "package").distinct()
    pages = table(spark, folder, "page_tree").where("title is not null").select(F.lower("title").alias("k"), F.col("page_id").alias("page"))
    return R.prioritised(packages, [F.lower("title"), F.col("package"), F.col("package_id").cast("string")], pages, "k", "page", "package_id").withColumnRenamed("value", "page")


@query("""WITH u AS (SELECT title, min(page_id) AS page_id FROM (SELECT DISTINCT title, page_id FROM page_tree) GROUP BY title HAVING count(*) = 1)
SELECT DISTINCT package_id, p.title, u.page_id FROM packages p LEFT JOIN u ON u.title = p.title""")
def unambiguous_title(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "packages").select("package_id", "title").distinct()
    pages = table(spark, folder, "page_tree").select(F.col("title").alias("t"), "page_id").distinct()
    return R.unique_lookup(packages, "title", pages, "t", "page_id").select("package_id", "title", "page_id")


# ------------------------------------------------------------ sources, filters, order


@query("""SELECT o_orderkey, o_custkey, CAST(o_orderdate AS VARCHAR) AS updated FROM orders WHERE o_orderstatus = 'O' AND (lower(o_orderpriority) LIKE '%urgent%' OR CAST(o_orderkey AS VARCHAR) LIKE '%urgent%') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def issue_page(spark: SparkSession, folder: str) -> DataFrame:
    found = flat.issue_filter(table(spark, folder, "orders"), {"o_orderstatus": "O"}, ["o_orderpriority", "o_orderkey"], "urgent")
    return flat.page_of(found, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 100).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, 0 AS s FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id, event_type, 1 FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, event_type, 2 FROM events)
SELECT event_id, user_id, event_type, s AS source_no FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s) AS r FROM e) WHERE r = 1""")
def comments_union(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return R.union_first([events.where("event_id % 3 = 0"), events.where("event_id % 2 = 0"), events], ["event_id"], ["user_id", "event_type"])


@query("""SELECT event_id, k AS field, CASE k WHEN 'page' THEN 'Page' WHEN 'ref' THEN 'Reference' ELSE k END AS name, v AS value FROM (SELECT event_id, unnest(json_keys(props)) AS k, unnest(list_transform(json_keys(props), lambda x: json_extract_string(props, '$.' || x))) AS v FROM events WHERE props IS NOT NULL) WHERE v IS NOT NULL AND v NOT IN ('', '[]', '{}') AND k NOT IN ('description', 'attachment', 'comment')""")
def useful_fields(spark: SparkSession, folder: str) -> DataFrame:
    return flat.useful_fields(table(spark, folder, "events"), "event_id", "props", names={"page": "Page", "ref": "Reference"})


# ------------------------------------------------------------ wiki tree and publishing


@query(CLIMB + """, b AS (SELECT page_id, arg_max({'t': title}, version_no).t AS title, arg_max({'p': child_position}, version_no).p AS pos FROM page_tree GROUP BY page_id)
SELECT t.page_id, t.depth - 1 AS depth, b.title, array_to_string(t.path, ' / ') AS breadcrumb, CAST(row_number() OVER (PARTITION BY e.parent ORDER BY b.pos NULLS FIRST, lower(b.title) NULLS FIRST, b.title NULLS FIRST, t.page_id) AS INTEGER) AS sibling_no FROM tree t JOIN b USING (page_id) JOIN edges e USING (page_id) WHERE t.depth BETWEEN 0 AND 3""")
def root_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_tree")
    tree = hierarchy.hierarchy(pages, "page_id", "parent_id", "version_no").where("depth between 0 and 3")
    last = hierarchy.latest_rows(pages, "page_id", "parent_id", "version_no", ("title", "child_position")).select("node", F.col("keep_title").alias("title"), F.col("keep_child_position").alias("pos"))
    parent = F.when(F.col("depth") > 0, F.element_at("path", -2))
    rows = tree.withColumn("above", parent).join(last, "node")
    no = F.row_number().over(Window.partitionBy("above").orderBy("pos", F.lower("title"), "title", "node"))
    return rows.select(F.col("node").alias("page_id"), (F.col("depth") - 1).alias("depth"), "title", F.array_join("path", " / ").alias("breadcrumb"), no.alias("sibling_no"))


PLAN = """WITH r AS (SELECT DISTINCT space_key AS space, page_id, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY version_no DESC, title) AS k FROM page_tree) WHERE k = 1),
q AS (SELECT DISTINCT package_id AS request_id, space_key AS space, title FROM packages WHERE title IS NOT NULL),
s AS (SELECT space, lower(title) AS key, count(*) AS n, min(page_id) AS titled FROM r GROUP BY ALL)"""


def publish_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = hierarchy.latest_rows(table(spark, folder, "page_tree"), "page_id", "parent_id", "version_no", ("space_key", "title"))
    remote = pages.select(F.col("keep_space_key").alias("space"), F.col("node").alias("page_id"), F.col("keep_title").alias("title"))
    requests = table(spark, folder, "packages").where("title is not null").select(F.col("package_id").alias("request_id"), F.col("space_key").alias("space"), "title", F.lit(None).cast("string").alias("known_page")).distinct()
    return requests, remote


@query(PLAN + """ SELECT request_id, q.title, CASE WHEN n IS NULL THEN 'create' WHEN n = 1 THEN 'update' ELSE 'error' END AS action, CASE WHEN n = 1 THEN titled END AS page_id, CASE WHEN n > 1 THEN 'several pages of this title' END AS reason FROM q LEFT JOIN s ON s.space = q.space AND s.key = lower(q.title)""")
def publish_plan(spark: SparkSession, folder: str) -> DataFrame:
    requests, remote = publish_tables(spark, folder)
    return R.publish_plan(requests, remote, "replace")


FREE = r""", t AS (SELECT DISTINCT space, regexp_extract(lower(title), '^(.*?)(?: \((\d+)\))?$', 1) AS key, coalesce(TRY_CAST(regexp_extract(lower(title), '^(.*?)(?: \((\d+)\))?$', 2) AS INTEGER), 1) AS no FROM r),
f AS (SELECT q.request_id, q.title, (SELECT min(c) FROM range(1, 10000) x(c) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.space = q.space AND t.key = lower(q.title) AND t.no = c)) AS c FROM q)"""


@query(PLAN + FREE + """ SELECT request_id, CASE WHEN c = 1 THEN title ELSE title || ' (' || c || ')' END AS free_title FROM f""")
def free_titles(spark: SparkSession, folder: str) -> DataFrame:
    requests, remote = publish_tables(spark, folder)
    return R.free_titles(requests.select("request_id", "space", "title"), remote)


@query("""SELECT user_id, event_type, arg_max({'e': event_id, 'v': value}, {'t': ts, 'e': event_id, 'v': value}).e AS event_id, arg_max({'e': event_id, 'v': value}, {'t': ts, 'e': event_id, 'v': value}).v AS value FROM events GROUP BY ALL""")
def state_upsert(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return R.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH st AS (SELECT DISTINCT space_key AS space, lang, source_format AS fmt, package_id AS page FROM packages WHERE space_key IS NOT NULL AND lang IS NOT NULL AND source_format IS NOT NULL),
rq AS (SELECT DISTINCT package_id AS request_id, space_key AS space, lang, source_format AS fmt FROM packages),
a AS (SELECT space, lang, fmt, min(page) AS v FROM st GROUP BY ALL HAVING count(*) = 1), b AS (SELECT space, lang, min(page) AS v FROM st GROUP BY ALL HAVING count(*) = 1), c AS (SELECT space, min(page) AS v FROM st GROUP BY ALL HAVING count(*) = 1)
SELECT request_id, coalesce(a.v, b.v, c.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 WHEN c.v IS NOT NULL THEN 2 END AS level FROM rq LEFT JOIN a USING (space, lang, fmt) LEFT JOIN b USING (space, lang) LEFT JOIN c USING (space)""")
def state_cascade(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "packages").select("package_id", F.col("space_key").alias("space"), "lang", F.col("source_format").alias("fmt")).distinct()
    state = rows.dropna().withColumnRenamed("package_id", "page")  # a state entry has all three
    return R.cascade(rows.withColumnRenamed("package_id", "request_id"), state, "request_id", [["space", "lang", "fmt"], ["space", "lang"], ["space"]], "page")


@query("""SELECT package_id, src FROM (SELECT DISTINCT package_id, src FROM blocks WHERE src IS NOT NULL) l WHERE NOT EXISTS (SELECT 1 FROM blocks r WHERE r.src = l.src AND r.package_id = l.package_id + 1)""")
def attachments_to_upload(spark: SparkSession, folder: str) -> DataFrame:
    local = table(spark, folder, "blocks").where("src is not null").select("package_id", "src").distinct()
    remote = local.select((F.col("package_id") - 1).alias("package_id"), "src")
    return R.to_upload(local, remote, ["package_id", "src"])


@query("""SELECT regexp_extract(original_path, '([^/]*)$', 1) AS file_name, arg_max(original_path, {'p': package_id, 'o': original_path}) AS original_path FROM packages WHERE original_path IS NOT NULL GROUP BY 1""")
def attachment_selection(spark: SparkSession, folder: str) -> DataFrame:
    return R.last_by_name(table(spark, folder, "packages").where("original_path is not null"), "original_path", "package_id")


# ------------------------------------------------------------ corpus


@query(CHUNKS + ", n AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id) SELECT d.doc_id, substr(sha256(d.text), 1, 16) AS document_id, d.lang, n.n_chunks FROM documents d JOIN n USING (doc_id)")
def corpus_index(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    packages = docs.select("doc_id", S.document_id(F.sha2("text", 256), F.col("doc_id").cast("string")).alias("document_id"), "lang")
    return R.corpus_index(packages, C.chunk(docs, "text", ["doc_id"]), "doc_id")


@query(CHUNKS + "SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM chunks")
def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    per_doc = C.chunk(table(spark, folder, "documents"), "text", ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE rag_markdown IS NOT NULL AND chunk_count IS NOT NULL) AS succeeded, count(*) FILTER (WHERE rag_markdown IS NULL OR chunk_count IS NULL) AS failed, CAST(sum(CASE WHEN overlap_chars > chunk_size THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM rag_exports")
def batch_report(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("rag_markdown").isNull() | F.col("chunk_count").isNull()
    return R.batch_report(table(spark, folder, "rag_exports"), failed, F.coalesce((F.col("overlap_chars") > F.col("chunk_size")).cast("int"), F.lit(0)))


@query("""SELECT DISTINCT export_id, CASE WHEN rag_markdown IS NULL THEN 'no text' ELSE 'no count' END AS reason FROM rag_exports WHERE rag_markdown IS NULL OR chunk_count IS NULL""")
def batch_failures(spark: SparkSession, folder: str) -> DataFrame:
    """The items that a batch report counts as failed, each with its reason."""
    reason = F.when(F.col("rag_markdown").isNull(), "no text").when(F.col("chunk_count").isNull(), "no count")
    return R.failures(table(spark, folder, "rag_exports"), "export_id", reason)


# ------------------------------------------------------------ blocks of packages


FLAT = r"""WITH b AS (SELECT DISTINCT package_id, block_no, kind, heading_level, txt, src FROM blocks),
m AS (SELECT package_id, block_no, CASE
  WHEN kind = 'heading' THEN repeat('#', CAST(greatest(1, least(6, coalesce(heading_level, 1))) AS INTEGER)) || ' ' || regexp_replace(regexp_replace(coalesce(txt, ''), '([\\*_`\[\]])', '\\\1', 'g'), '^\s+|\s+$', '', 'g')
  WHEN kind = 'paragraph' THEN regexp_replace(regexp_replace(coalesce(txt, ''), '([\\*_`\[\]])', '\\\1', 'g'), '^\s+|\s+$', '', 'g')
  WHEN kind = 'code_block' THEN '```' || chr(10) || coalesce(txt, '') || chr(10) || '```'
  WHEN kind = 'blockquote' THEN '> ' || replace(coalesce(txt, ''), chr(10), chr(10) || '> ')
  WHEN kind = 'image' THEN CASE WHEN coalesce(src, '') <> '' THEN '![' || coalesce(txt, '') || '](' || src || ')' ELSE '' END
  WHEN kind IN ('list', 'table') THEN coalesce(txt, '') ELSE '' END AS md FROM b)
"""


@query(FLAT + "SELECT package_id, count(*) FILTER (WHERE md <> '') AS n_blocks, string_agg(md, chr(10) || chr(10) ORDER BY block_no) FILTER (WHERE md <> '') AS markdown FROM m GROUP BY package_id")
def package_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return flat.documents(table(spark, folder, "blocks"), "package_id", "block_no")


@query(r"""WITH b AS (SELECT DISTINCT package_id, block_no, kind, heading_level, txt, src FROM blocks),
e AS (SELECT *, replace(replace(replace(coalesce(txt, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, CAST(greatest(1, least(6, coalesce(heading_level, 1))) AS VARCHAR) AS l, replace(replace(replace(coalesce(src, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS s FROM b),
x AS (SELECT *, list_filter(string_split(t, chr(10)), lambda y: trim(y) <> '') AS ls, CASE WHEN regexp_matches(t, '^\s*\d+[.)]\s') THEN 'ol' ELSE 'ul' END AS tag FROM e)
SELECT package_id, block_no, CASE kind WHEN 'heading' THEN '<h' || l || '>' || t || '</h' || l || '>' WHEN 'paragraph' THEN '<p>' || t || '</p>' WHEN 'code_block' THEN '<pre><code>' || t || '</code></pre>' WHEN 'blockquote' THEN '<blockquote><p>' || t || '</p></blockquote>' WHEN 'rule' THEN '<hr/>'
WHEN 'list' THEN '<' || tag || '>' || array_to_string(list_transform(ls, lambda y: '<li>' || trim(regexp_replace(y, '^\s*(?:[-*+]|\d+[.)])\s+', '')) || '</li>'), '') || '</' || tag || '>'
WHEN 'table' THEN '<table>' || array_to_string(list_transform(ls, lambda y: '<tr>' || array_to_string(list_transform(string_split(regexp_replace(trim(y), '^\||\|$', '', 'g'), '|'), lambda c: '<td>' || trim(c) || '</td>'), '') || '</tr>'), '') || '</table>'
WHEN 'image' THEN CASE WHEN s <> '' THEN '<img src="' || replace(replace(s, '"', '&quot;'), chr(39), '&#x27;') || '" alt="' || replace(replace(t, '"', '&quot;'), chr(39), '&#x27;') || '"/>' ELSE '' END ELSE '' END AS html FROM x""")
def block_html(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "blocks").select("package_id", "block_no", "kind", "heading_level", "txt", "src").distinct()
    return rows.select("package_id", "block_no", flat.html(F.col("kind"), F.col("heading_level"), F.col("txt"), F.col("src")).alias("html"))


@query(r"""WITH b AS (SELECT DISTINCT package_id, block_no, txt FROM blocks WHERE kind = 'table' AND txt IS NOT NULL), l AS (SELECT package_id, block_no, unnest(string_split(txt, chr(10))) AS line FROM b)
SELECT package_id, block_no, CAST(count(*) AS INTEGER) AS n_rows, CAST(max(len(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'))) AS INTEGER) AS n_columns FROM l WHERE trim(line) <> '' GROUP BY ALL""")
def table_shape(spark: SparkSession, folder: str) -> DataFrame:
    return flat.table_shape(table(spark, folder, "blocks").where("kind = 'table' and txt is not null").select("package_id", "block_no", "txt").distinct(), ["package_id", "block_no"], "txt")


@query(r"""WITH b AS (SELECT DISTINCT package_id, block_no, txt FROM blocks WHERE kind = 'table' AND txt IS NOT NULL), l AS (SELECT package_id, block_no, unnest(string_split(txt, chr(10))) AS line, unnest(range(1, len(string_split(txt, chr(10))) + 1)) AS r FROM b), c AS (SELECT *, string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|') AS cs FROM l WHERE trim(line) <> '')
SELECT package_id, block_no, CAST(r AS INTEGER) AS row_no, CAST(unnest(range(1, len(cs) + 1)) AS INTEGER) AS column_no, trim(unnest(cs)) AS cell FROM c""")
def table_cells(spark: SparkSession, folder: str) -> DataFrame:
    return flat.table_cells(table(spark, folder, "blocks").where("kind = 'table' and txt is not null").select("package_id", "block_no", "txt").distinct(), ["package_id", "block_no"], "txt")


@query("""SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || replace(r_name, '|', '\\|') || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM region""".replace("\\\\", "\\"))
def table_markdown_region(spark: SparkSession, folder: str) -> DataFrame:
    return flat.markdown_table(table(spark, folder, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])


def _heading_numbers_sql(deepest: int) -> str:
    """For each level: how many higher ones came before (``u``), the first as deep since then (``f``), its count (``c``)."""
    levels = range(1, deepest + 1)
    above = ", ".join(f"sum(CASE WHEN level < {k} THEN 1 ELSE 0 END) OVER w AS u{k}" for k in levels)
    first = ", ".join(f"arg_min(level, block_no) FILTER (WHERE level >= {k}) OVER (PARTITION BY package_id, u{k} ORDER BY block_no) AS f{k}, sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY package_id, u{k} ORDER BY block_no) AS c{k}" for k in levels)
    shown = ", ".join(f"CASE WHEN level >= {k} THEN CAST(c{k} + CASE WHEN f{k} > {k} THEN 1 ELSE 0 END AS VARCHAR) END" for k in levels)
    return f"""WITH h AS (SELECT DISTINCT package_id, block_no, CAST(coalesce(heading_level, 1) AS INTEGER) AS level FROM blocks WHERE kind = 'heading'),
a AS (SELECT *, {above} FROM h WINDOW w AS (PARTITION BY package_id ORDER BY block_no)), f AS (SELECT *, {first} FROM a) SELECT package_id, block_no, level, concat_ws('.', {shown}) AS number FROM f"""


@query(_heading_numbers_sql(6))
def heading_numbers(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "blocks").where("kind = 'heading'").select("package_id", "block_no", F.coalesce("heading_level", F.lit(1)).alias("level")).distinct()
    return R.heading_numbers(heads, ["package_id"], "block_no", "level", 6)


@query("""WITH h AS (SELECT DISTINCT package_id, block_no, length(txt) AS indent FROM blocks WHERE kind = 'heading') SELECT package_id, block_no, CAST(least(6, dense_rank() OVER (PARTITION BY package_id ORDER BY indent)) AS INTEGER) AS level FROM h""")
def indent_levels(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "blocks").where("kind = 'heading'").select("package_id", "block_no", F.length("txt").alias("indent")).distinct()
    return heads.select("package_id", "block_no", F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("package_id").orderBy("indent"))).alias("level"))


@query("""SELECT package_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CASE WHEN count(DISTINCT space_key) = 1 THEN min(space_key) END AS uniform_space, count(DISTINCT kind) <= 2 AS plain FROM blocks GROUP BY package_id""")
def package_kinds(spark: SparkSession, folder: str) -> DataFrame:
    one = F.when(F.count_distinct("space_key") == 1, F.min("space_key"))
    return table(spark, folder, "blocks").groupBy("package_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), one.alias("uniform_space"), (F.count_distinct("kind") <= 2).alias("plain"))


@query("""SELECT package_id, count(*) FILTER (WHERE kind = 'heading') AS headings, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'image' AND src IS NULL) AS images_without_file, count(*) FILTER (WHERE kind = 'table') AS tables FROM (SELECT DISTINCT package_id, block_no, kind, src FROM blocks) GROUP BY package_id""")
def package_counters(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("kind")
    rows = table(spark, folder, "blocks").select("package_id", "block_no", "kind", "src").distinct()
    return rows.groupBy("package_id").agg(F.count_if(kind == "heading").alias("headings"), F.count_if(kind == "image").alias("images"), F.count_if((kind == "image") & F.col("src").isNull()).alias("images_without_file"), F.count_if(kind == "table").alias("tables"))


@query("""SELECT space_key, min(title) AS first_title, count(*) AS pages FROM page_tree WHERE space_key IS NOT NULL GROUP BY space_key ORDER BY lower(space_key), space_key""")
def spaces_by_name(spark: SparkSession, folder: str) -> DataFrame:
    spaces = table(spark, folder, "page_tree").where("space_key is not null").groupBy("space_key").agg(F.min("title").alias("first_title"), F.count(F.lit(1)).alias("pages"))
    return spaces.orderBy(F.lower("space_key"), "space_key")


@query("""SELECT c_mktsegment AS series, max(c_acctbal) AS greatest_value, sum(greatest(0, c_acctbal)) AS pie_total FROM customer GROUP BY 1""")
def chart_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("series")).agg(F.max("c_acctbal").alias("greatest_value"), F.sum(F.greatest(F.lit(0.0), "c_acctbal")).alias("pie_total"))


# ------------------------------------------------------------ trees: rows only, held against fixtures in the tests


@query()
def canonical_written(spark: SparkSession, folder: str) -> DataFrame:
    return trees.converted(flat.unwrapped(table(spark, folder, "canonical_json"), "package_id", "payload", "ingested_at"), "package_id", "payload", "canonical", ["markdown", "rag", "html", "wiki", "adf"])


@query()
def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return trees.block_rows(table(spark, folder, "rag_exports").select("export_id", "rag_markdown").distinct(), "export_id", "rag_markdown", "markdown")


@query()
def html_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    pages = trees.converted(flat.unwrapped(table(spark, folder, "canonical_json"), "package_id", "payload", "ingested_at"), "package_id", "payload", "canonical", ["html"])
    return trees.block_rows(pages.where("html is not null"), "key", "html", "html")


@query()
def outline_matches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    heads = C.outline(docs, "text", ["doc_id"]).select("doc_id", F.col("line_no").alias("entry_no"), "level", F.lower("title").alias("title"))
    return outline.matched(docs, "doc_id", "text", store(heads, "heads"))
