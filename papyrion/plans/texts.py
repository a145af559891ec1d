"""Queries over texts: chunks, lines, headings, scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import scalars as S
from papyrion.operators import chunks as C
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


# The chunker's contract in SQL: lines, heading stack by last heading of each level, paragraphs folded by list_reduce.
CHUNKS = r"""
WITH raw AS (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', '') AS t FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, lang, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM raw),
hd AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+.') THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) ELSE 0 END AS lv, regexp_replace(regexp_extract(line, '^#{1,6}\s+(.+)$', 1), '^\s+|\s+$', '', 'g') AS title FROM ln),
sec AS (SELECT *, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM hd),
s AS (SELECT doc_id, any_value(lang) AS lang, sec, max(lv) AS lv, max(CASE WHEN lv > 0 THEN title END) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS txt FROM sec GROUP BY doc_id, sec),
p AS (SELECT *,
  arg_max({'l': lv, 't': title}, sec) FILTER (WHERE lv BETWEEN 1 AND 1) OVER w AS h1, arg_max({'l': lv, 't': title}, sec) FILTER (WHERE lv BETWEEN 1 AND 2) OVER w AS h2,
  arg_max({'l': lv, 't': title}, sec) FILTER (WHERE lv BETWEEN 1 AND 3) OVER w AS h3, arg_max({'l': lv, 't': title}, sec) FILTER (WHERE lv BETWEEN 1 AND 4) OVER w AS h4,
  arg_max({'l': lv, 't': title}, sec) FILTER (WHERE lv BETWEEN 1 AND 5) OVER w AS h5, arg_max({'l': lv, 't': title}, sec) FILTER (WHERE lv BETWEEN 1 AND 6) OVER w AS h6
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY sec)),
q AS (SELECT doc_id, lang, sec, txt, array_to_string(list_filter([CASE WHEN h1.l = 1 THEN h1.t END, CASE WHEN h2.l = 2 THEN h2.t END, CASE WHEN h3.l = 3 THEN h3.t END, CASE WHEN h4.l = 4 THEN h4.t END, CASE WHEN h5.l = 5 THEN h5.t END, CASE WHEN h6.l = 6 THEN h6.t END], lambda x: x IS NOT NULL AND x <> ''), ' > ') AS path FROM p WHERE txt <> ''),
para AS (SELECT *, list_filter(list_transform(regexp_split_to_array(txt, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM q),
fold AS (SELECT doc_id, lang, sec, path, CASE WHEN length(txt) <= 1600 THEN [txt] ELSE
  list_reduce(list_transform(ps, lambda x: {'b': x, 'o': CAST([] AS VARCHAR[])}), lambda a, x:
    CASE WHEN length(CASE WHEN a.b = '' THEN x.b ELSE a.b || chr(10) || chr(10) || x.b END) <= 1600 THEN {'b': CASE WHEN a.b = '' THEN x.b ELSE a.b || chr(10) || chr(10) || x.b END, 'o': a.o}
      WHEN a.b <> '' THEN {'b': regexp_replace(substr(a.b, greatest(1, length(a.b) - 149)) || chr(10) || chr(10) || x.b, '^\s+|\s+$', '', 'g'), 'o': list_append(a.o, a.b)}
      ELSE {'b': '', 'o': list_concat(a.o, list_filter(list_transform(range(0, 1 + CASE WHEN length(x.b) <= 1600 THEN 0 ELSE CAST(ceil((length(x.b) - 1600) / 1450.0) AS BIGINT) END), lambda k: regexp_replace(substr(x.b, k * 1450 + 1, 1600), '^\s+|\s+$', '', 'g')), lambda y: y <> ''))} END,
    {'b': '', 'o': CAST([] AS VARCHAR[])}) END AS f FROM para)
"""
CHUNKS = CHUNKS.replace("CASE WHEN length(txt) <= 1600 THEN [txt] ELSE", "CASE WHEN length(txt) <= 1600 THEN {'b': txt, 'o': CAST([] AS VARCHAR[])} ELSE") + r""",
c AS (SELECT doc_id, lang, sec, path, unnest(CASE WHEN f.b <> '' THEN list_append(f.o, f.b) ELSE f.o END) AS content, unnest(range(1, 1 + len(CASE WHEN f.b <> '' THEN list_append(f.o, f.b) ELSE f.o END))) AS k FROM fold),
chunks AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) AS INTEGER) AS chunk_id, path AS heading_path, content, CASE WHEN path <> '' THEN path || chr(10) || chr(10) || content ELSE content END AS embedding_text FROM c)
"""


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.chunk(table(spark, folder, "documents"), "text", ["doc_id", "lang"])


@query(CHUNKS + "SELECT doc_id, chunk_id, heading_path, content, embedding_text FROM chunks")
def chunks_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("doc_id", "chunk_id", F.array_join("heading_path", " > ").alias("heading_path"), "content", "embedding_text")


@query(CHUNKS + "SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents, max(length(content)) AS longest, CAST(sum(length(content)) AS BIGINT) AS characters FROM chunks GROUP BY lang")
def chunk_stats_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    per_doc = _chunks(spark, folder).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("content")).alias("m"), F.sum(F.length("content")).alias("c"))
    return per_doc.groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_documents"), F.max("m").alias("longest"), F.sum("c").alias("characters"))


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM
(SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''))""")
def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return C.lines(table(spark, folder, "documents"), "text", ["doc_id"])


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))), '^\s+|\s+$', '', 'g') AS line, unnest(range(1, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l),
p AS (SELECT doc_id, run, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS paragraph FROM g WHERE line <> '' GROUP BY doc_id, run)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) AS INTEGER) AS paragraph_no, CAST(n_lines AS INTEGER) AS n_lines, paragraph FROM p""")
def document_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return C.paragraphs(table(spark, folder, "documents"), "text", ["doc_id"])


def _clean_heading_sql(col: str) -> str:
    steps = ((r"^\s+|\s+$", ""), (r"^#{1,6}\s+", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"[`*_~]", ""), (S.LEADING_NUMBER, ""), (S.TRAILING_PAGE, ""), (r"\s+", " "), (S.HEADING_ENDS, ""))
    for pattern, instead in steps:
        col = f"regexp_replace({col}, '{pattern}', '{instead}', 'g')"
    return col


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text <> '')
SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST(length(regexp_extract(line, '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*$', 1)) AS INTEGER) AS level, {_clean_heading_sql(r"regexp_extract(line, '^\s{0,3}(#{1,6})\s+(.+?)\s*$', 2)")} AS title, CAST(0.8 AS DOUBLE) AS confidence FROM l WHERE regexp_matches(line, '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*$')""")
def document_outline(spark: SparkSession, folder: str) -> DataFrame:
    return C.outline(table(spark, folder, "documents"), "text", ["doc_id"])


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE contains(text, '```')),
m AS (SELECT *, starts_with(trim(line), '```') AS mark, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l)
SELECT doc_id, CAST((n + 1) // 2 AS INTEGER) AS fence_no, max(CASE WHEN mark AND n % 2 = 1 THEN trim(substr(trim(line), 4)) END) AS language, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT mark), '') AS code FROM m WHERE n % 2 = 1 GROUP BY doc_id, n""")
def code_fences(spark: SparkSession, folder: str) -> DataFrame:
    return C.fences(table(spark, folder, "documents"), "text", ["doc_id"])


@query(r"SELECT package_id, block_no, regexp_replace(txt, '([\\*_`\[\]])', '\\\1', 'g') AS escaped FROM blocks WHERE txt IS NOT NULL")
def escape_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").where("txt is not null").select("package_id", "block_no", S.escape_markdown(F.col("txt")).alias("escaped"))


@query("""SELECT package_id, block_no, replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM web_blocks WHERE txt IS NOT NULL""")
def escape_html(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "web_blocks").where("txt is not null").select("package_id", "block_no", S.escape_html(F.col("txt")).alias("escaped"))


@query(r"""SELECT DISTINCT package_id, package, CASE WHEN coalesce(source_sha256, '') <> '' THEN substr(source_sha256, 1, 16) ELSE coalesce(nullif(regexp_replace(regexp_replace(package, '[^A-Za-z0-9._ -]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), ''), 'document') END AS document_id FROM packages""")
def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packages").select("package_id", "package", S.document_id(F.col("source_sha256"), F.col("package")).alias("document_id")).distinct()


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def document_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(r"""SELECT DISTINCT package_id, lower(regexp_extract(original_path, '\.([^./\\]+)$', 1)) AS ext,
coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(original_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9._ -]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), ''), 'document') || '__' || lower(regexp_extract(original_path, '\.([^./\\]+)$', 1)) AS package_dir
FROM packages WHERE lower(regexp_extract(original_path, '\.([^./\\]+)$', 1)) IN ('doc', 'docx', 'docm', 'pdf', 'ppt', 'pptx', 'pptm', 'odp', 'xls', 'xlsx', 'xlsm', 'ods', 'odt', 'rtf', 'txt', 'csv', 'html', 'htm', 'md', 'markdown')""")
def discovered_files(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("original_path")
    return table(spark, folder, "packages").where(S.supported(path)).select("package_id", S.extension(path).alias("ext"), S.package_name(path).alias("package_dir")).distinct()


GENERIC = "('untitled','document','document1','document 1','microsoft word','microsoft word document','powerpoint presentation','presentation','presentation1','presentation 1','adobe acrobat')"


@query(rf"""WITH c AS (SELECT DISTINCT p.package_id, trim(regexp_replace(p.title, '\s+', ' ', 'g')) AS t, b.h, regexp_replace(regexp_extract(p.original_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS f FROM packages p
LEFT JOIN (SELECT package_id, arg_min(trim(regexp_replace(txt, '\s+', ' ', 'g')), block_no) AS h FROM blocks WHERE kind = 'heading' AND trim(txt) <> '' AND lower(trim(regexp_replace(txt, '\s+', ' ', 'g'))) NOT IN {GENERIC} AND length(trim(regexp_replace(txt, '\s+', ' ', 'g'))) <= 240 GROUP BY package_id) b USING (package_id)),
g AS (SELECT package_id, CASE WHEN t <> '' AND lower(t) NOT IN {GENERIC} AND length(t) <= 240 THEN t END AS t, h, CASE WHEN f <> '' AND lower(f) NOT IN {GENERIC} AND length(f) <= 240 THEN f END AS f FROM c)
SELECT package_id, coalesce(t, h, f) AS title, CASE WHEN t IS NOT NULL THEN 'metadata' WHEN h IS NOT NULL THEN 'document_heading' WHEN f IS NOT NULL THEN 'filename' END AS title_source FROM g""")
def package_titles(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "blocks").where("kind = 'heading'").select("package_id", "block_no", S.clean_title(F.col("txt")).alias("h")).where("h is not null").groupBy("package_id").agg(F.min_by("h", "block_no").alias("h"))
    named = table(spark, folder, "packages").select("package_id", "title", "original_path").distinct().join(heads, "package_id", "left")
    title, origin = S.first_title(("metadata", F.col("title")), ("document_heading", F.col("h")), ("filename", S.stem(F.col("original_path"))))
    return named.select("package_id", title.alias("title"), origin.alias("title_source"))


@query(r"""SELECT DISTINCT package_id, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)) AS domain FROM web_blocks WHERE source_url IS NOT NULL""")
def page_domains(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "web_blocks").where("source_url is not null").select("package_id", S.normalize_domain(F.col("source_url")).alias("domain")).distinct()


@query("""SELECT lang, CASE WHEN split_part(lower(trim(coalesce(lang, ''))), '-', 1) IN ('en', 'fr', 'de', 'es', 'zh') THEN split_part(lower(trim(coalesce(lang, ''))), '-', 1) ELSE 'en' END AS language, count(*) AS n FROM documents GROUP BY ALL""")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", S.language(F.col("lang")).alias("language"), "n")


def _roman_sql(n: str) -> str:
    """Each sign takes what the greater ones left."""
    parts = []
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        parts.append(f"repeat('{sign}', CAST(({n}) // {value} AS INTEGER))")
        n = f"({n}) % {value}"
    return " || ".join(parts)


def _letters_sql(n: str) -> str:
    """Letters count without zero; each place starts at the first number that has it."""
    starts = [(26 ** (place + 1) - 26) // 25 + 1 for place in range(13)]
    return " || ".join(f"CASE WHEN {n} >= {start} THEN chr(CAST(65 + (({n} - {start}) // {26**place}) % 26 AS INTEGER)) ELSE '' END" for place, start in reversed(list(enumerate(starts))))


@query(f"""SELECT DISTINCT n, CASE WHEN n > 0 THEN {_roman_sql("n")} ELSE CAST(n AS VARCHAR) END AS roman, CASE WHEN n > 0 THEN {_letters_sql("n")} ELSE CAST(n AS VARCHAR) END AS letters FROM (SELECT l_partkey AS n FROM lineitem WHERE l_partkey IS NOT NULL)""")
def numerals(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n")
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("n")).where("n is not null").distinct()
    return rows.select("n", S.numeral(n, F.lit("upperRoman")).alias("roman"), S.numeral(n, F.lit("upperLetter")).alias("letters"))


@query("""SELECT p_partkey, CAST(greatest(1, round_even(p_retailprice * 100 / 9525, 0)) AS INTEGER) AS emu_px, CAST(greatest(1, round_even(p_size * 96.0 / 72, 0)) AS INTEGER) AS pt_px FROM part""")
def drawing_units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", S.emu_to_px(F.col("p_retailprice") * 100).alias("emu_px"), S.pt_to_px(F.col("p_size")).alias("pt_px"))


@query(r"""SELECT package_id, block_no, CAST(unnest(range(1, 1 + len(regexp_extract_all(txt, '\[([^\]]*)\]\(([^)\s]+)\)')))) AS INTEGER) AS link_no, unnest(regexp_extract_all(txt, '\[([^\]]*)\]\(([^)\s]+)\)', 2)) AS href, regexp_matches(unnest(regexp_extract_all(txt, '\[([^\]]*)\]\(([^)\s]+)\)', 2)), '^(?:https?://|data:|#|/)') AS absolute FROM web_blocks""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("txt", F.lit(r"\[([^\]]*)\]\(([^)\s]+)\)"), 2)
    rows = table(spark, folder, "web_blocks").select("package_id", "block_no", F.posexplode(links).alias("i", "href"))
    return rows.select("package_id", "block_no", (F.col("i") + 1).alias("link_no"), "href", S.absolute_reference(F.col("href")).alias("absolute"))


@query(r"""WITH l AS (SELECT DISTINCT package_id, regexp_replace(unnest(regexp_extract_all(txt, '\]\((/[^)\s]+)\)', 1)), '[?#].*$|/+$', '') AS target FROM web_blocks), k AS (SELECT regexp_extract(source_url, '^https?://[^/]+(/[^?#]*)', 1) AS target FROM web_blocks WHERE source_url IS NOT NULL UNION SELECT regexp_extract(source_url, '^https?://[^/]+(/[^/?#]+)', 1) FROM web_blocks WHERE source_url IS NOT NULL)
SELECT DISTINCT package_id, target FROM l WHERE target <> '' AND target NOT IN (SELECT target FROM k)""")
def broken_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links within the site to no known page, by its whole path or the part of it that names the page."""
    pages = table(spark, folder, "web_blocks")
    targets = pages.select("package_id", F.explode(F.regexp_extract_all("txt", F.lit(r"\]\((/[^)\s]+)\)"), 1)).alias("href")).select("package_id", F.regexp_replace("href", r"[?#].*$|/+$", "").alias("target")).where("target <> ''").distinct()
    paths = F.array(F.regexp_extract("source_url", r"^https?://[^/]+(/[^?#]*)", 1), F.regexp_extract("source_url", r"^https?://[^/]+(/[^/?#]+)", 1))
    known = pages.where("source_url is not null").select(F.explode(paths).alias("target")).distinct()
    return targets.join(known, "target", "left_anti").select("package_id", "target")
