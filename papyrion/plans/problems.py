"""Queries of the core's training-data operators: nested records (p3) and hierarchies (p4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import flatten, hierarchy
from papyrion.runtime import table


def _records(spark: SparkSession, folder: str, wanted: tuple[str, ...], with_fields: bool) -> DataFrame:
    return flatten.explode_records(table(spark, folder, "canonical_json"), "package_id", "payload", "ingested_at", wanted=wanted, with_fields=with_fields)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("block", "asset", "occurrence"), with_fields=False)
    parent = F.when(F.col("entity") == "block", F.col("up")["block"]).when(F.col("entity") == "occurrence", F.col("up")["asset"])
    return rows.select(F.col("key").alias("package_id"), "entity", F.col("no").alias("node_no"), F.coalesce(parent, F.lit(0)).alias("parent_no"))


def p3_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("document",), with_fields=True)
    return rows.select(F.col("key").alias("package_id"), F.col("fields")["title"].alias("title"), F.col("fields")["metadata.title_source"].alias("title_source"), F.col("fields")["source.format"].alias("source_format"), F.col("fields")["source.type"].alias("source_type"), F.col("fields")["schema_version"].alias("schema_version"))


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("block",), with_fields=True)
    columns = {"kind": "type", "heading_level": "level", "txt": "text", "src": "src", "language": "language"}
    return rows.select(F.col("key").alias("package_id"), F.col("no").alias("block_no"), F.coalesce(F.col("up")["block"], F.lit(0)).alias("parent_block"), "parent_entity", "parent_no", "ordinal", *[F.col("fields")[f].alias(c) for c, f in columns.items()])


def p3_assets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("asset",), with_fields=True)
    return rows.select(F.col("key").alias("package_id"), F.col("no").alias("asset_no"), *[F.col("fields")[f].alias(f) for f in ("file", "role", "saved", "duplicate_of")])


def p3_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("occurrence",), with_fields=True)
    return rows.select(F.col("key").alias("package_id"), F.col("no").alias("occurrence_no"), F.col("up")["asset"].alias("asset_no"), F.col("fields")["role"].alias("role"), *[F.col("fields")[f"display.{f}"].cast("int").alias(f) for f in ("width_px", "height_px")])


def p3_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("item",), with_fields=False)
    return rows.select(F.col("key").alias("package_id"), F.col("no").alias("item_no"), F.col("parent_no").alias("block_no"), "ordinal")


def p3_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("row",), with_fields=False)
    return rows.select(F.col("key").alias("package_id"), F.col("no").alias("row_no"), F.col("parent_no").alias("block_no"), "ordinal")


def p3_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("cell",), with_fields=True)
    return rows.select(F.col("key").alias("package_id"), F.col("no").alias("cell_no"), F.col("parent_no").alias("row_no"), "ordinal", *[F.col("fields")[f].cast("int").alias(f) for f in ("rowspan", "colspan")], F.col("fields")["header"].alias("header"))


def p3_inlines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder, ("inlines",), with_fields=True)
    return rows.select(F.col("key").alias("package_id"), F.col("no").alias("inline_no"), F.col("parent_no").alias("block_no"), "ordinal", F.col("fields")["type"].alias("kind"), F.col("fields")["text"].alias("txt"))


def p3_schema(spark: SparkSession, folder: str) -> DataFrame:
    return flatten.merged_schema(table(spark, folder, "canonical_json"), "payload")


def _tree(spark: SparkSession, folder: str, paths: bool = True) -> DataFrame:
    return hierarchy.hierarchy(table(spark, folder, "page_tree"), "page_id", "parent_id", "version_no", paths)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, paths=False).select(F.col("node").alias("page_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.with_counts(_tree(spark, folder))
    return tree.select(F.col("node").alias("page_id"), F.array_join("path", "/").alias("path"), "n_descendants")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, folder)).select(F.col("ancestor").alias("ancestor_id"), F.col("node").alias("page_id"), "distance")


def p4_loops(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.loops(_tree(spark, folder, paths=False)).select(F.col("root").alias("root_id"), "nodes")


CLIMB = r"""
WITH RECURSIVE rows AS (
  SELECT page_id, CASE WHEN regexp_replace(trim(parent_id), '\.0+$', '') IN ('', '0') THEN NULL ELSE regexp_replace(trim(parent_id), '\.0+$', '') END AS parent, version_no FROM page_tree),
latest AS (SELECT page_id, arg_max({'p': parent}, version_no).p AS parent FROM rows GROUP BY page_id),
edges AS (SELECT a.page_id, b.page_id AS parent FROM latest a LEFT JOIN latest b ON a.parent = b.page_id),
up AS (
  SELECT page_id AS node, page_id AS at, [page_id] AS trail FROM edges
  UNION ALL
  SELECT node, e.parent, list_append(trail, e.parent) FROM up JOIN edges e ON e.page_id = up.at
  WHERE e.parent IS NOT NULL AND NOT list_contains(trail, e.parent)),
ends AS (SELECT node, trail, e.parent FROM up JOIN edges e ON e.page_id = up.at WHERE e.parent IS NULL OR list_contains(trail, e.parent)),
tree AS (
  SELECT node AS page_id,
    CASE WHEN parent IS NULL THEN trail[-1] ELSE CAST(list_min(list_transform(trail[list_position(trail, parent):], lambda x: CAST(x AS BIGINT))) AS VARCHAR) END AS root_id,
    CASE WHEN parent IS NULL THEN CAST(len(trail) - 1 AS INTEGER) ELSE -1 END AS depth,
    CASE WHEN parent IS NULL THEN list_reverse(trail) END AS path FROM ends)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_documents, p3_blocks, p3_assets, p3_occurrences, p3_items, p3_rows, p3_cells, p3_inlines, p3_schema, p4_found, p4_paths, p4_descendants, p4_loops)
}

ORACLE = {
    "p4_found": CLIMB + "SELECT page_id, root_id, depth FROM tree",
    "p4_loops": CLIMB + "SELECT root_id, count(*) AS nodes FROM tree WHERE depth < 0 GROUP BY root_id",
    "p4_descendants": CLIMB + "SELECT unnest(path) AS ancestor_id, page_id, depth + 1 - unnest(range(1, len(path) + 1)) AS distance FROM tree WHERE path IS NOT NULL",
    "p4_paths": CLIMB + """, n AS (SELECT a AS page_id, count(*) - 1 AS n FROM (SELECT unnest(path) AS a FROM tree) GROUP BY a)
SELECT t.page_id, array_to_string(t.path, '/') AS path, n.n AS n_descendants FROM tree t LEFT JOIN n USING (page_id)""",
}
