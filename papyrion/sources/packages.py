"""Packages and corpora on disk: manifests and their outputs in, chunk corpora out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions.scalars import document_id
from papyrion.operators import chunks, relations

MANIFEST = "schema_version string, source struct<sha256:string,original_path:string>, outputs map<string,string>, warnings array<string>, rag_ready boolean"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """``package_dir`` and the manifest's fields of all packages below a folder; an unreadable manifest has null fields."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").text(folder, wholetext=True)
    rows = files.select(F.regexp_replace(F.col("_metadata.file_path"), "/manifest\\.json$", "").alias("package_dir"), F.from_json("value", MANIFEST).alias("m"))
    return rows.select("package_dir", "m.*")


def outputs(spark: SparkSession, folder: str, packages: DataFrame, key: str, legacy: str) -> DataFrame:
    """``package_dir, path`` of one output of each package: as the manifest names it, else by a name of old, if the file
    is there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    named = packages.select("package_dir", F.coalesce(F.col("outputs")[key], F.lit("")).alias("name"))
    first = named.join(files, (F.col("package_dir") == F.col("dir")) & (named["name"] == files["name"])).select("package_dir", "path")
    old = packages.select("package_dir").join(first, "package_dir", "left_anti").join(files, (F.col("package_dir") == F.col("dir")) & files["name"].rlike(legacy)).groupBy("package_dir").agg(F.min("path").alias("path"))
    return first.unionByName(old)


def write_corpus(docs: DataFrame, text: str, package: str, sha256: str, target: str, mode: str = "overwrite") -> None:
    """A chunk corpus below ``target``: ``index`` (a row per document with chunks), ``chunks`` and ``summary``, as JSON
    lines. An existing corpus is replaced, or refused with ``mode='errorifexists'``."""
    named = docs.withColumn("document_id", document_id(F.col(sha256), F.col(package)))
    rows = chunks.chunk(named, text, ["document_id", package])
    rows.write.mode(mode).json(f"{target}/chunks")
    written = docs.sparkSession.read.schema(rows.schema).json(f"{target}/chunks")
    index = relations.corpus_index(named.select("document_id", package).distinct(), written.select(package), package)
    index.write.mode(mode).json(f"{target}/index")
    index.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).withColumn("schema_version", F.lit("0.4")).write.mode(mode).json(f"{target}/summary")


def write_keyed_state(state: DataFrame, changes: DataFrame, key: list[str], version: list[str], target: str) -> DataFrame:
    """Writes the state after changes as a new folder beside the old one, so that a failure leaves the old one whole."""
    relations.upsert(state, changes, key, version).write.mode("errorifexists").parquet(target)
    return state.sparkSession.read.parquet(target)


def replaced(spark: SparkSession, target: str, build: Callable[[str], None], carry: Callable[[str, str], None] | None = None) -> None:
    """Builds ``target`` anew beside the old one and puts it in its place only when all went well. ``carry`` takes over from
    the old folder to the new one what has to live on, before the exchange; an error in either leaves the old one as it
    was. Folders may lie on any file system the session knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    old, new, aside = path(target), path(f"{target}.new"), path(f"{target}.old")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(new, True)
    try:
        build(f"{target}.new")
        if carry is not None and fs.exists(old):
            carry(target, f"{target}.new")
    except BaseException:
        fs.delete(new, True)
        raise
    fs.delete(aside, True)
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{target} can't be put aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{target} can't be replaced")
    fs.delete(aside, True)


def written_manifests(spark: SparkSession, target: str) -> DataFrame:
    """``package`` and the manifest's fields of packages that ``publishing.write_packages`` wrote below ``target``."""
    rows = spark.read.text(target, wholetext=True).where("file = 'manifest.json'")
    return rows.select("package", F.from_json("value", MANIFEST).alias("m")).select("package", "m.*")


def bundled_files(spark: SparkSession, target: str) -> DataFrame:
    """``key, package_dir, file, content``: the files of packages that ``publishing.write_bundles`` wrote below ``target``."""
    return spark.read.schema("key string, package_dir string, content string, file string").parquet(target).select("key", "package_dir", "file", "content")


def bundled_manifests(spark: SparkSession, target: str) -> DataFrame:
    """``key, package_dir`` and the manifest's fields of packages that ``publishing.write_bundles`` wrote below ``target``."""
    rows = bundled_files(spark, target).where("file = 'manifest.json'")
    return rows.select("key", "package_dir", F.from_json("content", MANIFEST).alias("m")).select("key", "package_dir", "m.*")
