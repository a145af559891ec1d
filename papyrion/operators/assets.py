"""Images and other assets of documents: which saved file a reference means, which are the same, and what becomes of
the references. Assets meet by content hash or name, never by comparing bytes pairwise."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.scalars import absolute_reference, numbered
from papyrion.operators.relations import unique_lookup

IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"


def references(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``ref_no, alt, target`` of the images a Markdown text shows, in order."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(IMAGE), 1).alias("alt"), F.regexp_extract_all(text, F.lit(IMAGE), 2).alias("target"))
    rows = df.select(*keep, F.posexplode(found).alias("i", "ref"))
    return rows.select(*keep, (F.col("i") + 1).alias("ref_no"), F.col("ref.alt").alias("alt"), F.col("ref.target").alias("target"))


def broken(refs: DataFrame, files: DataFrame, keep: list[str]) -> DataFrame:
    """Local references without a file: ``keep, target`` of refs against ``keep, file``."""
    local = refs.where(~absolute_reference(F.col("target"))).select(*keep, "target").distinct()
    return local.join(files.select(*keep, F.col("file").alias("target")).distinct(), [*keep, "target"], "left_anti")


def resolved(refs: DataFrame, assets: DataFrame, doc: str) -> DataFrame:
    """Adds ``file`` to references: the asset of the same path, else of the same base name, else the one its number names
    (``image_7``), else the next one not yet named by position. Of assets with one name the last saved counts.
    Assets: ``doc, position, source_name, file``."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    by_path = assets.groupBy(doc, F.col("source_name").alias("target")).agg(F.max_by("file", "position").alias("by_path"))
    by_name = assets.groupBy(doc, base(F.col("source_name")).alias("name")).agg(F.max_by("file", "position").alias("by_name"))
    by_no = assets.select(doc, F.col("position").alias("no"), F.col("file").alias("by_no"))
    rows = refs.withColumn("name", base(F.col("target"))).withColumn("no", F.regexp_extract("target", r"image_?0*(\d+)\D*$", 1).try_cast("int"))
    rows = rows.join(by_path, [doc, "target"], "left").join(by_name, [doc, "name"], "left").join(by_no, [doc, "no"], "left")
    rows = rows.withColumn("named", F.coalesce("by_path", "by_name", "by_no"))
    turn = F.row_number().over(Window.partitionBy(doc, F.col("named").isNull()).orderBy("ref_no"))
    rows = rows.withColumn("turn", F.when(F.col("named").isNull(), turn))
    nth = assets.select(doc, F.row_number().over(Window.partitionBy(doc).orderBy("position")).alias("turn"), F.col("file").alias("by_turn"))
    return rows.join(nth, [doc, "turn"], "left").withColumn("file", F.coalesce("named", "by_turn")).drop("name", "no", "by_path", "by_name", "by_no", "named", "turn", "by_turn")


def by_content(members: DataFrame, saved: DataFrame, doc: str) -> DataFrame:
    """Adds ``file`` to archive members: the saved asset of the same hash (the first), null for those to recover."""
    first = saved.where("sha256 is not null").groupBy(doc, "sha256").agg(F.min("file").alias("file"))
    return members.join(first, [doc, "sha256"], "left")


def recovered(members: DataFrame, saved: DataFrame, refs: DataFrame, doc: str, prefix: str) -> DataFrame:
    """Members that a reference names and no saved asset equals, once per content, with new names ``prefix_001…``."""
    wanted = refs.select(doc, F.regexp_extract("target", r"([^/]*)$", 1).alias("name")).distinct()
    named = members.withColumn("name", F.regexp_extract("member", r"([^/]*)$", 1)).join(wanted, [doc, "name"], "left_semi")
    new = by_content(named, saved, doc).where("file is null").groupBy(doc, "sha256").agg(F.min("member").alias("member"))
    no = F.row_number().over(Window.partitionBy(doc).orderBy("member"))
    return new.select(doc, "sha256", "member", F.concat(F.lit(prefix + "_"), numbered(no), F.regexp_extract("member", r"(\.[^./]+)$", 1)).alias("file"))


def matched(payloads: DataFrame, assets: DataFrame, doc: str) -> DataFrame:
    """The asset of each payload by hash, else by its difference hash where only one asset has it."""
    exact = assets.groupBy(doc, "sha256").agg(F.min("file").alias("exact"))
    rows = payloads.join(exact, [doc, "sha256"], "left").withColumn("near_key", F.concat_ws("/", F.col(doc).cast("string"), "dhash"))
    near = assets.where("dhash is not null").select(F.concat_ws("/", F.col(doc).cast("string"), "dhash").alias("k"), F.col("file").alias("near"))
    return unique_lookup(rows, "near_key", near, "k", "near").withColumn("file", F.coalesce("exact", F.when(F.col("dhash").isNotNull(), F.col("near")))).drop("exact", "near", "near_key")


def roles(assets: DataFrame, doc: str) -> DataFrame:
    """Roles of each file, and whether it is page furniture in all of them."""
    own = assets.groupBy(doc, "file").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return own.withColumn("furniture", (F.size("roles") > 0) & (F.size(F.array_except("roles", F.array(F.lit("header"), F.lit("footer")))) == 0))


def without_images(text: Column, targets: Column) -> Column:
    """A Markdown text without the images whose targets are in the array; blank lines left behind are drawn together."""
    plain = F.aggregate(targets, text, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"!\[[^\]]*\]\(\Q"), t, F.lit(r"\E[^)]*\)")), F.lit("")))
    return F.regexp_replace(plain, r"\n{3,}", "\n\n")


def rewritten(text: Column, pairs: Column) -> Column:
    """A text in which each target of the array of (target, file) is replaced by its file, inside brackets only."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, F.concat(F.lit("]("), p["target"], F.lit(")")), F.concat(F.lit("]("), p["file"], F.lit(")"))))


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height in the head of a PNG, GIF, JPEG or BMP file."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:4] == b"GIF8" and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """``path, width, height`` of image files (``path, content``); null where the head can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(c or b"") or (None, None) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], ["path", "width", "height"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int")
