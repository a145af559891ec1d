"""Lines, headings, sections and retrieval chunks of Markdown texts.

All of it happens within a row, by array expressions: a document never leaves its partition, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.scalars import clean_heading, strip

MAX_CHARACTERS, OVERLAP = 1600, 150
LINE_BREAK = r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\u0085\u2028\u2029]"
#: Where a heading line begins; its marks and its words.
HEADING_START = r"(?U)(?<![^\n])(?=#{1,6}[\s&&[^\n]]+[^\n])"
HEADING = r"(?U)^(#{1,6})[\s&&[^\n]]+([^\n]+)"


def unix_lines(text: Column) -> Column:
    """All line and paragraph separators as line feeds; none left at the end."""
    return F.regexp_replace(F.regexp_replace(text, LINE_BREAK, "\n"), r"\n\z", "")


def lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``line_no`` (from 1) and ``line`` of each text; an empty or null one has none."""
    own = F.split(unix_lines(F.col(text)), "\n")
    return df.where(F.length(text) > 0).select(*keep, F.posexplode(own).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def paragraphs(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Runs of lines that are not blank: ``paragraph_no, n_lines, paragraph``, each line stripped."""
    own = F.split(unix_lines(F.col(text)), "\n")
    runs = F.split(F.array_join(F.transform(own, strip), "\n"), r"\n{2,}")
    full = F.filter(F.transform(runs, lambda r: F.regexp_replace(r, r"^\n+|\n+$", "")), lambda r: r != "")
    return df.select(*keep, F.posexplode(full).alias("at", "paragraph")).select(*keep, (F.col("at") + 1).alias("paragraph_no"), F.size(F.split("paragraph", "\n")).alias("n_lines"), "paragraph")


def sections(text: Column) -> Column:
    """Array of (path, text) of the sections: a heading starts one and stands in it. A path holds the titles of the
    headings above; a heading of level L takes the place of all from L on, skipped levels leave no entry."""
    parts = F.split(unix_lines(text), HEADING_START)
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<path:array<string>,text:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        level = F.length(F.regexp_extract(part, HEADING, 1))
        title = strip(F.regexp_extract(part, HEADING, 2))
        padded = F.concat(acc["stack"], F.array_repeat(F.lit(""), level))
        stack = F.when(level > 0, F.concat(F.slice(padded, F.lit(1), level - 1), F.array(title))).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(F.filter(stack, lambda t: t != "").alias("path"), part.alias("text")))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def pack(section: Column, most: int, overlap: int) -> Column:
    """Chunks of one section: whole if it fits; else its paragraphs packed, each pack after the first led by the end of
    the one before; a paragraph too long that begins a pack is cut into windows. A pack with such a lead may exceed
    the size."""
    text = strip(section)
    short = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: p != "")
    step_size = most - overlap

    def windows(p: Column) -> Column:
        more = F.when(F.length(p) <= most, 0).otherwise(F.ceil((F.length(p) - most) / step_size)).cast("int")
        return F.filter(F.transform(F.sequence(F.lit(0), more), lambda i: strip(F.substring(p, i * step_size + 1, F.lit(most)))), lambda x: x != "")

    def fold(acc: Column, p: Column) -> Column:
        buffer = acc["buffer"]
        joined = F.when(buffer == "", p).otherwise(F.concat(buffer, F.lit("\n\n"), p))
        led = strip(F.concat(F.substring(buffer, F.greatest(F.lit(1), F.length(buffer) - overlap + 1), F.lit(overlap)), F.lit("\n\n"), p)) if overlap else p
        fits = F.length(joined) <= most
        return F.struct(
            F.when(fits, joined).when(buffer != "", led).otherwise("").alias("buffer"),
            F.when(fits, acc["out"]).when(buffer != "", F.concat(acc["out"], F.array(buffer))).otherwise(F.concat(acc["out"], windows(p))).alias("out"),
        )

    start = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))
    packed = F.aggregate(short, start, fold, lambda acc: F.when(acc["buffer"] != "", F.concat(acc["out"], F.array(acc["buffer"]))).otherwise(acc["out"]))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= most, F.array(text)).otherwise(packed)


def limits(most: int, overlap: int) -> tuple[int, int]:
    most = max(300, most)
    return most, max(0, min(overlap, most // 3))


def pieces(text: Column, most: int = MAX_CHARACTERS, overlap: int = OVERLAP) -> Column:
    """Array of (path, content) of a text's chunks, in their order."""
    most, overlap = limits(most, overlap)
    return F.flatten(F.transform(sections(text), lambda s: F.transform(pack(s["text"], most, overlap), lambda c: F.struct(s["path"].alias("path"), c.alias("content")))))


def embedding_text(piece: Column) -> Column:
    """The content of a chunk with its path before it."""
    path = F.array_join(piece["path"], " > ")
    return F.when(path != "", F.concat(path, F.lit("\n\n"), piece["content"])).otherwise(piece["content"])


def chunk(df: DataFrame, text: str, keep: list[str], most: int = MAX_CHARACTERS, overlap: int = OVERLAP, with_path: bool = True) -> DataFrame:
    """Retrieval chunks: ``chunk_id`` (from 1 in each document), ``heading_path, content, embedding_text``. A null or
    blank text has none. The size is 300 at least, the overlap a third of it at most."""
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(pieces(F.col(text), most, overlap)).alias("at", "chunk"))
    embedded = embedding_text(F.col("chunk")) if with_path else F.col("chunk.content")
    return rows.select(*keep, (F.col("at") + 1).alias("chunk_id"), F.col("chunk.path").alias("heading_path"), F.col("chunk.content").alias("content"), embedded.alias("embedding_text"))


def outline(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Headings as the text has them: ``line_no, level, title, confidence``, with up to three blanks before the marks, the
    title cleaned."""
    pattern = r"^\s{0,3}(#{1,6})\s+(.+?)\s*$"
    found = lines(df, text, keep).where(F.col("line").rlike(pattern))
    return found.select(*keep, "line_no", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), clean_heading(F.regexp_extract("line", pattern, 2)).alias("title"), F.lit(0.8).alias("confidence"))


def fences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Code blocks between lines of three backticks: ``fence_no, language, code``; one left open ends with the text."""
    own = F.split(unix_lines(F.col(text)), "\n")
    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("language"), F.array().cast("array<string>").alias("code"), F.array().cast("array<struct<language:string,code:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        mark = strip(line).startswith("```")
        done = F.concat(acc["out"], F.array(F.struct(acc["language"].alias("language"), F.array_join(acc["code"], "\n").alias("code"))))
        empty = F.array().cast("array<string>")
        return F.struct(
            F.when(mark, ~acc["open"]).otherwise(acc["open"]).alias("open"),
            F.when(mark & ~acc["open"], strip(F.substring(strip(line), 4, 1000))).otherwise(acc["language"]).alias("language"),
            F.when(mark, empty).when(acc["open"], F.concat(acc["code"], F.array(line))).otherwise(empty).alias("code"),
            F.when(mark & acc["open"], done).otherwise(acc["out"]).alias("out"),
        )

    closed = lambda acc: F.when(acc["open"], F.concat(acc["out"], F.array(F.struct(acc["language"].alias("language"), F.array_join(acc["code"], "\n").alias("code"))))).otherwise(acc["out"])
    rows = df.where(F.col(text).contains("```")).select(*keep, F.posexplode(F.aggregate(own, start, step, closed)).alias("at", "fence"))
    return rows.select(*keep, (F.col("at") + 1).alias("fence_no"), "fence.language", "fence.code")
