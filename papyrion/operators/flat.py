"""Flat documents: blocks as rows, tables as text, issue filters. Catalyst expressions only."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.functions.scalars import escape_html, escape_markdown, strip
from papyrion.operators.flatten import read_record


#: Rows of a table that is written as one text.
MOST_ROWS = 10_000


def markdown(kind: Column, level: Column, text: Column, src: Column) -> Column:
    """One block without children as Markdown; an unknown kind as nothing."""
    words = F.coalesce(text, F.lit(""))
    safe = strip(escape_markdown(words))
    marks = F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1)))).cast("int"))
    image = F.when(F.coalesce(src, F.lit("")) != "", F.concat(F.lit("!["), words, F.lit("]("), src, F.lit(")"))).otherwise("")
    return (
        F.when(kind == "heading", F.concat(marks, F.lit(" "), safe))
        .when(kind == "paragraph", safe)
        .when(kind == "code_block", F.concat(F.lit("```\n"), words, F.lit("\n```")))
        .when(kind == "blockquote", F.concat(F.lit("> "), F.replace(words, F.lit("\n"), F.lit("\n> "))))
        .when(kind == "image", image)
        .when(kind.isin("list", "table"), words)
        .when(kind == "rule", "---")
        .otherwise("")
    )


def html(kind: Column, level: Column, text: Column, src: Column | None = None) -> Column:
    """One block without children as HTML; lists and tables from their lines, an image with its address."""
    words = escape_html(F.coalesce(text, F.lit("")))
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1)))).cast("int").cast("string")
    lines = F.filter(F.split(words, "\n"), lambda x: F.trim(x) != "")
    items = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), F.trim(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s+", "")), F.lit("</li>"))), "")
    tag = F.when(words.rlike(r"^\s*\d+[.)]\s"), "ol").otherwise("ul")
    cells = lambda x: F.array_join(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.concat(F.lit("<td>"), F.trim(c), F.lit("</td>"))), "")
    rows = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<tr>"), cells(x), F.lit("</tr>"))), "")
    address = F.coalesce(src, F.lit("")) if src is not None else F.lit("")
    image = F.when(address != "", F.concat(F.lit('<img src="'), escape_html(address, quote=True), F.lit('" alt="'), escape_html(F.coalesce(text, F.lit("")), quote=True), F.lit('"/>'))).otherwise("")
    return (
        F.when(kind == "heading", F.concat(F.lit("<h"), n, F.lit(">"), words, F.lit("</h"), n, F.lit(">")))
        .when(kind == "paragraph", F.concat(F.lit("<p>"), words, F.lit("</p>")))
        .when(kind == "code_block", F.concat(F.lit("<pre><code>"), words, F.lit("</code></pre>")))
        .when(kind == "blockquote", F.concat(F.lit("<blockquote><p>"), words, F.lit("</p></blockquote>")))
        .when(kind == "list", F.concat(F.lit("<"), tag, F.lit(">"), items, F.lit("</"), tag, F.lit(">")))
        .when(kind == "table", F.concat(F.lit("<table>"), rows, F.lit("</table>")))
        .when(kind == "image", image)
        .when(kind == "rule", "<hr/>")
        .otherwise("")
    )


def documents(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """Markdown of each document from its blocks in order: ``key, n_blocks, markdown`` (null without any text)."""
    rows = blocks.select(key, order, "kind", "heading_level", "txt", "src").distinct()
    rows = rows.select(key, F.struct(order, markdown(F.col("kind"), F.col("heading_level"), F.col("txt"), F.col("src")).alias("md")).alias("b"))
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("b.md") != "", F.col("b")))).alias("bs"))
    return own.select(key, F.size("bs").cast("long").alias("n_blocks"), F.when(F.size("bs") > 0, F.array_join("bs.md", "\n\n")).alias("markdown"))


def _rows(text: Column) -> Column:
    full = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct((i + 1).alias("row_no"), F.trim(line).alias("line"))), lambda r: r["line"] != "")
    return F.transform(full, lambda r: F.struct(r["row_no"].alias("row_no"), F.split(F.regexp_replace(r["line"], r"^\||\|$", ""), r"\|").alias("cells")))


def table_shape(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    rows = _rows(F.col(text))
    return df.select(*keep, rows.alias("rows")).select(*keep, F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))).alias("n_columns")).where("n_rows > 0")


def table_cells(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``row_no, column_no, cell`` of a pipe table; every cell is text."""
    rows = df.select(*keep, F.explode(_rows(F.col(text))).alias("row"))
    return rows.select(*keep, F.col("row.row_no").alias("row_no"), F.posexplode("row.cells").alias("i", "cell")).select(*keep, "row_no", (F.col("i") + 1).alias("column_no"), F.trim("cell").alias("cell"))


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A whole small table as one Markdown table, its first line the column names. One text holds it, so a table of more
    than ``MOST_ROWS`` rows is refused."""
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows in one table")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("line")))).alias("rows"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"
    return rows.select(F.concat_ws("\n", F.lit(head), F.array_join("rows.line", "\n")).alias("markdown"))


def issue_filter(df: DataFrame, equal: dict[str, str], searched: list[str], words: str | None) -> DataFrame:
    """Rows with the given values, and the words in one of the searched columns, in any case."""
    out = df
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    if words:
        hit = F.lit(False)
        for name in searched:
            hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(words.lower()), F.lit(False))
        out = out.where(hit)
    return out


def page_of(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first page of an order; between 1 and 100 rows. The order has to be total for pages to be stable."""
    return df.orderBy(*order).limit(max(1, min(100, size)))


def page_token(page: DataFrame, order: list[str]) -> list | None:
    """Where the next page begins: the last row's values of the order, None after an empty page."""
    last = page.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    return None if last is None else [last[c] for c in order]


def page_after(df: DataFrame, order: list[str], token: list | None, size: int) -> DataFrame:
    """The page of an ascending order that follows the token; no row before it is counted again."""
    rest = df if token is None else df.where(F.struct(*order) > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, token, strict=True)]))
    return page_of(rest, [F.col(c) for c in order], size)


def useful_fields(df: DataFrame, key: str, payload: str, dropped: tuple[str, ...] = ("description", "attachment", "comment"), names: dict[str, str] | None = None) -> DataFrame:
    """``key, field, name, value`` of a flat JSON object, without empty and unwanted fields; ``names`` gives the names that
    fields are shown under, their own otherwise."""
    fields = F.map_filter(F.from_json(F.col(payload), "map<string,string>"), lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}") & ~k.isin(*dropped))
    shown = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])
    return df.select(key, F.explode(fields).alias("field", "value")).select(key, "field", F.coalesce(shown[F.col("field")], "field").alias("name"), "value")


def unwrapped(df: DataFrame, key: str, payload: str, delivered: str) -> DataFrame:
    """The last delivered readable record of each key as plain JSON, out of its envelope and decoded once."""

    @F.pandas_udf(T.StringType())
    def plain(texts: pd.Series) -> pd.Series:
        records = texts.map(read_record)
        return records.map(lambda r: json.dumps(r, ensure_ascii=False) if r is not None else None)

    rows = df.where(F.col(payload).isNotNull()).select(key, F.col(delivered).alias("at"), plain(payload).alias("payload")).where("payload is not null")
    return rows.groupBy(key).agg(F.max_by("payload", F.struct("at", "payload")).alias("payload"))
