"""Main content of web pages, by a site style tree.

Pages of one host are merged into a tree, and all hosts into one above them. A branch of a page is a block; its
presentation says how it is built: its kind, whether it consists of entries (menus, trails, lists of links) or of
sentences, and links, which are presentation, since their text belongs to the page they lead to. Its leaves are its
entries or sentences, without the site's name, numbers (but in headings, tables and code) and, in sentences, other names.

The content importance of a leaf is one less the entropy of its spread over the pages: 0 if every page has it, 1 if one
has. The presentation importance of a sentence is the entropy of the blocks it stands in, as their effective number by
page: near 1 for a sentence met within ever other text, near 0 for one that always stands in the same block. A leaf keeps
its importance by either; a block has the mean importance of its leaves, and blocks of low importance are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.text import WORD, arrow, rows_of
from papyrion.runtime import partitions_for, session_of, store

LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
MARKER = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+", re.M)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
SENTENCE = re.compile(r"[.!?。！？…](?:\s|$)|[。！？]")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
COPYRIGHT = re.compile(r"(?:©|\bCopyright)\s*(?:©\s*)?(?:\d{4}\s+)?([^\W\d_]\w+)")
#: Marks that part the entries of menus and trails.
PARTS = re.compile(r"\s*(?:[>»›/|·•→]|::)\s*")
#: Kinds whose text is taken whole, and kinds that menus, notices and page ends do not use.
WHOLE, ALWAYS_MAIN = ("table", "code_block"), ("blockquote",)
#: What a link leaves behind.
MASK = "[]"
#: Blocks of less importance are no main content.
THRESHOLD = 0.7
#: A sentence is a template if it keeps so many words, and this share of all, when names and numbers are masked.
LITERALS, LITERAL_SHARE = 2, 0.5


def site_of(url: str | None) -> tuple[str, str]:
    """Host and the site's name in it: the label before the last."""
    m = re.match(r"^[a-z][a-z0-9+.-]*://([^/?#]+)", url or "", re.I)
    host = m.group(1).rsplit("@", 1)[-1].split(":")[0].lower() if m else ""
    labels = host.split(".")
    return host, (labels[-2] if len(labels) > 1 else host)


def site_in(texts: list[tuple[str | None, str | None]]) -> str:
    """The site's name on a page without address: who claims its copyright, or a heading of one word at its start."""
    for _, t in reversed(texts[-4:]):
        if m := COPYRIGHT.search(t or ""):
            return m.group(1).lower()
    for kind, t in texts[:4]:
        if kind == "heading" and t and WORD.fullmatch(t.strip()):
            return t.strip().lower()
    return ""


def masked(text: str, site: str, names: bool, numbers: bool = True) -> list[str]:
    """Words and marks in lower case: ``§`` for the site's name, with ``numbers`` ``0`` for what has a digit, and with
    ``names`` ``~`` for a word with a capital that doesn't begin the text."""
    out = []
    for i, t in enumerate(TOKEN.findall(text)):
        low = t.lower()
        out.append("§" if site and low == site else "0" if numbers and any(map(str.isdigit, t)) else "~" if names and i and t != low else low)
    return out


def leaves(kind: str | None, text: str | None, site: str) -> list[tuple[str, bool]]:
    """The leaves of a block, and which of them are sentences made of a template; ``MASK`` for a link alone."""
    if kind in WHOLE:
        return [(" ".join([kind or "", *masked(text or "", site, False, False)]), False)]
    out: list[tuple[str, bool]] = []
    for line in LINK.sub(f" {MASK} ", MARKER.sub("", text or "")).split("\n"):
        if not line.strip():
            continue
        prose = SENTENCE.search(line) is not None
        parts = [p for p in (SENTENCE_END if prose else PARTS).split(line) if p.strip()]
        for part in parts:
            if part.strip() == MASK:
                out.append((MASK, False))
                continue
            if kind != "heading" and (prose or len(parts) == 1):
                words = masked(part, site, True)
                literal = sum(map(str.isalpha, words))
                if literal >= LITERALS and literal >= LITERAL_SHARE * sum(w.isalnum() or w in "~§" for w in words):
                    out.append((" ".join(words), True))
                    continue
            # a heading's number tells it from others
            out.append((" ".join(masked(part, site, False, kind != "heading")), False))
    return out


def key_of(*parts: str) -> int:
    """A signed 64-bit key."""
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


PAGE = "package_id long, url string, blocks array<struct<block_no:int,kind:string,txt:string>>"


def pages(df: DataFrame, page: str, block: str, url: str, kind: str, text: str, late: str) -> DataFrame:
    """A row per page: its blocks in order. Repeated rows count once, before anything is gathered; of different rows
    with one key the last stored counts. Rows without page or block number are left out."""
    row = F.struct(F.col(f"`{late}`").alias("late"), F.col(f"`{url}`").alias("url"), F.col(f"`{kind}`").alias("kind"), F.col(f"`{text}`").alias("txt"))
    one = df.select(F.col(f"`{page}`").cast("long").alias("package_id"), F.col(f"`{block}`").cast("int").alias("block_no"), row.alias("row")).where("package_id is not null and block_no is not null")
    # repeated rows shrink before they travel; the pages then lie in as many parts as there are tasks, not in a few
    one = one.groupBy("package_id", "block_no").agg(F.max("row").alias("row")).repartition(2 * partitions_for(session_of(df)), "package_id")
    return one.groupBy("package_id").agg(F.max("row.url").alias("url"), F.array_sort(F.collect_list(F.struct("block_no", F.col("row.kind").alias("kind"), F.col("row.txt").alias("txt")))).alias("blocks"))


LEAVES = "package_id long, block_no int, host long, leaf long, context long, fixed double"


def tree_leaves(site_pages: DataFrame) -> DataFrame:
    """The leaves of all blocks, see ``LEAVES``: ``leaf`` the key of its content, ``context`` that of the block if it is
    a template sentence; ``host`` null for a page without readable address. ``fixed`` is the importance of what needs no
    count: links have no content of their own, nor has an entry that repeats a heading of its page; empty blocks have
    none; some kinds are main content as such."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, url, blocks in rows_of(batch):
                host, site = site_of(url)
                site = site or site_in([(b["kind"], b["txt"]) for b in blocks])
                home = key_of(host) if host else None
                own = [(b, leaves(b["kind"], b["txt"], site)) for b in blocks]
                heads = {" ".join(masked(b["txt"] or "", site, False)) for b in blocks if b["kind"] == "heading"}
                for b, found in own:
                    at = (page, b["block_no"], home)
                    if b["kind"] in ALWAYS_MAIN or not found:
                        out.append((*at, None, None, float(b["kind"] in ALWAYS_MAIN)))
                        continue
                    context = key_of(*[leaf for leaf, _ in found])
                    for leaf, template in found:
                        if leaf == MASK or (b["kind"] != "heading" and leaf in heads):
                            out.append((*at, None, None, 0.0))
                        else:
                            out.append((*at, key_of("template" if template else "entry", leaf), context if template else None, None))
            p, n, h, k, c, f = zip(*out, strict=True) if out else ((),) * 6
            yield arrow({"package_id": (p, pa.int64()), "block_no": (n, pa.int32()), "host": (h, pa.int64()), "leaf": (k, pa.int64()), "context": (c, pa.int64()), "fixed": (f, pa.float64())})

    return site_pages.mapInArrow(read, LEAVES)


def _content(n: Column, pages_n: Column) -> Column:
    """One less the entropy of a leaf that stands on n of so many pages, alike on each: 1 - log n / log pages."""
    return F.when((pages_n > 1) & (n > 1), 1 - F.log(n) / F.log(pages_n)).otherwise(1.0)


def importances(found: DataFrame, hosts: DataFrame, total: int) -> DataFrame:
    """``leaf, host, importance`` of the leaves that stand on several pages; those of one page have importance 1.
    Counts are exact and combined before every shuffle, so that a leaf of a third of all pages is a few rows."""
    each = found.where("leaf is not null").groupBy("package_id", "host", "leaf").agg(F.min("context").alias("context"))
    met = each.groupBy("leaf", "host", "context").agg(F.count(F.lit(1)).alias("n"))
    blocks = met.groupBy("leaf", "context").agg(F.sum("n").alias("n"))
    spread = F.when(F.max("context").isNull(), 0.0).otherwise(F.exp(-F.sum(F.col("n") * F.log("n")) / F.sum("n")))
    everywhere = blocks.groupBy("leaf").agg(F.sum("n").alias("n_all"), spread.alias("presentation")).where("n_all > 1")
    here = met.groupBy("leaf", "host").agg(F.sum("n").alias("n_here"))
    rows = here.join(everywhere, "leaf").join(hosts, "host", "left")
    on_host = F.when(F.col("host").isNull(), 1.0).otherwise(_content(F.col("n_here"), F.coalesce("pages", F.lit(0))))
    content = F.least(on_host, _content(F.col("n_all"), F.lit(total)))
    return rows.select("leaf", "host", (1 - (1 - content) * (1 - F.least(F.lit(1.0), "presentation"))).alias("importance"))


def judge(site_pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``package_id, block_no, importance, main`` of each block. ``site_pages`` as ``pages`` gives them; each page is read
    once, and only keys and counts travel.

    Every block gets a row: a null or empty text has importance 0, a null kind is a kind of its own, a page without a
    readable address belongs to no host and is judged by the tree of all hosts. Importance at the threshold is main. A
    page is a unit of work, with all its blocks in one row; an empty table gives no rows.
    """
    found = store(tree_leaves(site_pages), "leaves")
    hosts = found.where("host is not null").groupBy("host").agg(F.count_distinct("package_id").alias("pages"))
    total = found.select("package_id").distinct().count()
    known = importances(found, hosts, total).select(F.col("leaf").alias("known"), F.col("host").alias("at"), "importance")
    rows = found.join(known, (F.col("leaf") == F.col("known")) & F.col("host").eqNullSafe(F.col("at")), "left")
    value = F.coalesce("fixed", "importance", F.lit(1.0))
    return rows.groupBy("package_id", "block_no").agg(F.avg(value).alias("importance")).withColumn("main", F.col("importance") >= threshold)


def main_text(site_pages: DataFrame, judged: DataFrame) -> DataFrame:
    """``package_id, n_blocks, main_text`` of each page that has main content."""
    kept = judged.where("main").groupBy("package_id").agg(F.collect_set("block_no").alias("kept"))
    texts = F.transform(F.filter("blocks", lambda b: F.array_contains("kept", b["block_no"])), lambda b: F.coalesce(b["txt"], F.lit("")))
    return site_pages.join(kept, "package_id").select("package_id", F.size("kept").alias("n_blocks"), F.array_join(texts, "\n\n").alias("main_text"))
