"""Scalar functions over columns. All but those marked as Arrow functions are Catalyst expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Titles that say nothing, page-width names, languages, signatures of image formats.
GENERIC_TITLES = ("untitled", "document", "document1", "document 1", "microsoft word", "microsoft word document", "powerpoint presentation", "presentation", "presentation1", "presentation 1", "adobe acrobat")
LANGUAGES = ("en", "fr", "de", "es", "zh")
IMAGE_TYPES = {"image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/bmp": ".bmp", "image/tiff": ".tiff"}
MAGIC = (("89504E470D0A1A0A", ".png"), ("FFD8FF", ".jpg"), ("47494638", ".gif"), ("424D", ".bmp"), ("49492A00", ".tiff"), ("4D4D002A", ".tiff"))
SUPPORTED = ("doc", "docx", "docm", "pdf", "ppt", "pptx", "pptm", "odp", "xls", "xlsx", "xlsm", "ods", "odt", "rtf", "txt", "csv", "html", "htm", "md", "markdown")
EMU_PER_PX, PX_PER_PT = 9525, 96 / 72


def strip(col: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def escape_markdown(col: Column) -> Column:
    return F.regexp_replace(col, r"([\\*_`\[\]])", r"\\$1")


def escape_html(col: Column, quote: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if quote:
        out = F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    return out


def safe_stem(col: Column) -> Column:
    """A file name of plain characters; ``document`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), r"[^A-Za-z0-9._ -]+", "_"), r"^[ ._]+|[ ._]+$", "")
    return F.when(bare == "", "document").otherwise(bare)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def numbered(no: Column) -> Column:
    """A number with three digits at least."""
    return F.when(no < 1000, F.lpad(no.cast("string"), 3, "0")).otherwise(no.cast("string"))


def stem(path: Column) -> Column:
    """The file name of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def supported(path: Column, wanted: list[str] | None = None) -> Column:
    """Whether a file's extension can be read, in any case; ``wanted`` narrows it and must name known ones only."""
    names = [w.lower().lstrip(".") for w in wanted] if wanted is not None else list(SUPPORTED)
    unknown = sorted(set(names) - set(SUPPORTED))
    if unknown:
        raise ValueError(f"unsupported extensions: {', '.join(unknown)}")
    return extension(path).isin(names)


def package_name(path: Column) -> Column:
    """Directory name of a document's package: its stem made safe, and its extension."""
    ext = extension(path)
    return F.concat(safe_stem(stem(path)), F.lit("__"), F.when(ext == "", "file").otherwise(ext))


def document_id(sha: Column, package: Column) -> Column:
    """The first 16 digits of the content's hash, else the package's name made safe."""
    return F.when(F.coalesce(sha, F.lit("")) != "", F.substring(sha, 1, 16)).otherwise(safe_stem(package))


def clean_title(col: Column) -> Column:
    """A title that says something, else null: no generic name, no file name of a word processor, 240 characters at most."""
    bare = squeeze(F.coalesce(col, F.lit("")))
    low = F.lower(bare)
    bad = (bare == "") | low.isin(*GENERIC_TITLES) | low.rlike(r"^microsoft word - .*\.docx?$") | (F.length(bare) > 240)
    return F.when(~bad, bare)


def first_title(*named: tuple[str, Column]) -> tuple[Column, Column]:
    """(title, where it is from): the first of the candidates that says something."""
    titles = [(name, clean_title(c)) for name, c in named]
    origin = F.coalesce(*[F.when(t.isNotNull(), F.lit(name)) for name, t in titles])
    return F.coalesce(*[t for _, t in titles]), origin


def normalize_domain(col: Column) -> Column:
    """Host of an address given with or without scheme, path or port, lower case."""
    bare = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(bare, r"^(?:[^/@]*@)?([^/:?#]*)", 1))


def absolute_reference(col: Column) -> Column:
    return col.rlike(r"^(?:https?://|data:|#|/)")


def with_prefix(src: Column, prefix: str) -> Column:
    """A relative reference below a prefix; absolute ones and empty ones stand."""
    return F.when((F.coalesce(src, F.lit("")) == "") | absolute_reference(src), src).otherwise(F.concat(F.lit(prefix), src))


def safe_link(href: Column) -> Column:
    """Null for schemes that run code."""
    return F.when(~F.lower(strip(F.split(href, ":")[0])).isin("javascript", "data", "vbscript"), href)


def hex_color(col: Column) -> Column:
    bare = F.upper(F.regexp_replace(strip(col), "^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), bare))


def style_map(css: Column) -> Column:
    """CSS declarations as a map with lower-case names; of one name given twice the last counts, empty ones fall away."""
    pairs = F.transform(F.split(css, ";"), lambda d: F.struct(F.lower(strip(F.split(d, ":", 2)[0])).alias("k"), strip(F.get(F.split(d, ":", 2), 1)).alias("v"), d.contains(":").alias("ok")))
    good = F.filter(pairs, lambda p: p["ok"] & (p["k"] != "") & (p["v"] != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def image_extension(name: Column, mime: Column, payload: Column) -> Column:
    """By the name's suffix, else the media type, else the first bytes, else ``.bin``."""
    by_name = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(\.(?:png|jpe?g|gif|webp|svg|bmp|tiff?))$", 1)
    by_type = F.coalesce(*[F.when(F.lower(mime) == k, F.lit(v)) for k, v in IMAGE_TYPES.items()])
    head = F.hex(F.substring(payload, 1, 12))
    by_bytes = F.coalesce(*[F.when(head.startswith(k), F.lit(v)) for k, v in MAGIC], F.when(head.startswith("52494646") & head.endswith("57454250"), F.lit(".webp")))
    return F.coalesce(F.when(by_name != "", by_name), by_type, by_bytes, F.lit(".bin"))


def data_bytes(col: Column) -> Column:
    """Bytes of base64 text, raw or in a data address."""
    return F.unbase64(F.substring_index(col, ",", -1))


def emu_to_px(col: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(col / EMU_PER_PX)).cast("int")


def pt_to_px(col: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(col * PX_PER_PT)).cast("int")


def display_size(width: Column, height: Column, least: int, most: int) -> Column:
    """Width and height in bounds, keeping the ratio: enlarged only if both are below ``least``, then held to ``most``.
    Null where a side is missing or not positive."""
    up = F.when((width < least) & (height < least), least / F.greatest(width, height)).otherwise(F.lit(1.0))
    w, h = width * up, height * up
    down = F.least(F.lit(1.0), most / F.greatest(w, h))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * down)).cast("int")
    return F.when((width > 0) & (height > 0), F.struct(side(w).alias("width"), side(h).alias("height")))


def language(col: Column) -> Column:
    """One of the known languages by code or prefix, else English."""
    prefix = F.split(F.lower(strip(F.coalesce(col, F.lit("")))), "[-_]")[0]
    return F.when(prefix.isin(*LANGUAGES), prefix).otherwise("en")


def git_provider(url: Column) -> Column:
    """``provider, host, path`` of a repository's address; without ``.git`` and slashes at the end."""
    host = normalize_domain(url)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([^?#]*)", 1), r"^/+|/+$", ""), r"\.git$", "")
    hub = (host == "github.com") | host.endswith(".github.com")
    short = F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")
    return F.struct(F.when(hub, "github").otherwise("gitlab").alias("provider"), host.alias("host"), F.when(hub, short).otherwise(path).alias("path"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(front matter or null, the text after it)."""
    pattern = r"(?s)^---\n(.*?)\n---[ \t]*(?:\n(.*))?$"
    has = text.rlike(pattern)
    return F.when(has, F.regexp_extract(text, pattern, 1)), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text)


def page_title_of(markdown: Column, path: Column) -> Column:
    """Title of a page to publish: the front matter's, the first heading, the file's name in words."""
    head, body = front_matter(markdown)
    own = F.regexp_extract(head, r'(?m)^title:\s*"?([^"\n]*)"?\s*$', 1)
    heading = F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1)
    name = F.initcap(squeeze(F.regexp_replace(stem(path), "[_-]+", " ")))
    return F.coalesce(*[clean_title(c) for c in (own, heading, name)], F.lit("document"))


# A number before a heading, a page after it, what is left at its ends.
LEADING_NUMBER = r"(?i)^\s*(?:\d+(?:\.\d+)*[.)]?|[IVXLCDM]+[.)])\s+"
TRAILING_PAGE = r"(?i)(?:\s*[.·•…]{2,}\s*|\s+)(?:\d+|[ivxlcdm]+)\s*$"
HEADING_ENDS = r"^[ .:\-–—\t]+|[ .:\-–—\t]+$"


def clean_heading(col: Column) -> Column:
    """A heading's words: no marks, links as their text, no number before, no page after."""
    out = strip(col)
    for pattern, instead in ((r"^#{1,6}\s+", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"[`*_~]", ""), (LEADING_NUMBER, ""), (TRAILING_PAGE, ""), (r"\s+", " "), (HEADING_ENDS, "")):
        out = F.regexp_replace(out, pattern, instead)
    return out


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Arrow function: without case and accents, plain quotes and dashes, single blanks."""

    def fold(t: str | None) -> str | None:
        if t is None:
            return None
        plain = t.casefold().replace("’", "'").replace("–", "-").replace("—", "-")
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c)).split())

    return texts.map(fold)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow function: the ratio of matching blocks of two texts (Ratcliff and Obershelp), null if one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def numeral(n: Column, form: Column) -> Column:
    """A number as decimal, upperRoman, lowerRoman, upperLetter or lowerLetter; others as decimal."""
    roman = F.lit("")
    rest = n
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        roman = F.concat(roman, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    # letters count without zero: a..z, aa..zz, aaa..; a long has at most 14. Each place starts at the first number that has it
    whole, letters = n.cast("long"), F.lit("")
    for place in range(14):
        start = (26 ** (place + 1) - 26) // 25 + 1
        at = F.call_function("div", whole - F.lit(start), F.lit(26**place)) % 26
        letters = F.concat(F.when(whole >= F.lit(start), F.chr(F.lit(65) + at.cast("int"))).otherwise(""), letters)
    return (
        F.when((form == "upperRoman") & (n > 0), roman)
        .when((form == "lowerRoman") & (n > 0), F.lower(roman))
        .when((form == "upperLetter") & (n > 0), letters)
        .when((form == "lowerLetter") & (n > 0), F.lower(letters))
        .otherwise(n.cast("string"))
    )


def cell_text(col: Column, kind: str) -> Column:
    """A cell as text: null as nothing, booleans in capitals."""
    return F.coalesce(F.upper(col.cast("string")) if kind == "boolean" else col.cast("string"), F.lit(""))


# Names of page widths and what the target calls them; nothing where the target's own width stays.
PAGE_WIDTHS = {
    "narrow": "default", "etroit": "default", "étroit": "default", "fixed": "default", "fixed-width": "default", "default": "default",
    "wide": "full-width", "large": "full-width", "full": "full-width", "full-width": "full-width",
    "max": "max", "maximum": "max", "confluence-default": "", "unset": "", "none": "",
}


def page_width(col: Column) -> Column:
    """The name of a page width in the target's terms, ``max`` for none given, empty where the target's own stays; an
    unknown one is an error."""
    low = F.lower(strip(F.coalesce(F.nullif(col, F.lit("")), F.lit("max"))))
    known = F.create_map(*[F.lit(x) for pair in PAGE_WIDTHS.items() for x in pair])[low]
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unsupported page width: "), col)))


def storage_to_html(col: Column) -> Column:
    """Wiki storage format to plain XHTML: contents macro to its mark, images to ``img``, other macros to their body."""
    out = F.regexp_replace(col, r'(?s)<ac:structured-macro[^>]*ac:name="toc"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<p>[[_TOC_]]</p>")
    out = F.regexp_replace(out, r'(?s)<ac:image[^>]*>\s*<ri:attachment[^>]*ri:filename="([^"]*)"[^>]*/>\s*</ac:image>', '<img src="attachments/$1"/>')
    out = F.regexp_replace(out, r'(?s)<ac:image[^>]*>\s*<ri:url[^>]*ri:value="([^"]*)"[^>]*/>\s*</ac:image>', '<img src="$1"/>')
    out = F.regexp_replace(F.regexp_replace(out, r"<ac:rich-text-body[^>]*>", "<div>"), r"</ac:rich-text-body>", "</div>")
    return F.regexp_replace(out, r"(?s)</?(?:ac|ri):[^>]*>", "")


# Section titles by language.
LABELS = {
    "comments": {"en": "Comments", "fr": "Commentaires", "de": "Kommentare", "es": "Comentarios", "zh": "评论"},
    "attachments": {"en": "Attachments", "fr": "Pièces jointes", "de": "Anhänge", "es": "Adjuntos", "zh": "附件"},
}
#: Suffixes that images from the web keep.
WEB_IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".tif", ".tiff")
#: Where a title may come from, most reliable first.
TITLE_SOURCES = ("core_properties", "document_visual_title", "pdf_metadata", "first_slide_title", "extractor_metadata", "document_heading", "filename")


def translated(key: Column, lang: Column, labels: dict[str, dict[str, str]] = LABELS) -> Column:
    """A label in a language, else in English, else its key."""
    flat = F.create_map(*[F.lit(x) for k, by in labels.items() for code, text in by.items() for x in (f"{k}/{code}", text)])
    own = language(lang)
    return F.coalesce(flat[F.concat_ws("/", key, own)], flat[F.concat(key, F.lit("/en"))], key)


def formula_display(cached: Column, formula: Column) -> Column:
    """What a formula's cell shows: its last value, or that there is none."""
    return F.coalesce(cached, F.concat(F.lit("[no value stored: "), formula, F.lit("]")))


def title_chain(**candidates: Column) -> tuple[Column, Column]:
    """(title, its source): the first candidate in the order of ``TITLE_SOURCES`` that says something; a file's name as it
    stands where none does."""
    given = [(n, candidates[n]) for n in TITLE_SOURCES if n in candidates and n != "filename"]
    title, origin = first_title(*given)
    return F.coalesce(title, candidates["filename"]), F.coalesce(origin, F.lit("filename"))


def web_asset_name(url: Column, no: Column, mime: Column) -> Column:
    """``web_001.png``: by the address's suffix, else the media type; others end in ``.bin``."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/(?:.*/)?[^/]*?(\.[^./]+)$", 1))
    kind = F.lower(strip(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    by_type = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in IMAGE_TYPES.items()], F.lit(".bin"))
    end = F.when(suffix == "", by_type).when(suffix.isin(*WEB_IMAGES), suffix).otherwise(".bin")
    return F.concat(F.lit("web_"), numbered(no), end)


@F.pandas_udf(T.StringType())
def joined_address(base: pd.Series, reference: pd.Series) -> pd.Series:
    """Arrow function: a reference as it is meant on a page, by RFC 3986; null if one is null or malformed."""
    from urllib.parse import urljoin

    def join(b: str | None, r: str | None) -> str | None:
        try:
            return urljoin(b, r) if b is not None and r is not None else None
        except ValueError:
            return None

    return pd.Series([join(b, r) for b, r in zip(base, reference, strict=True)], dtype="object")


def json_safe(**columns: Column) -> Column:
    """Columns as one JSON object; bytes by their length only."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def redacted(payload: Column) -> Column:
    """A payload in a record: how many bytes it has."""
    return F.concat(F.lit("<bytes:"), F.octet_length(payload).cast("string"), F.lit(">"))


def is_page(kind: Column) -> Column:
    """Whether a content type is a page's, which it is where none is given."""
    return F.lower(F.coalesce(kind, F.lit("page"))) == "page"


def marker_summary(counts: Column) -> Column:
    """``k=v, k=v`` of the counters above nought of a map, by name; empty without any."""
    some = F.array_sort(F.map_entries(F.map_filter(counts, lambda k, v: v > 0)))
    return F.array_join(F.transform(some, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def fidelity(counts: Column) -> Column:
    """``partial`` if anything was counted that can't be shown as text, else ``full``."""
    return F.when(F.exists(F.map_values(counts), lambda v: v > 0), "partial").otherwise("full")


def width_properties(width: Column) -> Column:
    """The properties that set a page's width, as JSON, for ``page_width``'s names; none where the target's own stays."""
    names = ("content-appearance-published", "content-appearance-draft")
    return F.when(width == "", "{}").otherwise(F.to_json(F.struct(*[width.alias(n) for n in names])))


def checkbox_signs(markup: Column) -> Column:
    """HTML with a sign for each check box, crossed where it is checked."""
    box = r'<input\b(?=[^>]*\btype="checkbox")'
    return F.regexp_replace(F.regexp_replace(markup, box + r"(?=[^>]*\bchecked\b)[^>]*>", "☒"), box + r"[^>]*>", "☐")


def error_text(error: BaseException) -> str:
    """An error in one line: what it says, or its kind where it says nothing, and what caused it."""
    said = " ".join(str(error).split()) or type(error).__name__
    cause = error.__cause__
    return f"{said} ({error_text(cause)})" if cause is not None else said
