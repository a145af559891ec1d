"""Packages written out, and what publishing them needs to know: inputs, files to send, the state of what is published.

Each planner is a relation. Nothing is sent anywhere: a plan says what a client would have to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.scalars import blank_to_null, document_id, front_matter, numbered, package_name
from papyrion.operators import chunks, flat, relations

SCHEMA_VERSION, STATE_VERSION = "1.0", "1.1"
# Names of the files of a package, by what they hold.
OUTPUTS = {"document_json": "document.json", "publication_markdown": "render_document.md", "publication_html": "render_document.html", "rag_markdown": "render_document.rag.md", "chunks": "chunks.jsonl"}
MANIFEST = "manifest.json"

# ---------------------------------------------------------------- packages


def package_documents(packages: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """A row per package that has blocks: its directory, id and title, and its contents as files would hold them.
    Packages: ``key, package, title, original_path, source_sha256``; blocks: ``key, block_no, kind, heading_level, txt,
    src``. Repeated rows count once. Blocks are moved once, to where their package is, and made into text there."""
    own = blocks.select(key, "block_no", "kind", "heading_level", "txt", "src").repartition(key).distinct()
    shown = flat.markdown(F.col("kind"), F.col("heading_level"), F.col("txt"), F.col("src"))
    page = flat.html(F.col("kind"), F.col("heading_level"), F.col("txt"), F.col("src"))
    rows = own.select(key, F.struct("block_no", shown.alias("md"), page.alias("html"), F.struct("block_no", "kind", "heading_level", "txt", "src").alias("block")).alias("b"), F.when(F.col("kind") == "image", F.col("src")).alias("image"))
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list("b")).alias("bs"), F.array_sort(F.collect_set("image")).alias("images"))
    joined = lambda field, gap: F.array_join(F.filter(F.col(f"bs.{field}"), lambda x: x != ""), gap)
    named = packages.select(key, "package", "title", "original_path", "source_sha256").distinct()
    return named.join(parts, key).select(
        key, package_name(F.coalesce("original_path", "package")).alias("package_dir"), document_id(F.col("source_sha256"), F.col("package")).alias("document_id"), "title", "original_path", "source_sha256",
        F.size("bs").cast("long").alias("n_blocks"), "images", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "title", F.col("bs.block").alias("blocks"))).alias("document_json"),
        F.concat(joined("md", "\n\n"), F.lit("\n")).alias("publication_markdown"), F.concat(joined("html", "\n"), F.lit("\n")).alias("publication_html"),
    )


def package_files(documents: DataFrame, key: str) -> DataFrame:
    """``key, package_dir, file, content``: the files of each package, the manifest naming the others last. All of a row's
    files are made of that row."""
    retrieval = documents.withColumn("rag_markdown", legacy_view(F.col("publication_markdown"), F.array().cast("array<string>")))
    pieces = retrieval.withColumn("pieces", F.coalesce(chunks.pieces(F.col("rag_markdown")), F.array().cast("array<struct<path:array<string>,content:string>>")))
    line = lambda c, i: F.concat(F.to_json(F.struct((i + 1).alias("id"), c["path"].alias("heading_path"), c["content"].alias("content"), chunks.embedding_text(c).alias("embedding_text"))), F.lit("\n"))
    full = pieces.withColumn("chunks", F.array_join(F.transform("pieces", line), "")).withColumn("n_chunks", F.size("pieces"))
    manifest = F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(F.col("source_sha256").alias("sha256"), "original_path").alias("source"),
        F.create_map(*[F.lit(x) for pair in OUTPUTS.items() for x in pair]).alias("outputs"), "images", "n_chunks", F.lit(True).alias("rag_ready"),
    ))
    each = F.array(*[F.struct(F.lit(name).alias("file"), F.coalesce(what, F.lit("")).alias("content")) for what, name in OUTPUTS.items()], F.struct(F.lit(MANIFEST).alias("file"), manifest.alias("content")))
    return full.select(key, "package_dir", F.explode(each).alias("f")).select(key, "package_dir", "f.file", "f.content")


def write_packages(files: DataFrame, target: str, mode: str = "errorifexists") -> None:
    """Writes the files of all packages as text below ``target``, one folder a package and file; packages of one name stay
    apart by their key. What exists is refused, or replaced as a whole with ``mode='overwrite'``: a failed job leaves
    the old folder, since Spark commits only complete output."""
    key = files.columns[0]
    folder = F.concat_ws("~", "package_dir", F.col(key).cast("string"))
    files.select(folder.alias("package"), "file", F.col("content").alias("value")).write.partitionBy("package", "file").mode(mode).option("lineSep", "\n").text(target)


def write_bundles(files: DataFrame, target: str, mode: str = "errorifexists") -> None:
    """Writes the files of all packages as ``write_packages`` does, but with those of many packages in one file on disk: a
    row each, its content byte for byte, apart by name, so that a reader of manifests opens no other. What is written
    grows with the contents, not with six files and seven folders a package. ``packages.bundled_files`` gives the files
    back, and ``write_packages`` makes folders of those that are wanted as such."""
    key = F.col(files.columns[0]).cast("string").alias("key")
    files.select(key, "package_dir", "file", "content").write.partitionBy("file").mode(mode).option("compression", "zstd").parquet(target)


def legacy_view(text: Column, removed: Column) -> Column:
    """A Markdown text for retrieval as it was first made: without the images in ``removed``, an image shown again left
    out, no lines of emphasis marks alone, no blank lines in excess."""
    image = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"
    before_image = r"(?=!\[[^\]]*\]\([^)\s]+[^)]*\))"
    out = F.aggregate(removed, text, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"!\[[^\]]*\]\(\Q"), t, F.lit(r"\E[^)]*\)")), F.lit("")))
    # from the front: what stands before an image is kept, the image only the first time
    pieces = F.split(out, before_image)
    start = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, piece: Column) -> Column:
        target = F.regexp_extract(piece, "^" + image, 1)
        again = (target != "") & F.array_contains(acc["seen"], target)
        return F.struct(F.concat(acc["out"], F.when(again, F.regexp_replace(piece, "^" + image, "")).otherwise(piece)).alias("out"), F.when(target != "", F.array_append(acc["seen"], target)).otherwise(acc["seen"]).alias("seen"))

    once = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    bare = F.regexp_replace(F.regexp_replace(once, r"(?m)^\s*(?:\*\*|__|\*|_)\s*$", ""), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(bare, r"^\s+|\s+$", ""), F.lit("\n"))


def child_packages(pages: DataFrame, parent: str, key: str, title: str, position: str) -> DataFrame:
    """``parent, children``: the children of each package in order, numbered from 1."""
    row = F.struct(F.coalesce(F.col(position), F.lit(2**31 - 1)).alias("position"), F.col(key).alias("child"), F.col(title).alias("title"))
    own = pages.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("parent")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return own.select("parent", F.posexplode("rows").alias("i", "r")).select("parent", (F.col("i") + 1).alias("child_no"), "r.child", "r.title")


def header_images(assets: DataFrame, shown: DataFrame, doc: str) -> DataFrame:
    """``doc, position, src``: header images no block of the document shows, in order; they go before its blocks, each once.
    Assets: ``doc, file, role``; shown: ``doc, src``."""
    heads = assets.where((F.col("role") == "header") & (F.coalesce("file", F.lit("")) != "")).select(doc, F.col("file").alias("src")).distinct()
    new = heads.join(shown.select(doc, "src").distinct(), [doc, "src"], "left_anti")
    return new.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy("src")))


def header_media(media: DataFrame, assets: DataFrame, doc: str) -> DataFrame:
    """``doc, sha256, role, file, known``: page media by content, each once a role: known ones keep their file, new ones get
    ``role_001…``. Media: ``doc, sha256, role, name``; assets: ``doc, sha256, file``."""
    once = media.where("sha256 is not null").groupBy(doc, "role", "sha256").agg(F.min("name").alias("name"))
    file = assets.where("sha256 is not null").groupBy(doc, "sha256").agg(F.min("file").alias("own"))
    rows = once.join(file, [doc, "sha256"], "left")
    no = F.row_number().over(Window.partitionBy(doc, "role", F.col("own").isNull()).orderBy("name", "sha256"))
    new = F.concat("role", F.lit("_"), numbered(no), F.regexp_extract("name", r"(\.[^./]+)$", 1))
    return rows.select(doc, "sha256", "role", F.coalesce("own", new).alias("file"), F.col("own").isNotNull().alias("known"))


# ---------------------------------------------------------------- inputs and files to send


def publication_inputs(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """``path`` of the Markdown to publish: what manifests name (``dir, name``), if any does; else every Markdown file
    that is no retrieval or raw view."""
    named = files.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    if manifests is not None:
        found = named.join(manifests.select("dir", "name").distinct(), ["dir", "name"], "left_semi").select("path")
        if not found.isEmpty():
            return found.distinct()
    low = F.lower("name")
    return named.where(low.endswith(".md") & ~F.col("name").endswith(".rag.md") & ~F.col("name").endswith(".raw.md")).select("path").distinct()


def files_to_send(saved: DataFrame, shown: DataFrame, doc: str) -> DataFrame:
    """``doc, path`` of local files a publication has to carry: its saved assets and the images its text shows."""
    local = lambda df, c: df.select(doc, F.regexp_replace(F.col(c), r"^\./", "").alias("path")).where("coalesce(path, '') <> '' and not path rlike '^(?:https?://|data:|#|/)'")
    return local(saved, "file").unionByName(local(shown, "src")).distinct()


def ignored(files: DataFrame, allowed: DataFrame, present: DataFrame) -> DataFrame:
    """``path`` of Markdown files to add to the list of those left out: neither allowed nor listed already."""
    every = files.where(F.lower("path").endswith(".md")).select("path").distinct()
    return every.join(allowed.select("path").distinct(), "path", "left_anti").join(present.select("path").distinct(), "path", "left_anti")


def publication_text(text: Column, title: Column, page: Column) -> Column:
    """The text to publish: its front matter with the given title and page id, without a space; the package is not touched."""
    head, body = front_matter(text)
    kept = F.filter(F.split(F.coalesce(head, F.lit("")), "\n"), lambda x: (x != "") & ~x.rlike(r"^(?:title|page_id|space_key)\s*:"))
    quoted = F.concat(F.lit('"'), F.regexp_replace(title, r'(["\\])', r"\\$1"), F.lit('"'))
    lines = F.concat(kept, F.array(F.concat(F.lit("title: "), quoted)), F.when(blank_to_null(page).isNotNull(), F.array(F.concat(F.lit('page_id: "'), page, F.lit('"')))).otherwise(F.array().cast("array<string>")))
    bare = F.regexp_replace(body, r"(?m)^\s*<!--\s*confluence-(?:page-id|space-key):.*?-->\s*\n?", "")
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), F.regexp_replace(bare, r"\s+$", ""), F.lit("\n"))


# ---------------------------------------------------------------- state


def identity(role: Column, instance: Column, space: Column, parent: Column, source: Column, page: Column) -> Column:
    """What a state row is replaced by: a primary publication by where it was published from and to, a copy by its page."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.coalesce(role, F.lit("primary")) == "primary", F.concat_ws("\u0001", F.lit("primary"), text(instance), text(space), text(parent), text(source))).otherwise(F.concat_ws("\u0001", F.lit("copy"), text(page)))


def publication_state(state: DataFrame, published: DataFrame, version: list[str]) -> DataFrame:
    """State rows ``instance, space, parent_id, page_id, title, source, role`` and the columns of ``version`` after
    publishing: of each identity the last row, new ones added."""
    key = identity(*[F.col(c) for c in ("role", "instance", "space", "parent_id", "source", "page_id")])
    both = [df.withColumn("role", F.coalesce("role", F.lit("primary"))).withColumn("identity", key) for df in (state, published)]
    return relations.upsert(*both, ["identity"], version).drop("identity")


def migrated_state(state: DataFrame, regenerated: DataFrame) -> DataFrame:
    """State rows (``rel_dir`` and more) carried over to regenerated packages (``rel_dir, publication, fingerprint``): with
    the new source name and fingerprint where there is one, and the state's version; ``lost`` where no package lies
    there any more, and then the whole replacement has to be undone."""
    new = regenerated.groupBy("rel_dir").agg(F.min("publication").alias("publication"), F.min("fingerprint").alias("fingerprint"), F.lit(True).alias("there"))
    rows = state.join(new, "rel_dir", "left")
    return rows.withColumns({"source": F.coalesce("publication", "source"), "source_fingerprint": F.col("fingerprint"), "schema_version": F.lit(STATE_VERSION), "lost": F.col("there").isNull()}).drop("publication", "fingerprint", "there")


def verified(expected: DataFrame, pages: DataFrame) -> DataFrame:
    """``request_id, page_id, confirmed``: a publication is confirmed by exactly one current page of its space, title and
    parent. Expected: ``request_id, space, title, parent_id``; pages: ``space, title, parent_id, page_id, status``."""
    root = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    live = pages.where(F.lower(F.coalesce("status", F.lit("current"))) == "current").groupBy("space", "title", root("parent_id").alias("above")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("page_id"))
    rows = expected.withColumn("above", root("parent_id")).join(live, ["space", "title", "above"], "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    return rows.select("request_id", F.when(one, F.col("page_id")).alias("page_id"), one.alias("confirmed"))


def resumed(requests: DataFrame, state: DataFrame, alive: DataFrame) -> DataFrame:
    """``request_id, action, issue``: what a tracker import has to do. An issue of the state that is gone is created anew; one
    left unfinished is completed; a finished one whose source is unchanged is left alone. Requests: ``request_id,
    source, fingerprint``; state: ``source, issue, status, source_fingerprint``; alive: ``issue``."""
    known = state.groupBy("source").agg(F.max_by(F.struct("issue", "status", "source_fingerprint"), F.struct("status", "issue")).alias("s")).select("source", "s.*")
    rows = requests.join(known, "source", "left").join(alive.select("issue", F.lit(True).alias("alive")).distinct(), "issue", "left")
    same = F.coalesce(F.col("fingerprint") == F.col("source_fingerprint"), F.lit(False))
    action = F.when(F.col("issue").isNull() | F.col("alive").isNull(), "create").when(F.col("status") != "complete", "resume").when(same, "skip").otherwise("update")
    return rows.select("request_id", action.alias("action"), F.when(action != "create", F.col("issue")).alias("issue"))
