"""Issues of a tracker as documents: fields, description, comments and attachments in sections, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.scalars import escape_markdown, strip
from papyrion.operators.relations import union_first

MOST_INSTANCES = 1000
#: The lines that head an issue, and the fields they show.
META = (("Issue", "key"), ("Type", "issue_type"), ("Status", "status"), ("Project", "project"), ("Assignee", "assignee"))


def comments_of(sources: list[DataFrame]) -> DataFrame:
    """Comments of several sources (``issue, comment_id, author, created, body``), each once: by id, else by author,
    time and body; the earlier source wins."""
    keyed = [s.withColumn("identity", F.coalesce(F.concat(F.lit("id:"), F.col("comment_id")), F.concat_ws("\u0001", "author", "created", "body"))) for s in sources]
    return union_first(keyed, ["issue", "identity"], ["created", "comment_id", "author", "body"]).drop("identity", "source_no")


def missing_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issues that report more comments than were found: ``issue, warning``."""
    n = comments.groupBy("issue").agg(F.count(F.lit(1)).alias("found"))
    rows = issues.select(F.col("key").alias("issue"), "comment_total").join(n, "issue", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.where("comment_total > found").select("issue", F.format_string("the issue reports %d comment(s), %d found", F.col("comment_total").cast("int"), F.col("found").cast("int")).alias("warning"))


def issue_blocks(issues: DataFrame, comments: DataFrame, attachments: DataFrame) -> DataFrame:
    """``issue, section, position, kind, heading_level, txt, src``: the summary as title, one line per field that is
    given, the description, then comments and attachments under headings of their own where there are any. Sections
    are united, so nothing waits for a join; their order is in ``section`` and ``position``."""
    base = issues.withColumnRenamed("key", "issue").withColumn("key", F.col("issue"))
    part = lambda df, section, position, kind, level, txt, src=None: df.select("issue", F.lit(section).alias("section"), position.cast("long").alias("position"), F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("heading_level"), txt.alias("txt"), (src if src is not None else F.lit(None).cast("string")).alias("src"))
    title = part(base, 0, F.lit(0), "heading", 1, F.coalesce("summary", "key"))
    lines = base.select("issue", F.posexplode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("v")) for n, c in META])).alias("i", "m")).where("coalesce(m.v, '') <> ''")
    meta = part(lines, 1, F.col("i"), "paragraph", None, F.concat("m.n", F.lit(": "), "m.v"))
    text = part(base.where(strip(F.coalesce("description", F.lit(""))) != ""), 2, F.lit(0), "paragraph", None, F.col("description"))
    order = F.struct(F.coalesce("created", F.lit("")), F.coalesce("comment_id", F.lit("")))
    listed = comments.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "author", "created", "body"))).alias("cs"))
    heads = part(listed, 3, F.lit(-1), "heading", 2, F.lit("Comments"))
    each = listed.select("issue", F.posexplode("cs").alias("i", "c"))
    who = part(each, 3, F.col("i") * 2, "heading", 3, F.concat_ws(" — ", F.col("c.author"), F.col("c.created")))
    said = part(each, 3, F.col("i") * 2 + 1, "paragraph", None, F.coalesce("c.body", F.lit("")))
    files = attachments.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("file", "filename", "mime_type"))).alias("fs"))
    attached = part(files, 4, F.lit(-1), "heading", 2, F.lit("Attachments"))
    rows = files.select("issue", F.posexplode("fs").alias("i", "f"))
    is_image = F.coalesce(F.col("f.mime_type"), F.lit("")).startswith("image/")
    pictures = part(rows.where(is_image), 4, F.col("i"), "image", None, F.col("f.filename"), F.col("f.file"))
    links = part(rows.where(~is_image), 4, F.col("i"), "paragraph", None, F.concat(F.lit("["), escape_markdown(F.col("f.filename")), F.lit("]("), F.col("f.file"), F.lit(")")))
    out = title
    for more in (meta, text, heads, who, said, attached, pictures, links):
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- instances, queries, media


def merged_instances(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Instances of two registers by name; where both have one, the first one's row counts as a whole."""
    rest = [c for c in first.columns if c != key]
    one = first.select(F.col(key), F.struct(*rest).alias("a"))
    both = one.join(second.select(F.col(key), F.struct(*rest).alias("b")), key, "full_outer")
    return both.select(key, F.coalesce("a", "b").alias("row")).select(key, "row.*")


def resolved_instance(requests: DataFrame, instances: DataFrame, fallback: str | None, only: bool) -> DataFrame:
    """``request_id, instance, error``: the instance asked for, else the default, else the first by name, or with ``only`` the
    sole one there is. One that is not known is an error. Instances are configured by hand: more than ``MOST_INSTANCES``
    are refused."""
    names = sorted(r["name"] for r in instances.where("name is not null").select("name").distinct().limit(MOST_INSTANCES + 1).collect())
    if len(names) > MOST_INSTANCES:
        raise ValueError(f"more than {MOST_INSTANCES} instances")
    sole = names[0] if names and (len(names) == 1 or not only) else None
    wanted = F.coalesce(F.nullif("asked", F.lit("")), F.lit(fallback).cast("string"), F.lit(sole).cast("string"))
    known = F.coalesce(wanted.isin(*names), F.lit(False))
    return requests.select("request_id", F.when(known, wanted).alias("instance"), F.when(wanted.isNull(), "no instance").when(~known, F.concat(F.lit("unknown instance: "), wanted)).alias("error"))


def issue_query(project: Column, issue_type: Column, words: Column) -> Column:
    """The tracker's query for issues of a project, of a type by number or name, with some words; what looks like a key is
    also looked for as one."""
    quoted = lambda c: F.regexp_replace(c, r'(["\\\\])', r"\\$1")
    kind, search = strip(F.coalesce(issue_type, F.lit(""))), strip(F.coalesce(words, F.lit("")))
    by_type = F.when(kind == "", "").when(kind.rlike(r"^\d+$"), F.concat(F.lit(" AND issuetype = "), kind)).otherwise(F.concat(F.lit(' AND issuetype = "'), quoted(kind), F.lit('"')))
    text = F.concat(F.lit('summary ~ "'), quoted(search), F.lit('*" OR text ~ "'), quoted(search), F.lit('*"'))
    like_key = search.contains("-") & ~search.contains(" ")
    by_words = F.when(search == "", "").otherwise(F.concat(F.lit(" AND ("), F.when(like_key, F.concat(F.lit('key = "'), quoted(search), F.lit('" OR '))).otherwise(""), text, F.lit(")")))
    return F.concat(F.lit('project = "'), quoted(project), F.lit('"'), by_type, by_words, F.lit(" ORDER BY updated DESC"))


def _last_part(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def media_keys(attachments: DataFrame, doc: str) -> DataFrame:
    """``doc, probe, file``: all names by which a saved attachment may be meant. Of attachments of one name the last counts."""
    names = F.array("attachment_id", "content", "thumbnail", "self", "filename", _last_part(F.col("file")))
    rows = attachments.where("saved and coalesce(file, '') <> ''").select(doc, "file", F.col("position").alias("at"), F.explode(names).alias("name")).where("coalesce(name, '') <> ''")
    each = rows.select(doc, "file", "at", F.explode(F.array("name", _last_part(F.col("name")))).alias("probe"))
    return each.groupBy(doc, "probe").agg(F.max_by("file", "at").alias("file"))


def rewritten_media(refs: DataFrame, attachments: DataFrame, doc: str) -> DataFrame:
    """References (``doc, ref_no, target, alt, media_id``) with ``file``, the saved attachment each means, or null: by its
    target, the target's last part, its text, then its media id."""
    probes = F.array("target", _last_part(F.col("target")), "alt", "media_id")
    rows = refs.select(doc, "ref_no", F.posexplode(probes).alias("priority", "probe")).where("coalesce(probe, '') <> ''")
    hits = rows.join(media_keys(attachments, doc), [doc, "probe"]).groupBy(doc, "ref_no").agg(F.min_by("file", "priority").alias("file"))
    return refs.join(hits, [doc, "ref_no"], "left")


def attachment_blocks(attachments: DataFrame, shown: DataFrame, doc: str) -> DataFrame:
    """``doc, position, kind, txt, src`` of the attachments section: an image not shown yet as an image, once; anything else
    as a link. Attachments: ``doc, position, file, filename, mime_type``; shown: ``doc, src``."""
    known = shown.select(doc, F.col("src").alias("file"), F.lit(True).alias("known")).distinct()
    turn = F.row_number().over(Window.partitionBy(doc, "file").orderBy("position"))
    rows = attachments.where("coalesce(file, '') <> ''").join(known, [doc, "file"], "left").withColumn("turn", turn)
    name = F.coalesce("filename", _last_part(F.col("file")))
    image = F.coalesce("mime_type", F.lit("")).startswith("image/") & F.col("known").isNull() & (F.col("turn") == 1)
    return rows.select(doc, "position", F.when(image, "image").otherwise("paragraph").alias("kind"), F.when(image, name).otherwise(F.concat(F.lit("["), name, F.lit("]("), F.col("file"), F.lit(")"))).alias("txt"), F.when(image, F.col("file")).alias("src"))
