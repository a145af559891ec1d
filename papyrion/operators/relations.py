"""Relational operators over document tables: deduplication, asset resolution, positional and range joins, planners,
keyed state. All are joins, aggregates and windows; keys are columns of the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.scalars import numbered


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order. The least row is found by aggregation, so copies shrink before they travel."""
    rest = [c for c in df.columns if c not in by and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("row")
    return df.groupBy(*by).agg(row).select(*by, *[F.col(f"row.{c}").alias(c) for c in (*order, *rest)]).select(df.columns)


def duplicate_of(df: DataFrame, digest: str, key: str) -> DataFrame:
    """Adds ``first_key`` and ``duplicate``: the least key with the same content, and whether that is another row."""
    first = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("first_key"))
    return df.join(first, digest, "left").withColumn("duplicate", F.coalesce(F.col("first_key") != F.col(key), F.lit(False)))


def duplicate_stats(df: DataFrame, digest: str) -> DataFrame:
    """One row: ``occurrences, different, duplicates``. Exact, in two steps that combine before the shuffle."""
    each = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count(F.lit(1)).alias("different")).withColumn("duplicates", F.col("occurrences") - F.col("different"))


def repeated(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Keys that occur at least ``least`` times (two at least), with ``n``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, least))


def collapse_repeated(df: DataFrame, by: list[str], order: list[str], least: int = 2) -> DataFrame:
    """Rows without the later occurrences of keys met at least ``least`` times."""
    often = repeated(df, by, least).drop("n")
    marked = df.join(often.withColumn("often", F.lit(True)), by, "left")
    ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("often").isNull() | (F.col("rank") == 1)).select(df.columns)


def first_seen_names(df: DataFrame, group: list[str], item: str, position: str, prefix: str, suffix: Column | None = None) -> DataFrame:
    """Names ``prefix_001…`` of the different items of a group, in the order in which they first occur."""
    first = df.where(F.col(item).isNotNull()).groupBy(*group, item).agg(F.min(position).alias("first_at"))
    no = F.row_number().over(Window.partitionBy(*group).orderBy("first_at", item))
    return first.withColumn("name", F.concat(F.lit(prefix + "_"), numbered(no), suffix if suffix is not None else F.lit("")))


def clamped_positions(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Joins the k-th left row of a key with its k-th right row, all beyond the last with the last. Left rows without
    any right row fall away."""
    lk = left.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    over = Window.partitionBy(*by)
    rk = right.withColumn("k", F.row_number().over(over.orderBy(*right_order)))
    n = right.groupBy(*by).agg(F.count(F.lit(1)).alias("n_right"))
    return lk.join(n, by).withColumn("k", F.least("k", "n_right")).join(rk, [*by, "k"])


def prioritised(queries: DataFrame, keys: list[Column], lookup: DataFrame, lookup_key: str, value: str, qid: str) -> DataFrame:
    """``qid, value`` of the first of ``keys`` that the lookup knows, null if none. Keys are tried in their order; the
    lookup's first value (the least) counts where a key is there twice."""
    probes = queries.select(qid, F.posexplode(F.array(*keys)).alias("priority", "probe")).where("probe is not null")
    known = lookup.groupBy(F.col(lookup_key).alias("probe")).agg(F.min(value).alias("value"))
    hit = probes.join(known, "probe").groupBy(qid).agg(F.min_by("value", "priority").alias("value"))
    return queries.select(qid).distinct().join(hit, qid, "left")


def unique_lookup(df: DataFrame, key: str, other: DataFrame, other_key: str, value: str) -> DataFrame:
    """Adds ``value`` of the other side where its key is unambiguous, else null."""
    one = other.where(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias(key)).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
    return df.join(one, key, "left")


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int, by: list[str]) -> DataFrame:
    """Points with the ranges that hold them, ends included: an equality join on cells of ``width``, and a check. Each
    range is listed in every cell it touches, each point lies in one, so nothing is joined twice."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("cell", F.floor(F.col(point) / width)).join(cells, [*by, "cell"]).where(F.col(point).between(F.col(low), F.col(high))).drop("cell")


def union_first(parts: list[DataFrame], identity: list[str], order: list[str]) -> DataFrame:
    """Rows of several sources, one per identity: the earlier source wins, then the order within it."""
    tagged = [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return keep_first(out, identity, ["source_no", *order])


def upsert(state: DataFrame, changes: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Keyed state after changes: of each key the row with the greatest version, changes winning over the state at
    equal versions. Null keys are keys like others."""
    both = state.withColumn("is_change", F.lit(0)).unionByName(changes.withColumn("is_change", F.lit(1)))
    rest = [c for c in state.columns if c not in key and c not in version]
    row = F.max(F.struct(*version, "is_change", *rest)).alias("row")
    return both.groupBy(*key).agg(row).select(*key, *[F.col(f"row.{c}").alias(c) for c in (*version, *rest)]).select(state.columns)


def cascade(requests: DataFrame, state: DataFrame, request: str, levels: list[list[str]], value: str) -> DataFrame:
    """``request, value, level``: the state entry by the first list of columns that finds exactly one."""
    out = requests.select(request).distinct()
    names = []
    for i, keys in enumerate(levels):
        one = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(f"value_{i}")).where("n = 1").drop("n")
        out = out.join(requests.join(one, keys).select(request, f"value_{i}").distinct(), request, "left")
        names.append(f"value_{i}")
    level = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)])
    return out.select(request, F.coalesce(*names).alias("value"), level.alias("level"))


def publish_plan(requests: DataFrame, remote: DataFrame, mode: str) -> DataFrame:
    """What publishing would do: ``request_id, title, action, page_id, reason``.

    Requests: ``request_id, space, title, known_page``; remote pages: ``space, page_id, title``. A known page that still
    exists is updated, unless another page has the title. Else ``replace`` updates the one page of that title and
    creates where there is none, ``add`` creates under the first free title with a number behind. Several pages of one
    title are a conflict.
    """
    low = lambda c: F.lower(F.col(c))
    same = remote.groupBy("space", low("title").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("titled"))
    known = remote.select("space", F.col("page_id").alias("known_page"), F.lit(True).alias("alive")).distinct()
    r = requests.withColumn("key", low("title")).join(same, ["space", "key"], "left").join(known, ["space", "known_page"], "left")
    free = free_titles(requests.select("request_id", "space", "title"), remote)
    r = r.join(free, "request_id", "left")
    n, alive = F.coalesce("n", F.lit(0)), F.coalesce("alive", F.lit(False))
    clash = alive & ((n > 1) | ((n == 1) & (F.col("titled") != F.col("known_page"))))
    if mode == "replace":
        action = F.when(clash, "error").when(alive, "update").when(n > 1, "error").when(n == 1, "update").otherwise("create")
        page = F.when(clash, None).when(alive, F.col("known_page")).when(n == 1, F.col("titled"))
        title = F.col("title")
    else:
        action, page = F.lit("create"), F.lit(None).cast("string")
        title = F.col("free_title")
    reason = F.when(clash, "title belongs to another page").when((action == "error") & (n > 1), "several pages of this title")
    return r.select("request_id", title.alias("title"), action.alias("action"), page.alias("page_id"), reason.alias("reason"))


def free_titles(requests: DataFrame, remote: DataFrame, tries: int = 9999) -> DataFrame:
    """``request_id, free_title``: the title itself if no page of the space has it, else with the first free number from
    2 behind it in brackets. The least gap in the numbers taken, found per title, not by trial."""
    pattern = r"^(.*?)(?: \((\d+)\))?$"
    taken = remote.select("space", F.lower("title").alias("low")).distinct()
    numbered = taken.select("space", F.regexp_extract("low", pattern, 1).alias("key"), F.coalesce(F.regexp_extract("low", pattern, 2).try_cast("int"), F.lit(1)).alias("no")).where(f"no between 1 and {tries}").distinct()
    at = F.row_number().over(Window.partitionBy("space", "key").orderBy("no"))
    # numbers 1..k without gap are taken: k counts the rows whose number is their rank
    full = numbered.withColumn("gap", F.col("no") - at).where("gap = 0").groupBy("space", "key").agg(F.max("no").alias("last"))
    r = requests.withColumn("key", F.lower("title")).join(full, ["space", "key"], "left")
    return r.select("request_id", F.when(F.col("last").isNull(), F.col("title")).otherwise(F.concat("title", F.lit(" ("), (F.col("last") + 1).cast("string"), F.lit(")"))).alias("free_title"))


def to_upload(local: DataFrame, remote: DataFrame, on: list[str]) -> DataFrame:
    """Local files the remote side doesn't have yet."""
    return local.join(remote.select(*on).distinct(), on, "left_anti")


def last_by_name(files: DataFrame, path: str, order: str) -> DataFrame:
    """One file per base name, the last wins."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    return files.groupBy(name.alias("file_name")).agg(F.max_by(path, F.struct(order, path)).alias(path))


def corpus_index(packages: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Packages that have chunks, with their number."""
    return packages.join(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks")), key)


def batch_report(df: DataFrame, failed: Column, warnings: Column) -> DataFrame:
    """One row: how many succeeded and failed, and how many warnings there are."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(warnings), F.lit(0)).alias("warnings"))


def failures(df: DataFrame, key: str, reason: Column) -> DataFrame:
    """``key, reason`` of the rows for which there is a reason; repeated rows count once."""
    return df.select(key, reason.alias("reason")).where("reason is not null").distinct()


def heading_numbers(df: DataFrame, doc: list[str], order: str, level: str, deepest: int = 9) -> DataFrame:
    """Adds ``number`` (``2.1.3``) to headings: each level counts since the last heading above it; a level that a
    deeper heading skips counts as begun. A count is a window over what came before, so documents stay in order without a loop."""
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for k in range(1, deepest + 1):
        higher = F.coalesce(F.sum((F.col(level) < k).cast("int")).over(w), F.lit(0))
        out = out.withColumn(f"above_{k}", higher)
    for k in range(1, deepest + 1):
        since = Window.partitionBy(*doc, f"above_{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        implied = F.first(F.when(F.col(level) >= k, F.col(level)), ignorenulls=True).over(since) > k
        out = out.withColumn(f"no_{k}", F.sum((F.col(level) == k).cast("int")).over(since) + F.coalesce(implied, F.lit(False)).cast("int"))
    parts = F.array(*[F.when(F.col(level) >= k, F.col(f"no_{k}")) for k in range(1, deepest + 1)])
    number = F.array_join(F.transform(F.filter(parts, lambda x: x.isNotNull()), lambda x: x.cast("string")), ".")
    return out.withColumn("number", number).drop(*[f"above_{k}" for k in range(1, deepest + 1)], *[f"no_{k}" for k in range(1, deepest + 1)])
