"""Parent-child rows to full hierarchies.

Frontier joins from the roots, each over twice as many levels as the one before, give each node its path, depth and root;
exploding the paths gives all ancestor-descendant pairs; what no root reaches lies on a loop or hangs below one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.runtime import small, store, store_counted


def clean_key(col: Column) -> Column:
    """An id as text: without white space around it and a trailing ``.0``; null where nothing or ``0`` is left."""
    bare = F.regexp_replace(F.regexp_replace(col.cast("string"), r"(?U)^\s+|\s+$", ""), r"\.0+$", "")
    return F.when(bare.isin("", "0"), None).otherwise(bare)


def latest_rows(df: DataFrame, node: str, parent: str, version: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per node (``node``, ``parent`` cleaned, columns of ``keep``), from its row with the highest
    version. Ties go to the largest remaining values, so that repeated rows and any order of rows give the same."""
    clean = df.select(
        clean_key(F.col(f"`{node}`")).alias("node"),
        clean_key(F.col(f"`{parent}`")).alias("parent"),
        (F.col(f"`{version}`") if version else F.lit(0)).cast("long").alias("version"),
        *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep],
    ).where("node is not null")
    rest = F.struct("version", "parent", *[f"keep_{c}" for c in keep])
    return clean.groupBy("node").agg(F.max(rest).alias("row")).select("node", F.col("row.parent").alias("parent"), *[F.col(f"row.keep_{c}").alias(f"keep_{c}") for c in keep])


def _order(col: Column) -> Column:
    """Sorts ids as numbers where they are, else as text: numbers first."""
    return F.struct(F.coalesce(F.length(F.regexp_extract(col, r"^\d+$", 0)), F.lit(0)).alias("digits"), col.alias("key"))


def hierarchy(df: DataFrame, node: str, parent: str, version: str | None = None, paths: bool = True) -> DataFrame:
    """Full hierarchy of parent-child rows: ``node, parent, root, depth, path, looped``; without ``paths``, ``path`` is
    null throughout and nothing as long as a path is moved.

    ``path`` lists the ids from the root to the node. A node without parent, or whose parent is no node, is a root
    of depth 0. Where the chain of parents runs into a loop, ``root`` is the smallest id on that loop, ``depth`` -1
    and ``path`` null. Null or empty ids give no row, an empty table no rows; other columns are not looked at, and
    ids are compared as text, smaller numbers first.

    Every node not yet reached points to an ancestor. One join a round looks the ancestor up: if the frontier of reached
    nodes has it, the node is reached, with the path extended; else the node takes over the ancestor's own pointer. So
    the frontier takes in twice as many levels each round, and a tree of any depth needs a logarithm of its levels.
    A round that reaches nothing shows that the rest lies on loops or below them, since depths have no gaps.
    """
    nodes = store(latest_rows(df, node, parent, version), "nodes")
    known = nodes.select(F.col("node").alias("known"))
    no_path = F.lit(None).cast("array<string>")
    own = F.array("node") if paths else no_path
    start = nodes.join(known, F.col("parent") == F.col("known"), "left").select(
        "node", F.when(F.col("known").isNotNull(), F.col("parent")).alias("to"), F.when(F.col("known").isNull(), F.col("node")).alias("root"),
        F.when(F.col("known").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("far"), own.alias("path"), _order(F.col("node")).alias("least"),
    )
    measures = {"rest": F.count_if(F.col("root").isNull()), "reached": F.count_if(F.col("root").isNotNull()), "size": F.sum(F.when(F.col("root").isNull(), F.length("node") + F.length("to") + F.length("least.key")))}
    rows, n = store_counted(start, "levels", **measures)
    found = [rows.where("root is not null")]
    while n["rest"] and n["reached"]:
        active = rows.where("root is null")
        there = F.coalesce(F.col("up.root"), F.col("up.to"))
        ahead = active
        for level in found:
            ahead = ahead.unionByName(level)
        ahead = ahead.select(F.struct("node", "to", "root", "far", "path", "least").alias("up"))
        following = small(active, n["rest"], size=None if paths else n["size"]).join(ahead, F.col("to") == F.col("up.node")).where(there.isNotNull())
        step = following.select(
            "node", F.col("up.to").alias("to"), F.col("up.root").alias("root"), (F.col("far") + F.col("up.far")).alias("far"),
            (F.concat("up.path", "path") if paths else no_path).alias("path"), F.least("least", "up.least").alias("least"),
        )
        rows, n = store_counted(step, "levels", **measures)
        found.append(rows.where("root is not null"))
    tree = found[0]
    for level in found[1:]:
        tree = tree.unionByName(level)
    tree = tree.select("node", "root", F.col("far").cast("int").alias("depth"), "path")
    if n["rest"]:
        tree = tree.unionByName(_loops(rows.where("root is null").select("node", "to", "least"), n["rest"], n["size"]).select("node", "root", F.lit(-1).alias("depth"), no_path.alias("path")))
    return tree.join(nodes, "node").select("node", "parent", "root", "depth", "path", (F.col("depth") < 0).alias("looped"))


def _loops(jump: DataFrame, n: int, size: int) -> DataFrame:
    """``node, root`` of nodes that no root reaches. ``jump``: each node's pointer ``to`` along its parents, with the
    ``least`` id passed on the way. Pointers double until all of them stand on loops (their number no longer shrinks)
    and a turn more finds no lesser id (the way passed then covers the loop)."""
    ends = 0
    while True:
        far = jump.select(F.col("node").alias("mid"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        less = F.col("least2") < F.col("least")
        step = small(jump, n, size=size).join(far, F.col("to") == F.col("mid"))
        jump, seen = store_counted(step.select("node", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), less.alias("less")), "loops", less=F.count_if("less"))
        jump = jump.drop("less")
        before, ends = ends, jump.select("to").distinct().count()
        if not seen["less"] and ends == before:
            break
    on = jump.select(F.col("node").alias("mid"), F.col("least.key").alias("root"))
    return small(jump.select("node", "to"), n, size=size).join(on, F.col("to") == F.col("mid")).select("node", "root")


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs ``ancestor, node, distance`` of a ``hierarchy`` (distance 0 is the node itself). Nodes on or below a
    loop have no pairs. The pairs come from each node's own path: no join and no group."""
    return tree.where("path is not null").select("node", "depth", F.posexplode("path").alias("at", "ancestor")).select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def loops(tree: DataFrame) -> DataFrame:
    """One row per loop: ``root`` (its smallest id) and ``nodes``, the number of nodes on or below it."""
    return tree.where("looped").groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))


def with_counts(tree: DataFrame) -> DataFrame:
    """``hierarchy`` with the number of descendants of each node, by ancestor pairs counted before the shuffle."""
    n = descendants(tree).where("distance > 0").groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_descendants"))
    return tree.join(n, F.col("node") == F.col("ancestor"), "left").drop("ancestor").withColumn("n_descendants", F.when(F.col("looped"), None).otherwise(F.coalesce("n_descendants", F.lit(0))))


def sibling_rank(df: DataFrame, parent: str, position: str, title: str) -> DataFrame:
    """Adds ``sibling_no``, the order of a page among the children of its parent: by position, then title."""
    return df.withColumn("sibling_no", F.row_number().over(Window.partitionBy(parent).orderBy(position, F.lower(title), title)))
