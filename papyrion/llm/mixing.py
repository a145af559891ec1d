"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``copies`` times. Prefix sums of these expectations, moved by one random
offset, cross an integer once for each copy emitted: the number of copies of a document is ``copies`` rounded down or
up, and of a source its total rounded. Documents lie in hash blocks, by size within a block; the sum before a block
comes from the counts of the blocks before it, so no source is ever gathered in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.text import arrow, rows_of
from papyrion.runtime import session_of, store

#: Documents expected in a block.
BLOCK_DOCS = 50_000
#: The default vocabulary, looked up in the public tokenizers' folder.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with the byte-level vocabularies, without backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary's lines, built once by each worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(col: Column) -> Column:
    """Sources are spelled unevenly: lower case, without white space around; null where nothing is left."""
    bare = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def token_counts(df: DataFrame, doc: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc, source, tokens`` of every document; a null text has none. The driver reads the vocabulary, a file of one or
    two MB, and sends it to the workers."""
    lines = session_of(df).sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(lines.value).encode_ordinary
        for batch in batches:
            docs, sources, texts = zip(*rows_of(batch), strict=True) if batch.num_rows else ((), (), ())
            yield arrow({"doc": (docs, pa.int64()), "source": (sources, pa.string()), "tokens": ([len(encode(t)) if t else 0 for t in texts], pa.int64())})

    return df.select(F.col(f"`{doc}`").cast("long").alias("doc"), source_name(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("text")).mapInArrow(count, "doc long, source string, tokens long")


def _plan(tokens: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """A row for each source: what there is, its target, and how often each document is expected. ``total`` tokens, by
    default as many as let every source that has both documents and a target reach its share."""
    have = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    want = targets.groupBy("name").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    both = have.join(want, F.col("source").eqNullSafe(F.col("name")), "full_outer").select(F.coalesce("source", "name").alias("source"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("cap", F.lit(0)).alias("cap"))
    usable = (F.col("available") > 0) & (F.col("share") > 0) & (F.col("cap") > 0)
    every = Window.partitionBy()  # a row a source
    both = both.withColumn("goal", F.when(usable, F.try_divide(F.col("share"), F.sum(F.when(usable, F.col("share"))).over(every))).otherwise(0.0))
    most = F.min(F.when(usable, F.try_divide(F.col("cap") * F.col("available"), F.col("goal")))).over(every)
    size = most if total is None else F.lit(float(total))
    return both.withColumn("copies", F.when(usable, F.least(F.col("cap").cast("double"), F.try_divide(F.col("goal") * size, F.col("available")))).otherwise(0.0))


def mixture(tokens: DataFrame, targets: DataFrame, source: str, share: str, cap: str, total: int | None = None, seed: int = 1, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """(mixture ``doc_id, source, tokens, copy_no``; shares a row for each source).

    ``tokens`` as ``token_counts`` gives them, stored. A document is emitted at most ``cap`` times. Sources without
    target, without name or without tokens give nothing and are reported with share 0, as is a target without
    documents; the shares of the others are then taken in proportion. Repeated rows of a document count once.
    """
    tokens = tokens.where("doc is not null").groupBy("doc").agg(F.max(F.struct("tokens", "source")).alias("row")).select("doc", "row.*")
    goals = targets.select(source_name(F.col(f"`{source}`")).alias("name"), F.col(f"`{share}`").cast("double").alias("share"), F.col(f"`{cap}`").cast("int").alias("cap")).where("name is not null")
    tokens = store(tokens, "tokens")
    plan = store(_plan(tokens, goals, total), "plan")
    n = tokens.count()
    blocks = max(1, -(-n // block_docs))
    placed = tokens.where("source is not null").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(blocks)))
    counts = placed.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as sources times blocks
    bases = counts.withColumn("before", before).join(plan.where("copies > 0").select("source", "copies"), "source").select("source", "block", "before", "copies")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "block").orderBy("tokens", F.xxhash64("doc", F.lit(seed + 1)), "doc")))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    last = F.floor((F.col("before") + F.col("rank")) * F.col("copies") + offset)
    first = F.floor((F.col("before") + F.col("rank") - 1) * F.col("copies") + offset)
    chosen = ranked.join(bases, ["source", "block"]).withColumn("times", (last - first).cast("int")).where("times > 0").select("doc", "source", "tokens", "times")
    chosen = store(chosen, "chosen")
    mixed = chosen.select(F.col("doc").alias("doc_id"), "source", "tokens", F.explode(F.sequence(F.lit(1), "times")).alias("copy_no"))
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("mixed_tokens"), F.sum("times").alias("mixed_documents"), F.max("times").alias("most_copies"))
    report = plan.join(reached.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "documents", F.col("available").alias("available_tokens"), F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.col("copies").alias("expected_copies"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mixed_documents", "most_copies", "mixed_tokens")],
    )
    share_of = F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy()))
    return mixed, report.withColumn("reached_share", F.coalesce(share_of, F.lit(0.0)))
