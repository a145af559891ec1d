"""Documents that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrion.operators import chunks, relations


def stream_chunks(docs: DataFrame, text: str, keep: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Chunks of arriving documents appended to a Parquet folder, each document once. Chunking needs no state."""
    rows = chunks.chunk(docs, text, keep)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_state(changes: DataFrame, key: list[str], version: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Keyed state kept by micro-batches: each writes a new version of the state below ``target``, numbered by batch, from
    the one before it. A batch run again after a failure writes the same version again, so each change counts once."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{target}/version={number - 1}")
            batch = relations.upsert(old, batch, key, version)
        else:
            batch = relations.upsert(batch.limit(0), batch, key, version)
        batch.write.mode("overwrite").parquet(f"{target}/version={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_state(spark: SparkSession, target: str) -> DataFrame:
    """The state after the last batch that is there, read through the partition column of the versions."""
    versions = spark.read.parquet(target)
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")
