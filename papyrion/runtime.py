"""Session helpers shared by the operators: tables, the shared folder, size-checked broadcasts.

Nothing here keeps state that a lost executor would take with it: intermediate results that are read more than
once are written as Parquet into the folder named by ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when a count has shown it to hold at most so many rows, and characters.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16_000_000

_written: list[tuple[object, object]] = []
_stored: WeakKeyDictionary[DataFrame, tuple[object, object]] = WeakKeyDictionary()


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. ``spark.checkpoint.dir`` where it is set; only a session without it
    (a local test) gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="papyrion-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove_written() -> None:
    while _written:
        fs, path = _written.pop()
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_remove_written)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name inside the shared folder; what is written there is removed when the driver ends."""
    target = f"{shared_dir(spark)}/papyrion-{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    _written.append((path.getFileSystem(spark._jsc.hadoopConfiguration()), path))
    return target


@contextmanager
def released(spark: SparkSession):
    """Lets Spark remove the shuffle files of what is written within as soon as it is written, instead of whenever the
    driver happens to collect its garbage. What is written lies in the shared folder and needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and returns a reader of it, so that lineage ends there and
    several consumers don't compute it again. Removed when the driver ends."""
    spark = session_of(df)
    target = shared_path(spark, label)
    with released(spark):
        df.write.option("compression", "zstd").parquet(target)
    back = spark.read.schema(df.schema).parquet(target)
    _stored[back] = _written[-1]
    return back


def discard(df: DataFrame) -> None:
    """Removes what ``store`` wrote for ``df``, which nothing reads any more; other DataFrames are left alone."""
    place = _stored.pop(df, None)
    if place is not None:
        fs, path = place
        fs.delete(path, True)
        _written.remove(place)


def store_counted(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``store``, with aggregates taken on the way, in one job: the reader, and the values by name (0 for null)."""
    seen = Observation()
    back = store(df.observe(seen, *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in measures.items()]), label)
    return back, seen.get


def fixed_width(df: DataFrame) -> bool:
    """Whether no column can hold a value of any length."""
    return all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for f in df.schema.fields)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` allow it and, where a column can hold values of any length,
    their measured ``size`` in characters, too; as it is otherwise."""
    bounded = fixed_width(df) if size is None else size <= BROADCAST_CHARS
    return F.broadcast(df) if rows <= limit and bounded else df


def partitions_for(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for operators that need a fixed number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
