"""Helpers that several operators share: shared folders, size-checked broadcasts, per-process caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many estimated bytes may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
#: Rows go to Python workers in batches of about this many bytes at most, where the session sets no limit of its own.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; a session that has ended leaves it."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def stored(df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, and lost executors lose nothing.

    hashes: the columns are mostly hashes, which neither dictionaries nor compression make smaller.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("parquet.enable.dictionary", "false").option("compression", "none") if hashes else df.write
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def settled(df: DataFrame, name: str) -> DataFrame:
    """df itself if no shuffle makes it, so that a task that runs again has the same rows in the same order; else df stored."""
    return stored(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    remove_path(df.sparkSession, df.stored_at)


def small_enough(df: DataFrame, row_bytes: int, more=None) -> bool:
    """Whether a stored table is small enough to be broadcast, by its rows and what `more` adds for each."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(0) if more is None else more), F.lit(0)).alias("more")).first()
    return found["n"] * row_bytes + found["more"] <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, row_bytes: int, more=None) -> DataFrame:
    """df with a broadcast hint if its counted rows are small enough, else a shuffled hash join's build side.

    more: bytes that a row has beside row_bytes, as a column, where that is not the same for all.
    """
    return F.broadcast(df) if small_enough(df, row_bytes, more) else df.hint("shuffle_hash")


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks, until a cache of another name is asked for.

    So a worker that serves several operators in turn holds the tables of one.
    """
    home = sys.modules.setdefault("_strandloom_cache", types.ModuleType("_strandloom_cache")).__dict__
    if home.get("name") != name:
        others = home.get("name") is not None
        home["name"], home["cache"] = name, {}
        if others:
            gc.collect()
            release_memory()
    return home["cache"]


def small_batches(spark: SparkSession) -> None:
    """Limits the bytes of the session's Arrow batches, which else are 10,000 rows of any size, held by JVM and worker at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release_memory() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, cache: str = ""):
    """run, a function of batches, that gives freed memory back when its task ends: workers that wait for the next one hold little.

    cache: the name of the process cache that run uses; what other operators left in the worker is dropped first.
    """

    def whole(batches):
        process_cache(cache)
        yield from run(batches)
        release_memory()

    return whole


def split_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most about most_bytes in a string or binary column (a longer value stands alone)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        for k in range(len(values)):
            n = values[k].as_buffer().size if values[k].is_valid else 0
            if size and size + n > most_bytes:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        if start < len(values):
            yield batch.slice(start)
