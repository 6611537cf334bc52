"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and return it with its lineage cut.

    The folder is the one of spark.checkpoint.dir.  Where none is configured it is a folder
    of its own in a local session, as in tests, and one in the warehouse on a cluster,
    whose machines share that.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        local = context.master == "local" or context.master.startswith("local[")
        own = tempfile.mkdtemp(prefix="inkloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return to the system what a task has freed: workers live on and take tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidied(run, forget=None):
    """A function of batches that gives memory back as its task ends; forget empties what its module holds."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return wrapped


def drawn(rows: DataFrame, share, seed: int, text: str = "text", longest: int = 200_000, by: tuple[str, ...] = ()) -> DataFrame:
    """About that share (a number or a column) of the distinct texts of rows, for training on the driver.

    Drawn by a hash of the text, each (text, `by`) once, and none of more than `longest`
    characters.  The share is of all rows, so that repeated rows make what is drawn
    smaller, never larger.
    """
    draw = F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where((draw < share) & (F.length(text) <= longest)).dropDuplicates([text, *by])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_slices(batches, column: str, most_bytes: int = 8 << 20):
    """Arrow batches cut further so that `column` holds about most_bytes in each (a single row may hold more)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = max(1, batch.column(column).nbytes)
        step = max(1, int(rows * most_bytes / size))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bounded_hash(column, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets))
