"""Small helpers the operators share: row keys, checkpoints, key columns."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the blank and the ASCII controls from tab to carriage return.
ASCII_BLANKS = " \t\n\x0b\x0c\r"

#: A side with at most this many narrow rows (ids or hashes) may be broadcast: 16 bytes each, 16 MB.
BROADCAST_ROWS = 1_000_000


#: Rows in one Arrow batch: a document is some kilobytes, and Spark's 10,000 rows are for numbers.
BATCH_ROWS = 1000

_shipped: set[str] = set()


def _own_folder(prefix: str) -> str:
    """A temporary folder of the driver that goes with it."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would; once for each application.

    Where the session leaves Spark's default, Arrow batches get `BATCH_ROWS` rows,
    which keeps both the executor's and its workers' memory small.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    archive = shutil.make_archive(os.path.join(_own_folder("package-"), name), "zip", os.path.dirname(package), name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def release_memory() -> None:
    """Give freed memory of this process back to the system.

    Python workers live on from stage to stage, and what one stage freed counts as
    the executor's until another happens to use it.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A function of batches for ``mapInArrow`` that releases memory when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as the context's.

    Only a local master without that setting, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = _own_folder("checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor costs a read, not a second run."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within this block a query's shuffle files are deleted when it ends, not once the driver collects its garbage.

    For queries whose results are kept elsewhere, as checkpoints or in the driver; one that is run
    again writes its files again. DataFrames made after the block are not concerned.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def within_bound(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``rows`` rows.

    Give it a checkpointed table of narrow rows. Beyond the bound Spark joins by shuffle.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hashed_sample(df: DataFrame, by: Column, rows: int, total: int | None = None) -> DataFrame:
    """The ``rows`` rows with the smallest value of a 64-bit hash, or all if there are fewer.

    Rows over twice the share that is needed are left out first, so that tasks
    offer a few rows each and the driver compares as many at any size.
    """
    total = df.count() if total is None else total
    share = min(1.0, 2.0 * rows / max(1, total) + 100 / max(1, total))
    return df.where(by <= int((share - 0.5) * (2**64 - 2**12))).orderBy(by).limit(rows)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which a cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; other letters stay."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has it (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, also if it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
