"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words (fixed values).
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The same set as a regular-expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"


#: Called to free what a worker keeps from one task to the next.
WORKER_CACHES: list[Callable[[], None]] = []


def release() -> None:
    """Workers are reused: an operator that needs memory of its own frees the caches that another one left."""
    for free in WORKER_CACHES:
        free()


def trim() -> None:
    """Gives freed memory of this process back to the system, where the C library has a way."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def release_heap(spark: SparkSession) -> None:
    """Executors collect their garbage and give the heap that earlier work took, and no longer needs, back to the system.

    One task for each executor, which the scheduler deals round them where they
    are idle; one that is left out by chance only keeps its heap. What is
    cached or broadcast stays.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: Rows of a batch of whole texts. Spark's own 10,000 take tens of MB, which the executor and its Python worker each hold more than once.
TEXT_ROWS = 1024


@contextmanager
def short_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What runs inside sends Python at most ``rows`` rows at once, or fewer where the session says so; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, now = spark.conf.get(key, None), int(spark.conf.get(key))
    spark.conf.set(key, min(rows, now) if now > 0 else rows)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on this machine alone (as in tests) gets a temporary folder
    where it has none; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quernel-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of whatever file system it is on."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def clean(spark: SparkSession) -> None:
    """Removes all tables that operators left in the shared folder; results that were not written yet are lost with them."""
    delete(spark, _own_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    This cuts the lineage: a lost executor later costs a reread of files, not
    a rerun of what came before.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The stored table and its path, for a caller that removes it when it is used up."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A projection can be merged into the next one, and a lambda would then
    compute its free expressions for each element. A lambda's own variable is
    bound, so the value goes through an array of one element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space, in order."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
