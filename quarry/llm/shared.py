"""The shared folder of a cluster, tables written to cut lineage, and files that tasks write there."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import free_name


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local master may leave it unset (tests): it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later plans start from the files, and
    a lost executor costs no recomputation of what went before."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that a Python worker is given at once.
TEXT_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lowers the session's Arrow batches to ``rows``, so that a worker never holds many whole texts; smaller settings
    stay. For results that are not written here: the setting has to hold until they are."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """``text_batches`` for what is written inside the block; the session's own setting comes back after it."""
    before = spark.conf.get(_BATCH)
    text_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system. Workers live on, and later stages need it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


#: A key with more than this share of the rows is spread over several tasks when they are joined to a table.
HOT_SHARE = 1 / 64


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` and the one row of ``table`` for each key (null included); ``n`` of ``table`` says how many of ``total`` rows have the key.

    Hot keys, of which there are fewer than 64, are known to every task: their rows are dealt by the hash
    of ``by`` to several tasks, each of which gets the key's row of ``table`` too. ``n`` is left out.
    """
    hot_key, parts, salt, own = (free_name(rows, c, table) for c in ("q_hot", "q_parts", "q_salt", "q_key"))
    cells = F.ceil(F.col(n) / F.lit(max(1, total)) / F.lit(HOT_SHARE) * 2).cast("int")
    sized = table.withColumn(parts, F.when(F.col(n) > total * HOT_SHARE, cells).otherwise(1))
    hot = F.broadcast(sized.filter(F.col(parts) > 1).select(F.col(key).alias(hot_key), parts))
    dealt = rows.join(hot, rows[key].eqNullSafe(hot[hot_key]), "left").withColumn(salt, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1)).cast("long")).cast("int")).drop(hot_key, parts)
    copied = sized.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).withColumnRenamed(key, own).drop(parts, n)
    return dealt.join(copied, dealt[key].eqNullSafe(copied[own]) & (dealt[salt] == copied[salt]), how).drop(copied[salt]).drop(salt, own)


#: Tables of at most this many rows are joined as they are: one task can take them whole.
FEW_ROWS = 200_000


def skew_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", by: str | None = None) -> DataFrame:
    """``rows`` and the one row of ``table`` for each key, with hot keys spread by ``by`` (the key itself where keys do not repeat).

    The keys of ``rows`` are counted where both tables are written ones; small tables are joined as they are.
    """
    if by is None:
        return rows.join(table, key, how)
    total = rows.count()
    if total <= FEW_ROWS:
        return rows.join(table, key, how)
    n = free_name(rows, "q_n", table)
    counts = rows.groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) > total * HOT_SHARE)
    sized = table.join(F.broadcast(counts), key, "left").withColumn(n, F.coalesce(n, F.lit(0)))  # fewer than 64 keys
    return spread_join(rows, sized, key, n, total, F.col(by), how)


def task_files(uri: str):
    """(filesystem, path) through pyarrow, for tasks that read or write files in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
