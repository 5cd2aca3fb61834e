"""What the corpus operators share: reading, bounded Arrow batches, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than ASCII white space, exactly what bytes.split() separates.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

#: Text that is handled in one go inside a batch.
CHUNK_BYTES = 2 << 20

_cache: list = [None, None]


def trim() -> None:
    """Gives memory that is free inside the process back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def only_cache(name: str, make: Callable[[], object]):
    """A worker's cache of a name, kept from task to task; a worker that is reused for another operator drops the former's."""
    if _cache[0] != name:
        _cache[:] = name, None  # the old one goes before the new one is made
        trim()
        _cache[1] = make()
    return _cache[1]


def drop_cache() -> None:
    """For stages without a cache: a worker that is reused gives up what another operator left."""
    only_cache("", lambda: None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """read(), dealt out row by row if the files have fewer row groups than the cluster has cores.

    The look at the partitions reads no column. What moves is at most one row group a
    core; larger tables have row groups enough and stay where they are.
    """
    df = read(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    busy = df.groupBy(F.spark_partition_id().alias("p")).count().count()
    return df if busy >= cores else df.repartition(cores)


def doc_id() -> Column:
    """The doc_id as a long; one that is no number is null."""
    return F.col("doc_id").try_cast("long").alias("doc_id")


def prepare(spark: SparkSession) -> None:
    """Before a Python stage: this package goes to the workers, and long texts must not meet by the ten thousand in one batch.

    The two batch limits stay set in the session: results are lazy, and a plan reads them when it runs.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        zipped = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(zipped))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where it names none and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage is cut, later scans prune columns.

    The files go when forget() is told to, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def forget(*tables: DataFrame) -> None:
    """Deletes what table() wrote, once nothing that is still to run reads it.

    Shuffle files and checkpoints of frames that are gone stay until the driver's JVM collects
    garbage, which with a large heap it may not do for hours; so it is asked to.
    """
    for df in tables:
        fs, where = _place(df.sparkSession, df.scratch_path)
        fs.delete(where, True)
    trim()
    tables[0].sparkSession._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; Spark deletes its files once nothing refers to it."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def with_text(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns and the text; a text that is not a string is cast."""
    return df.select(*columns, F.col("text").cast("string").alias("text"))


def chunks(texts: list[bytes | None], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of neighbouring texts of about `most` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def per_chunk(f: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | None], most: int = CHUNK_BYTES):
    """Turns f(rows, their texts as UTF-8) into a function for mapInArrow that sees a bounded amount of text at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for s in chunks(texts, most):
                out = f(batch.slice(s.start, s.stop - s.start), texts[s])
                if out is not None and out.num_rows:
                    yield out
        trim()  # the worker may idle, or turn to another operator, beside others that need memory

    return run


def flat(lists) -> list:
    return list(itertools.chain.from_iterable(lists))
