"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship_package as ship_package
from tidemark.storage import work_folder as work_folder

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that at its task's end gives back what memory it no longer uses: Python workers live on."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns under new names: pick(df, id="doc_id").

    Columns are found by exact name, the first of several; others may clash in any way.
    """
    names = df.columns
    missing = [c for c in columns.values() if c not in names]
    if missing:
        raise ValueError(f"no column {missing} in {names}")
    plain = df.toDF(*(f"_c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"_c{names.index(c)}").alias(alias) for alias, c in columns.items()))


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in a shared folder: it cuts the lineage and outlives lost executors."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete written tables that nothing reads any more: all that was made of them has been written too."""
    context = spark.sparkContext
    for name in names:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
