"""Helpers the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formproof.session import scratch_dir

#: The white space of the contracts, `[\x20\x09-\x0D]`.
WHITE = " \t\n\u000b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where `written` notes its tables, while `noted` is in force.
_NOTES: list[list[str]] = []


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Note in paths the tables that `written` makes meanwhile."""
    _NOTES.append(paths)
    try:
        yield
    finally:
        _NOTES.pop()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of df from a Parquet table in shared storage: evaluated once, without lineage."""
    path = scratch_dir(df.sparkSession, purpose)
    if _NOTES:
        _NOTES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(paths: Iterable[str], spark: SparkSession) -> None:
    """Delete folders in shared storage; those gone already are passed over."""
    for place in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(*tables: DataFrame, spark: SparkSession) -> None:
    """Delete tables that `written` made and nothing reads any more, and let Spark drop shuffle files of finished steps."""
    for df in tables:
        deleted({f.rpartition("/")[0] for f in df.inputFiles()[:1]}, spark)
    gc.collect()
    spark._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    out = values.astype(np.uint64, copy=True)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out
