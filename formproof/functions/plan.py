"""Plan-level helpers: evaluate costly columns once, keep small scans parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions are evaluated exactly once per row.

    A filter over a projected column is pushed below the projection by copying
    the column's expression into it, so a costly expression would run again for
    every use in the filter.  Columns that leave a generator are not copied.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(packed))


def rows_of(df: DataFrame, array: Column | str, keep: Sequence[str | Column], key: str) -> DataFrame:
    """One row per element of an array of structs; ``key`` is a never-null field.

    The outer form is used because the plain one adds a filter on the array's
    size, which would evaluate the array a second time.
    """
    return df.select(*keep, F.inline_outer(array)).where(F.col(key).isNotNull())


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer partitions than cores one partition per core.

    A table in one small file would otherwise be worked on by a single task.
    Large tables have enough splits and are returned untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
