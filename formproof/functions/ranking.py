"""Exact global ranks and running sums without a one-partition window.

A window over a whole table runs in one task.  Here rows are first cut into
buckets whose order is known (a prefix of a hash, or a monotone function of
the sort value).  A small per-bucket table gives every bucket its starting
value; the window then runs inside buckets only, and the two are added.  The
bucket table has a fixed maximum size per key, whatever the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hashed_rank(
    df: DataFrame,
    strata: Sequence[str],
    order_key: str,
    *,
    out: str = "rank",
    total: str = "stratum_size",
    bucket_digits: int = 3,
) -> DataFrame:
    """Rank rows 1..n per stratum by a uniform lower-case hex string column.

    The first ``bucket_digits`` hex characters are the bucket, so a stratum
    spreads evenly over 16**bucket_digits buckets, whatever its size.
    """
    bucketed = df.withColumn("_bucket", F.substring(order_key, 1, bucket_digits))
    keys = list(strata)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(
                whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
        F.sum("_n").over(whole).alias(total),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order_key)
    # at most strata x 16**bucket_digits rows: a proven broadcast bound
    joined = bucketed.join(F.broadcast(offsets), [*keys, "_bucket"])
    ranked = joined.withColumn(out, F.col("_before") + F.row_number().over(inside))
    return ranked.drop("_bucket", "_before")


def next_in_group(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, per_bucket: int = 256
) -> DataFrame:
    """Add the value of the next row (by an integer ``order``) of the same group.

    A group of any size is cut into buckets of the order column; only the first
    row of each bucket takes part in a window over the whole group.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(per_bucket)))
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    along = W.partitionBy(*keys).orderBy("_bucket")
    heads = bucketed.groupBy(*keys, "_bucket").agg(F.min_by(value, order).alias("_head"))
    follow = heads.select(*keys, "_bucket", F.lead("_head").over(along).alias("_follow"))
    near = bucketed.withColumns(
        {"_near": F.lead(value).over(inside), "_end": F.lead(order).over(inside).isNull()}
    )
    return (
        near.join(follow, [*keys, "_bucket"], "left")
        .withColumn(out, F.when(F.col("_end"), F.col("_follow")).otherwise(F.col("_near")))
        .drop("_bucket", "_near", "_end", "_follow")
    )


def score_bucket(score: Column, per_unit: int = 256) -> Column:
    """A monotone bucket number for scores in [0, 1], fine near both ends.

    Scores crowd near 0 (or near 1), so the bucket is logarithmic towards the
    nearer end.  The number of buckets is fixed by ``per_unit``.
    """
    tiny = F.lit(1e-13)
    low = F.floor(F.log(F.greatest(score, tiny)) * per_unit)
    high = -F.floor(F.log(F.greatest(F.lit(1.0) - score, tiny)) * per_unit)
    shift = 2 * 31 * per_unit
    return F.when(score <= 0.5, low - F.lit(shift)).otherwise(high).cast("long")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order_by: str,
    sums: dict[str, str],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Descending inclusive running sums of ``sums`` (column -> output name).

    ``bucket`` must not decrease when ``order_by`` grows.  ``totals`` adds the
    per-key grand total of a column under the given name.
    """
    keys = list(keys)
    totals = totals or {}
    bucketed = df.withColumn("_bucket", bucket)
    needed = sorted({*sums, *totals})
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_b_{c}") for c in needed]
    )
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    above = whole.orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_b_{c}").over(above), F.lit(0)).alias(f"_o_{c}")
            for c in sums
        ],
        *[F.sum(f"_b_{c}").over(whole).alias(name) for c, name in totals.items()],
    )
    inside = (
        W.partitionBy(*keys, "_bucket")
        .orderBy(F.col(order_by).desc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    joined = bucketed.join(F.broadcast(offsets), [*keys, "_bucket"])
    return joined.withColumns(
        {name: F.col(f"_o_{c}") + F.sum(c).over(inside) for c, name in sums.items()}
    ).drop("_bucket", *[f"_o_{c}" for c in sums])
