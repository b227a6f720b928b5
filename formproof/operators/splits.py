"""Leakage-aware grouped splits and folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import hashed_rank
from ..functions.text import is_blank

KINDS = ("record", "unit")


def group_key(kind: str) -> Column:
    """L1: what a split keeps together; L5: unknown kinds raise."""
    if kind == "record":
        return F.col("record_id")
    if kind == "unit":
        return F.when(
            is_blank(F.col("unit_key")), F.concat(F.lit("__empty__"), "pair_id")
        ).otherwise(F.col("unit_key"))
    raise ValueError(f"unknown split kind: {kind!r}")


def ranked_groups(instances: DataFrame, kind: str, seed: int) -> DataFrame:
    """L2: groups with a seeded order inside their stratum (positives or none).

    Order is by digest of seed and key: reproducible for any partitioning.
    """
    groups = (
        instances.select(group_key(kind).alias("group_key"), "label")
        .groupBy("group_key")
        .agg((F.max("label") > 0).alias("has_positive"))
        .withColumn("draw", F.md5(F.concat(F.lit(f"{seed}|"), "group_key")))
    )
    return hashed_rank(groups, ["has_positive"], "draw")


def group_holdout(
    instances: DataFrame, kind: str, test_fraction: float = 0.3, seed: int = 20260907
) -> DataFrame:
    """L2: group_key -> split; each stratum gives the same share to test."""
    cut = F.bround(F.col("stratum_size") * F.lit(test_fraction), 0)
    return ranked_groups(instances, kind, seed).select(
        "group_key",
        "has_positive",
        F.when(F.col("rank") <= cut, "test").otherwise("train").alias("split"),
    )


def make_split(
    instances: DataFrame, kind: str = "record", test_fraction: float = 0.3, seed: int = 20260907
) -> DataFrame:
    """Instances with a ``split`` column, whole groups on one side."""
    sides = group_holdout(instances, kind, test_fraction, seed).drop("has_positive")
    return (
        instances.withColumn("group_key", group_key(kind))
        .join(sides, "group_key")
        .drop("group_key")
    )


def split_summary(split: DataFrame) -> DataFrame:
    """Sizes, positives, records, and units present on both sides."""
    def side(name: str) -> Column:
        return F.col("split") == name

    train, test = side("train"), side("test")
    sizes = split.agg(
        F.count_if(train).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.sum(F.when(train, F.col("label")).otherwise(0)).alias("train_positives"),
        F.sum(F.when(test, F.col("label")).otherwise(0)).alias("test_positives"),
        F.countDistinct(F.when(train, F.col("record_id"))).alias("train_records"),
        F.countDistinct(F.when(test, F.col("record_id"))).alias("test_records"),
    )
    shared = (
        split.groupBy("unit_key")
        .agg(F.max(train).alias("a"), F.max(test).alias("b"))
        .agg(F.count_if(F.col("a") & F.col("b")).alias("shared_units"))
    )
    rate = F.round(F.col("test_positives") / F.greatest(F.col("n_test"), F.lit(1)), 5)
    return sizes.withColumns(
        {"test_positive_rate": rate, "shared_units": shared.scalar()}
    )


def fold_of_groups(
    instances: DataFrame, kind: str = "record", n_folds: int = 5, seed: int = 20260907
) -> DataFrame:
    """group_key -> fold, dealt in turn inside each stratum."""
    return ranked_groups(instances, kind, seed).select(
        "group_key",
        "has_positive",
        ((F.col("rank") - 1) % F.lit(n_folds)).cast("int").alias("fold"),
    )


def with_folds(
    instances: DataFrame, kind: str = "record", n_folds: int = 5, seed: int = 20260907
) -> DataFrame:
    """Instances with a ``fold`` column."""
    folds = fold_of_groups(instances, kind, n_folds, seed).drop("has_positive")
    return (
        instances.withColumn("group_key", group_key(kind)).join(folds, "group_key")
        .drop("group_key")
    )


def cross_val_scores(
    folded: DataFrame,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    n_folds: int = 5,
) -> DataFrame:
    """A score for every instance from a model that never saw its group.

    ``fit(train)`` returns a scoring function.  A method with nothing to fit
    gives ``score`` instead and runs once over the whole table.
    """
    if fit is None:
        if score is None:
            raise ValueError("either fit or score is needed")
        return score(folded)
    parts = []
    for k in range(n_folds):
        model = fit(folded.where(F.col("fold") != k))
        parts.append(model(folded.where(F.col("fold") == k)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_metadata(scored: DataFrame) -> DataFrame:
    """What a scoring run looks like, without any content."""
    return scored.agg(
        F.round(F.avg("score"), 5).alias("mean_score"),
        F.count_if(F.col("score") > 0).alias("nonzero_scores"),
    )


def fold_positives(folded: DataFrame) -> DataFrame:
    """Positives held out per fold, so an empty fold is visible."""
    return folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")
    )
