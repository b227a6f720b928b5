"""Calibration and cluster-bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .metrics import COHORTS


def bin_edges(n_bins: int) -> list[float]:
    """Equal-width edges as i * (1/n), the spacing a linear grid gives."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_number(value: Column, n_bins: int) -> Column:
    """O1: index of the bin; edges are compared, never computed from the value."""
    out: Column = F.lit(0)
    for i, edge in enumerate(bin_edges(n_bins)[1:-1], start=1):
        out = F.when(value >= F.lit(edge), F.lit(i)).otherwise(out)
    return out


def reliability_bins(
    scored: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, min_bin_count: int = 20
) -> DataFrame:
    """O1: mean score and observed rate per occupied bin; ``kept`` marks the curve."""
    value = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return (
        scored.withColumn("bin", bin_number(value, n_bins))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("predicted"),
            F.avg("label").alias("observed"),
            F.sum("label").alias("positives"),
            F.sum(F.pow(value - F.col("label"), 2)).alias("sq_error"),
        )
        .withColumn("kept", F.col("n") >= min_bin_count)
    )


def calibration(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """O2, O3: ECE and MCE over kept bins; Brier parts over every occupied bin."""
    gap = F.abs(F.col("predicted") - F.col("observed"))
    n = F.col("n")
    kept = F.col("kept")
    # sum n(o-b)^2 = sum n o^2 - N b^2, so one aggregation is enough
    total = F.sum("n")
    base = F.sum("positives") / total
    return bins.groupBy(*keys).agg(
        F.coalesce(
            F.sum(F.when(kept, n * gap)) / F.sum(F.when(kept, n)), F.lit(0.0)
        ).alias("ece"),
        F.coalesce(F.max(F.when(kept, gap)), F.lit(0.0)).alias("mce"),
        (F.sum("sq_error") / total).alias("brier"),
        (F.sum(n * F.pow(gap, 2)) / total).alias("reliability"),
        (F.sum(n * F.pow(F.col("observed"), 2)) / total - base * base).alias("resolution"),
        (base * (1.0 - base)).alias("uncertainty"),
        total.alias("n_scored"),
    )


def poisson_edges(top: int = 13) -> list[float]:
    """Cumulative probabilities of Poisson(1): the count for a draw u is how many of them are <= u.

    Counts above 12 are less likely than one step of a 32-bit draw.
    """
    p, cumulative, edges = 2.718281828459045 ** -1, 0.0, []
    for k in range(top):
        cumulative += p
        edges.append(cumulative)
        p /= k + 1
    return edges


def multiplicities(record_id: str, n_boot: int, seed: int) -> np.ndarray:
    """How often a record enters each replicate; one digest feeds four replicates."""
    digests = b"".join(
        md5(f"{seed}|{record_id}|{block}".encode()).digest() for block in range((n_boot + 3) // 4)
    )
    u = np.frombuffer(digests, dtype=">u4")[:n_boot] / 4294967295.0
    return np.searchsorted(poisson_edges(), u, side="right")


#: Keys whose sums a task holds before it sends them on.
_HELD = 1024


def _resampled(per_record: DataFrame, keys: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """keys, tp, pos: arrays with a sum for each replicate over the records of a part of the rows."""
    keys = list(keys)
    schema = T.StructType([
        *[per_record.schema[k] for k in keys],
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("tp", "pos")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        last, drawn = None, None

        def sent() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate(types)]
            for side in range(2):
                columns.append(pa.array([s[side] for s in sums.values()], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            types = [c.type for c in batch.columns[3:]]
            for record, tp, pos, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if drawn is None or record != last:
                    last, drawn = record, multiplicities(record or "", n_boot, seed)
                if (key := tuple(key)) not in sums:
                    if len(sums) >= _HELD:
                        yield sent()
                        sums.clear()
                    sums[key] = np.zeros((2, n_boot), dtype=np.int64)
                sums[key] += drawn * np.array([[tp], [pos]])
        if sums:
            yield sent()

    # a record's rows come one after another, so that its draws are made once for all keys
    rows = per_record.where(F.col("pos") > 0).select("record_id", "tp", "pos", *keys)
    return rows.sortWithinPartitions("record_id").mapInArrow(run, schema)


def bootstrap_replicates(
    per_record: DataFrame, keys: Sequence[str], n_boot: int, seed: int
) -> DataFrame:
    """Recall per replicate, records drawn whole.

    ``per_record``: keys, record_id, tp, pos, the rows of a record in one
    partition.  A record enters a replicate with a Poisson(1) multiplicity read
    from a digest of (seed, record, replicate): the large-n form of drawing
    records with replacement.  It needs no global record index, repeats exactly
    on any cluster, and a record without positives cannot change a recall, so
    only records with positives are drawn.  A task adds up what its records
    say, so the shuffle carries at most n_boot rows per task and key.
    """
    parts = _resampled(per_record, keys, n_boot, seed)
    rows = parts.select(*keys, F.posexplode(F.arrays_zip("tp", "pos")).alias("replicate", "_s"))
    return (
        rows.groupBy(*keys, "replicate")
        .agg(F.sum("_s.tp").alias("tp"), F.sum("_s.pos").alias("pos"))
        .where(F.col("pos") > 0)
        .select(*keys, "replicate", (F.col("tp") / F.col("pos")).alias("recall"))
    )


def _records(scored: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """keys, record_id, tp, pos; all rows of a record lie in one partition."""
    positive = F.col("label") == 1
    caught = positive & (F.col("score") >= F.lit(float(threshold)))
    told = scored.select(*keys, "record_id", positive.alias("_pos"), caught.alias("_tp"))
    # a number of partitions that stays: few bytes make much work here
    cores = scored.sparkSession.sparkContext.defaultParallelism
    return told.repartition(cores, "record_id").groupBy(*keys, "record_id").agg(
        F.count_if("_tp").alias("tp"), F.count_if("_pos").alias("pos")
    )


def _interval(replicates: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    bounds = F.percentile("recall", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return (
        replicates.groupBy(*keys).agg(bounds.alias("_q"))
        .select(*keys, F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))
    )


def bootstrap_recall(
    scored: DataFrame,
    threshold: float,
    keys: Sequence[str] = (),
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 20260907,
) -> DataFrame:
    """Overall recall with its interval; (0, 1) where there is no positive."""
    keys = list(keys)
    per_record = _records(scored, threshold, keys)
    overall = per_record.groupBy(*keys).agg(
        F.sum("pos").alias("n"), F.sum("tp").alias("caught")
    )
    spread = _interval(bootstrap_replicates(per_record, keys, n_boot, seed), keys, alpha)
    if keys:
        joined = overall.join(spread, keys, "left")
    else:
        joined = overall.withColumns(
            {"low": spread.select("low").scalar(), "high": spread.select("high").scalar()}
        )
    return joined.select(
        *keys, "n", "caught",
        F.when(F.col("n") > 0, F.col("caught") / F.col("n")).otherwise(0.0).alias("recall"),
        F.coalesce("low", F.lit(0.0)).alias("low"),
        F.coalesce("high", F.lit(1.0)).alias("high"),
    )


def recall_with_intervals(
    scored: DataFrame,
    threshold: float,
    keys: Sequence[str] = (),
    attributes: Sequence[str] = COHORTS,
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 20260907,
) -> DataFrame:
    """Recall per level, resampling only the records of that level."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level"))
        for a in attributes
    ])
    levels = (
        scored.where(F.col("label") == 1)
        .select(*keys, "record_id", "label", "score", F.inline(pairs))
        .where(F.col("level").isNotNull())
    )
    rows = bootstrap_recall(
        levels, threshold, [*keys, "attribute", "level"], n_boot, alpha, seed
    )
    return rows.withColumn("interval_width", F.col("high") - F.col("low"))


def group_gap(intervals: DataFrame, keys: Sequence[str] = ("attribute",)) -> DataFrame:
    """Worst and best level per attribute, and whether their intervals meet."""
    row = F.struct("level", "recall", "low", "high")
    worst = F.min_by(row, F.struct(F.col("recall"), F.col("level")))
    # of equally good levels the last in name order is the best
    best = F.max_by(row, F.struct(F.col("recall"), F.col("level")))
    return (
        intervals.groupBy(*keys)
        .agg(worst.alias("w"), best.alias("b"))
        .select(
            *keys,
            F.col("w.level").alias("worst_level"), F.col("w.recall").alias("worst_recall"),
            F.col("b.level").alias("best_level"), F.col("b.recall").alias("best_recall"),
            (F.col("b.recall") - F.col("w.recall")).alias("gap"),
            (F.col("w.high") >= F.col("b.low")).alias("overlap"),
        )
    )
