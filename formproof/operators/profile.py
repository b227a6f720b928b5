"""Profiling of a labelled corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import FormSpec
from ..functions.text import is_blank


def distributions(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Counts and shares of several attributes in one pass.

    The counts come from one aggregation; shares are taken on its small result.
    """
    pairs = F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level"))
        for a in attributes
    ])
    counts = (
        df.select(F.inline(pairs)).where(F.col("level").isNotNull())
        .groupBy("attribute", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "attribute").select(
        "attribute", "level", "n", (F.col("n") / F.col("_total")).alias("share")
    )


def share_matrix(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """R2: per row level, its size and the share of each column level."""
    return df.groupBy(row).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            (F.count_if(F.col(column) == F.lit(v)) / F.count(F.lit(1))).alias(f"share_{v}")
            for v in levels
        ],
    )


def text_lengths(df: DataFrame, spec: FormSpec) -> DataFrame:
    """Median, 95th percentile element and maximum of the text lengths.

    Lengths repeat heavily, so they are counted first; the two order statistics
    are then read from running counts over the distinct lengths, whose number is
    bounded by the longest text rather than by the rows.
    """
    from ..functions.ranking import running_sums

    have = set(df.columns)
    cols = [f.id for f in spec.of_type("free_text") if f.id in have]
    boxes = F.filter(F.array(*[F.col(c) for c in cols]), lambda t: ~is_blank(t))
    sizes = (
        df.select(F.explode(F.transform(boxes, lambda t: F.length(t))).alias("size"))
        .groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    )
    steps = running_sums(
        sizes, [], F.floor(F.col("size") / 1024), "size", {"n": "from_top"}, {"n": "total"}
    )
    below = F.col("total") - F.col("from_top")  # values strictly smaller

    def element(index):
        here = (below <= index) & (index < below + F.col("n"))
        return F.max(F.when(here, F.col("size")))

    lower = F.floor((F.col("total") - 1) / 2)
    upper = F.floor(F.col("total") / 2)
    p95 = F.floor(F.col("total") * 0.95)
    return steps.agg(
        F.floor((element(lower) + element(upper)) / 2).cast("long").alias("median_chars"),
        element(p95).cast("long").alias("p95_chars"),
        F.max("size").cast("long").alias("max_chars"),
        F.max("total").alias("n_texts"),
    )


def acceptance(measures: DataFrame, targets: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Measured rates against their target ranges.

    ``measures`` is one row with a column per measure.
    """
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("measure"), F.lit(float(lo)).alias("low"),
            F.lit(float(hi)).alias("high"), F.col(name).cast("double").alias("actual"),
        )
        for name, (lo, hi) in targets.items()
    ])
    return measures.select(F.inline(rows)).withColumn(
        "verdict",
        F.when(F.col("actual").between(F.col("low"), F.col("high")), "PASS").otherwise(
            "OUT OF RANGE"
        ),
    )


def coverage(contradictions: DataFrame, n_pairs: int, undermining: str) -> DataFrame:
    """Undermining contradictions, and pairs hit out of all pairs."""
    return contradictions.agg(
        F.count(F.lit(1)).alias("n_contradictions"),
        F.count_if(F.col(undermining)).alias("n_undermining"),
        F.countDistinct("pair_id").alias("pairs_hit"),
        F.lit(n_pairs).alias("n_pairs"),
    )


def pipeline_check(assessed: DataFrame) -> DataFrame:
    """One row on validity, warnings and removed entities.

    Needs the columns of ``validate`` and ``deidentify``.
    """
    warnings = F.size(F.filter("findings", lambda f: f["severity"] == "warning"))
    return assessed.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("is_valid").alias("n_valid"),
        F.avg(F.col("is_valid").cast("double")).alias("valid_share"),
        F.sum(warnings).alias("n_warnings"),
        F.sum("deid.total_entities").alias("n_entities"),
        F.count_if(F.col("deid.total_entities") > 0).alias("records_with_entities"),
    )
