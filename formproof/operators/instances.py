"""Answer/explanation pair instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FormSpec
from ..functions.plan import rows_of
from ..functions.text import is_blank, usable

CONTRADICTIONS = "array<struct<pair_id:string,contradiction_type:string,subtlety:int>>"


def _candidates(df: DataFrame, spec: FormSpec) -> Column:
    """The answered pairs of a record as an array, in contract order."""
    have = set(df.columns)
    items = []
    for i, p in enumerate(spec.pairs):
        if p.structured not in have:
            continue
        value = F.col(p.structured)
        text = F.col(p.free_text) if p.free_text in have else F.lit("")
        items.append(
            F.when(
                ~is_blank(value),
                F.struct(
                    F.lit(i).alias("pair_ord"),
                    F.lit(p.id).alias("pair_id"),
                    F.lit(p.structured).alias("structured_field"),
                    F.lit(p.free_text).alias("free_text_field"),
                    F.lit(p.test).alias("test_id"),
                    value.cast("string").alias("structured_value"),
                    F.coalesce(text, F.lit("")).alias("free_text"),
                    (value == F.lit(p.outside_leaning)).alias("is_outside_leaning"),
                ),
            )
        )
    return F.array_compact(F.array(*items))


def build_unlabelled(df: DataFrame, spec: FormSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """one row per answered pair; what only labelled data knows is 'unknown'.

    Row-local, so it runs unchanged on a stream.
    """
    have = set(df.columns)
    record_id = F.col("record_id") if "record_id" in have else F.lit(None).cast("string")

    def carried(name: str) -> Column:
        base = F.col(name) if name in have else F.lit(None).cast("string")
        return F.coalesce(base, F.lit("unknown")).alias(name)

    kept = [
        F.coalesce(record_id.cast("string"), F.lit("unknown")).alias("record_id"),
        carried("archetype"),
        carried("register"),
        *[F.col(k) for k in keep],
    ]
    return rows_of(df, _candidates(df, spec), kept, "pair_id").withColumns(
        {
            "label": F.lit(0),
            "contradiction_type": F.lit(None).cast("string"),
            "subtlety": F.lit(None).cast("int"),
            "unit_key": F.lit(""),
            "anomaly": F.lit(None).cast("string"),
            "outcome_label": F.lit("unknown"),
        }
    )


def build_labelled(
    records: DataFrame, truth: DataFrame, states: DataFrame, spec: FormSpec
) -> DataFrame:
    """instances with planted truth, anomalies and content-unit keys.

    ``truth``: record_id, archetype, register, outcome_label,
    contradictions array<struct<pair_id, contradiction_type, subtlety, ...>>,
    anomalies array<struct<field_id, kind>>.
    ``states``: record_id, units map<pair_id, unit>.
    The joins happen at record level, before pairs multiply the rows.
    """
    have = [c for c in ("archetype", "register") if c in records.columns]
    wide = (
        records.drop(*have)
        .join(
            truth.select(
                "record_id", "archetype", "register", "outcome_label",
                "contradictions", "anomalies",
            ),
            "record_id",
        )
        .join(states.select("record_id", "units"), "record_id")
    )
    kept = [
        "record_id", "archetype", "register", "outcome_label",
        "contradictions", "anomalies", "units",
    ]
    rows = rows_of(wide, _candidates(wide, spec), kept, "pair_id")

    def last_match(array: str, predicate) -> Column:
        # a later entry for the same key overrides an earlier one
        return F.try_element_at(F.filter(F.col(array), predicate), F.lit(-1))

    planted = last_match("contradictions", lambda c: c["pair_id"] == F.col("pair_id"))
    anomaly = last_match("anomalies", lambda a: a["field_id"] == F.col("free_text_field"))
    return (
        rows.withColumn("_planted", planted)
        .withColumns(
            {
                "label": F.col("_planted").isNotNull().cast("int"),
                "contradiction_type": F.col("_planted.contradiction_type"),
                "subtlety": F.col("_planted.subtlety").cast("int"),
                "unit_key": F.coalesce(
                    F.try_element_at(F.col("units"), F.col("pair_id")), F.lit("")
                ),
                "anomaly": anomaly["kind"],
            }
        )
        .drop("_planted", "contradictions", "anomalies", "units")
    )


def flatten_contradictions(truth: DataFrame) -> DataFrame:
    """one row per planted contradiction."""
    return truth.select("record_id", F.inline("contradictions"))


def flatten_anomalies(truth: DataFrame) -> DataFrame:
    """one row per anomaly."""
    return truth.select("record_id", F.inline("anomalies"))


def instance_summary(instances: DataFrame) -> DataFrame:
    """one row of counts and rates."""
    n = F.count(F.lit(1))
    positives = F.count_if(F.col("label") == 1)
    records = F.countDistinct("record_id")
    has_unit = ~is_blank(F.col("unit_key"))
    return instances.agg(
        n.alias("n_instances"),
        records.alias("n_records"),
        F.countDistinct("pair_id").alias("n_pairs"),
        positives.alias("n_positive"),
        F.round(positives / F.greatest(n, F.lit(1)), 5).alias("positive_rate"),
        F.round(n / F.greatest(records, F.lit(1)), 1).alias("instances_per_record"),
        F.count_if(~is_blank(F.col("anomaly"))).alias("n_anomalous"),
        F.count_if(~usable(F.col("free_text"))).alias("n_unusable_text"),
        F.countDistinct(F.when(has_unit, F.col("unit_key"))).alias("n_distinct_units"),
    )


def positives_by(instances: DataFrame, attribute: str) -> DataFrame:
    """positives per level of an attribute, unset levels left out."""
    return (
        instances.where((F.col("label") == 1) & F.col(attribute).isNotNull())
        .groupBy(F.col(attribute).cast("string").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
