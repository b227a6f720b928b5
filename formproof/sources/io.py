"""Readers and writers for corpora, submissions and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import FormSpec

TRUTH_SCHEMA = (
    "record_id string, seed bigint, archetype string, register string, dataset_version string, "
    "outcome_label string, is_ambiguous_by_design boolean, n_contradictions int, "
    "has_contradiction boolean, "
    "contradictions array<struct<pair_id:string,structured_field:string,free_text_field:string,"
    "test_id:string,structured_value:string,contradiction_type:string,subtlety:int,"
    "undermines_outside_leaning:boolean,clean_unit:string,planted_unit:string>>, "
    "anomalies array<struct<field_id:string,kind:string>>, contradiction_pairs array<string>"
)
STATE_SCHEMA = (
    "record_id string, archetype string, register string, answers map<string,string>, "
    "reachable array<string>, units map<string,string>"
)
DECISION_SCHEMA = (
    "decision_id string, record_id string, pair_id string, field_id string, method string, "
    "score double, band_label string, decision string, reviewer_id string, "
    "timestamp_utc string, reason_digest struct<sha256:string,chars:int>, reason_logged boolean"
)
BOOKKEEPING = ("record_id", "archetype", "register", "dataset_version")


def record_schema(spec: FormSpec) -> T.StructType:
    names = [*BOOKKEEPING, *[f.id for f in spec.fields]]
    return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A1: JSON lines with a declared schema; nothing is inferred.

    Blank lines are skipped, a missing path is an error, a malformed line fails
    the read instead of turning into nulls.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def misaligned(records: DataFrame, truth: DataFrame, states: DataFrame) -> DataFrame:
    """A2: record ids whose number of rows differs between the three tables."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("record_id").agg(F.count(F.lit(1)).alias(name))

    tagged = (
        records.select("record_id", F.lit(1).alias("r"), F.lit(0).alias("t"), F.lit(0).alias("s"))
        .unionByName(
            truth.select("record_id", F.lit(0).alias("r"), F.lit(1).alias("t"), F.lit(0).alias("s"))
        )
        .unionByName(
            states.select("record_id", F.lit(0).alias("r"), F.lit(0).alias("t"), F.lit(1).alias("s"))
        )
    )
    counts = tagged.groupBy("record_id").agg(
        F.sum("r").alias("n_records"), F.sum("t").alias("n_truth"), F.sum("s").alias("n_states")
    )
    return counts.where((F.col("n_records") != F.col("n_truth"))
                        | (F.col("n_records") != F.col("n_states")))


def require_aligned(records: DataFrame, truth: DataFrame, states: DataFrame) -> None:
    """A2: raise when the corpus tables disagree."""
    bad = misaligned(records, truth, states).limit(5).collect()
    if bad:
        raise ValueError(f"corpus tables disagree on: {[r.record_id for r in bad]}")


def load_corpus(
    spark: SparkSession, spec: FormSpec, records: str, truth: str, states: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A1, A2: the three corpus tables, checked against each other."""
    frames = (
        read_jsonl(spark, records, record_schema(spec)),
        read_jsonl(spark, truth, TRUTH_SCHEMA),
        read_jsonl(spark, states, STATE_SCHEMA),
    )
    require_aligned(*frames)
    return frames


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A3: JSON lines with keys in name order; absent answers are left out."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def append_decisions(stored: DataFrame, path: str) -> None:
    """A5: add rows to the log, partitioned by day so readers can prune."""
    day = F.to_date(F.to_timestamp("timestamp_utc"))
    stored.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """A5: every decision, oldest first."""
    return spark.read.parquet(path).orderBy("timestamp_utc", "decision_id")


def parse_submissions(
    lines: DataFrame, spec: FormSpec, *, origin: str = "UPLOAD", text: str = "value"
) -> DataFrame:
    """JSON text -> records; works on batch and streaming text sources.

    ``is_rejected`` marks text that is not one JSON object.  A record without
    an id gets one made from its own content, so a retry repeats it.
    """
    schema = record_schema(spec)
    body = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    shape = F.schema_of_variant(F.try_parse_json(text))
    good = F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False))
    made_id = F.concat(F.lit(f"{origin}-"), F.sha2(F.col(text), 256))
    work = lines.withColumns({"_r": body, "is_rejected": ~good})
    return work.select(
        F.coalesce("_r.record_id", made_id).alias("record_id"),
        *[F.col(f"_r.{n}").alias(n) for n in schema.fieldNames() if n != "record_id"],
        "is_rejected",
        F.col(text).alias("raw"),
    )


def split_submissions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and rejected text for quarantine."""
    accepted = parsed.where("NOT is_rejected").drop("is_rejected", "raw")
    return accepted, parsed.where("is_rejected").select("raw")


def export_document(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row result as a single nested JSON document."""
    document_text(row).coalesce(1).write.mode(mode).text(path)


def document_text(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*[F.col(c) for c in row.columns])).alias("value"))


def first_submissions(
    records: DataFrame, n: int, *others: DataFrame
) -> tuple[DataFrame, ...]:
    """The first n submissions by id, and the same ids of other tables."""
    head = records.orderBy("record_id").limit(n)
    ids = F.broadcast(head.select("record_id"))  # n rows, the caller's own limit
    return (head, *[o.join(ids, "record_id", "left_semi") for o in others])
