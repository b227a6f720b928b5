"""Table access, derived views and the query registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.plan import spread
from ..functions.ranking import next_in_group
from ..operators import rules
from ..session import configure
from . import demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(name: str, sql: str | None = None):
    """Register a query under its operator id, with its SQL counterpart if any."""

    def register(build: Callable[["Tables"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(configure(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


class Tables:
    """The given tables and the views derived from them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.read("documents"), "doc_id")

    @cached_property
    def form(self) -> DataFrame:
        """One wide record per order; its text is a whole passage plus a deal note."""
        customer, nation = self.read("customer"), self.read("nation")
        orders = spread(self.read("orders"), "o_orderkey")
        passages = self.read("benchmark")
        n = passages.agg(F.count(F.lit(1))).scalar()
        k = F.col("o_orderkey")
        joined = (
            orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
            .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
            .join(passages, F.col("item_id") == k % n)
        )
        amount = F.floor("o_totalprice").cast("bigint").cast("string")
        deal = F.concat(
            F.col("text"), F.lit(" Agreed with "), F.col("c_name"), F.lit(" at £"), amount,
            F.lit(" per day; write to buyer"), F.col("o_custkey").cast("string"),
            F.lit("@example.com."),
        )
        return joined.select(
            F.concat(F.lit("ORD-"), k.cast("string")).alias("record_id"),
            k.alias("k"),
            F.when(k % 101 == 0, "X").otherwise(F.col("o_orderstatus")).alias("q1_status"),
            F.when(k % 17 != 0, F.col("o_orderpriority")).alias("q2_priority"),
            F.when(k % 23 == 0, "").otherwise(F.col("c_mktsegment")).alias("q3_segment"),
            F.col("c_name").alias("i_name"),
            F.col("n_name").alias("i_nation"),
            F.floor("c_acctbal").cast("bigint").cast("string").alias("i_balance"),
            F.when(k % 211 == 0, "approved").alias("x_outcome"),
            F.when(k % 13 == 0, "").when(k % 29 == 0, "n/a").otherwise(deal).alias("text"),
            F.col("n_name").alias("archetype"),
            F.col("c_mktsegment").alias("register"),
            F.col("o_orderdate").alias("submitted_at"),
        )

    @cached_property
    def truth(self) -> DataFrame:
        """Planted truth per record, nested the way corpora store it."""
        k = F.col("k")
        one = F.struct(
            F.lit("p_status").alias("pair_id"),
            F.concat(F.lit("type"), (k % 3).cast("string")).alias("contradiction_type"),
            (k % 3 + 1).cast("int").alias("subtlety"),
            (F.col("q1_status") == "O").alias("undermines_outside_leaning"),
        )
        kind = F.when(k % 13 == 0, "blank").when(k % 29 == 0, "non_responsive")
        return self.form.select(
            "record_id", "archetype", "register",
            F.when(k % 5 == 0, "inside").when(k % 5 == 1, "undetermined").otherwise("outside")
            .alias("outcome_label"),
            F.array_compact(F.array(F.when(k % 37 == 0, one))).alias("contradictions"),
            F.array_compact(
                F.array(F.when(kind.isNotNull(),
                               F.struct(F.lit("text").alias("field_id"), kind.alias("kind"))))
            ).alias("anomalies"),
        )

    @cached_property
    def states(self) -> DataFrame:
        return self.form.select(
            "record_id",
            F.create_map(F.lit("p_status"), F.md5("text")).alias("units"),
        )

    @cached_property
    def inst(self) -> DataFrame:
        """Labelled instances: one per labelled document, whole text; eight documents make a record."""
        labels, documents = self.read("labels"), self.documents
        toxic = F.col("toxic") == 1
        return labels.join(documents, "doc_id").select(
            F.concat(F.lit("rec-"), F.floor(F.col("doc_id") / 8).cast("string")).alias("record_id"),
            F.concat(F.lit("p-"), (F.col("doc_id") % 8).cast("string")).alias("pair_id"),
            F.lit("q_quality").alias("structured_field"),
            F.lit("text").alias("free_text_field"),
            F.col("lang").alias("test_id"),
            F.when(F.col("quality") == 1, "good").otherwise("bad").alias("structured_value"),
            (F.col("quality") == 1).alias("is_outside_leaning"),
            F.col("text").alias("free_text"),
            F.col("toxic").cast("int").alias("label"),
            F.when(toxic, F.concat(F.lit("type"), (F.col("doc_id") % 3).cast("string")))
            .alias("contradiction_type"),
            F.when(toxic, (F.col("doc_id") % 3 + 1).cast("int")).alias("subtlety"),
            F.md5("text").alias("unit_key"),
            F.lit(None).cast("string").alias("anomaly"),
            F.col("lang").alias("archetype"),
            F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "medium")
            .otherwise("long").alias("register"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return rules.score_rules(self.inst, demo.INSULT_RULES)

    @cached_property
    def form_inst(self) -> DataFrame:
        from ..operators.instances import build_unlabelled

        return build_unlabelled(self.form, demo.FORM)

    @cached_property
    def decisions(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("decision_id"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("record_id"),
            F.col("props").alias("pair_id"),
            F.lit("text").alias("field_id"),
            "ts",
            F.when(F.col("event_type").isin("click", "purchase", "signup"), "accept").otherwise("dismiss")
            .alias("decision"),
            F.when(F.col("value") >= 10, F.concat(F.lit("seen "), F.col("props"))).alias("reason"),
            F.col("value"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        c = self.read("conversations").withColumnRenamed("text", "premise")
        rows = next_in_group(c, ["conv_id"], "turn", "premise", "hypothesis")
        return rows.where(F.col("hypothesis").isNotNull())
