"""Two-pass external shuffle of records into shards.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded
hash; pass two shuffles each bucket (Fisher-Yates, Spark's `shuffle`) and writes
it. Bucket sizes, summed in bucket order, give every record its place in one
global permutation; places are dealt to the shards in turn, so shard counts
differ by at most one (law `rows`). Only the bucket sizes meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formproof.llm.common import text_of, written


def shuffled_shards(docs: DataFrame, shards: int = 8, seed: int = 7, bucket_bytes: int = 32 << 20) -> DataFrame:
    """docs in random order: columns of docs with shard (int) and slot (long) added or replaced.

    The number of buckets follows the bytes of the texts, and is at least the
    number of shuffle partitions. Lists of a bucket are sorted before they are
    shuffled, and partitions by bucket, so a task that is repeated repeats its
    permutation. Null ids and texts take part like other values; repeated rows
    are placed one by one; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_of()) + 1)).head()[0] or 0
    buckets = max(-(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    scattered = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)).alias("_bucket"),
        F.struct(F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("at"), F.struct(*names).alias("row")).alias("_rec"))
    by_hash = "(a, b) -> case when a.at < b.at then -1 when a.at > b.at then 1 else 0 end"
    gathered = scattered.groupBy("_bucket").agg(F.collect_list("_rec").alias("_recs"))
    mixed = (
        gathered.withColumn("_recs", F.expr(f"array_sort(_recs, {by_hash})")).sortWithinPartitions("_bucket")
        .select("_bucket", F.posexplode(F.shuffle("_recs", seed)).alias("_pos", "_rec")))
    sizes = written(scattered.groupBy("_bucket").agg(F.count("*").alias("_n")), "bucket_sizes")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_pos")
    return mixed.join(starts, "_bucket").select(
        *[F.col("_rec.row")[c].alias(c) for c in names],
        (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard, each file in slot order; a shard is cut into files by slot."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
