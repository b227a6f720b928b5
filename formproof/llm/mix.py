"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, document after document, are cut into blocks of a fixed
length. The mix has as many slots as the targets need, in output shards of a
fixed number of slots; a seeded hash draws a source for every slot, so a shard's
source counts are multinomial. Draws beyond a source's quota pass to the sources
that are short, so that totals meet the targets. A source's slots are numbered
through all shards; numbers map to block indexes through a pseudorandom
permutation of the source's blocks, a new one for every round, and slots join
blocks by index. A block is so taken once a round: counts of a source's blocks
differ by one at most, and nothing is taken more than `most` times.

Documents are placed in their source by two-level sums (buckets by hash, then
within a bucket), so a source of any size spreads over many tasks. The driver
sees one row for each source, and no other data.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import mixed, text_of, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], most: int) -> list[Fraction]:
    """Target of each source (sizes in source order): shares by weight, capped at most times the size.

    The excess over a cap is shared among the others by weight, until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [Fraction(0)] * len(sizes)
    free, left = {i for i in range(len(sizes)) if sizes[i][1]}, Fraction(sum(n for _, n in sizes))
    while free:
        unit = left / sum(weight[i] for i in free)
        over = {i for i in free if weight[i] * unit > most * sizes[i][1]}
        for i in over or free:
            out[i] = Fraction(most * sizes[i][1]) if over else weight[i] * unit
            left -= out[i]
        free = free - over if over else set()
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1 for each row: a Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mixed(right + k + np.uint64(turn * 0x9E3779B9)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _block_at(number: pd.Series, blocks: pd.Series, source: pd.Series, seed: pd.Series) -> pd.Series:
    turn = (number // blocks).to_numpy()
    key = mixed(source.to_numpy().astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64) + mixed(seed.to_numpy().astype(np.uint64)))
    return pd.Series(permuted((number % blocks).to_numpy(), blocks.to_numpy(), key))


def packed(docs: DataFrame, block_words: int) -> tuple[DataFrame, list]:
    """Word spans of the documents in the blocks of their source, and (source, words) in source order.

    Rows: _src (place of the source), _block, doc_id, _from (the document's first word in its
    source, which names the row), _size, _words (its words in the block).
    """
    sized = written(
        docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("_size"),
                    F.xxhash64("doc_id", text_of()).alias("_h")), "mix_sizes")
    rows = sized.groupBy("source").agg(F.sum("_size").alias("n")).collect()  # one a source
    sources = sorted(((r.source, r.n) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    order = docs.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(sources)], "_s string, _src int")
    parts = 64 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sized.where("_size > 0").join(order, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_b", F.pmod("_h", F.lit(parts)))
    sums = placed.groupBy("_src", "_b").agg(F.sum("_size").alias("_n"))
    ahead = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("_src", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")), "mix_starts")
    within = Window.partitionBy("_src", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        placed.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(starts, ["_src", "_b"])
        .withColumn("_from", F.col("_start") + F.col("_before")))
    first, last = F.floor(F.col("_from") / block_words), F.floor((F.col("_from") + F.col("_size") - 1) / block_words)
    spans = numbered.select("_src", "doc_id", "_h", "_from", "_size", F.explode(F.sequence(first, last)).alias("_block"))
    words = (F.least((F.col("_block") + 1) * block_words, F.col("_from") + F.col("_size"))
             - F.greatest(F.col("_block") * block_words, "_from"))
    return spans.withColumn("_words", words), [(s, n) for s, n in sources]


def drawn(spark, quotas: list[int], blocks: list[int], shard_slots: int, seed: int) -> DataFrame:
    """The mix's slots: _slot, _shard, _src, _block. Totals of a source are its quota."""
    total = sum(quotas)
    edges = np.cumsum(quotas).tolist() or [0]
    slots = spark.range(total).select(F.col("id").alias("_slot"), F.floor(F.col("id") / shard_slots).alias("_shard"))
    point = F.pmod(F.xxhash64(F.lit(seed), "_slot"), F.lit(max(1, total)))
    bound = F.array(*map(F.lit, edges))
    slots = slots.withColumn("_src", F.size(F.filter(bound, lambda e: e <= point)))
    counts = written(slots.groupBy("_shard", "_src").agg(F.count("*").alias("_n")), "mix_counts")
    ahead = Window.partitionBy("_src").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_src", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_shard", "_src").orderBy("_slot")
    numbered = (
        slots.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["_shard", "_src"])
        .withColumn("_number", F.col("_start") + F.col("_at")))
    have = {r._src: r.n for r in counts.groupBy("_src").agg(F.sum("_n").alias("n")).collect()}  # one a source
    over = [max(0, have.get(i, 0) - q) for i, q in enumerate(quotas)]
    short = [max(0, q - have.get(i, 0)) for i, q in enumerate(quotas)]
    # The surplus draws, counted through the sources, go to the sources that are short, in order.
    put = {name: F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>") for name, values in {
        "quota": quotas, "over": np.cumsum([0, *over[:-1]]), "ends": np.cumsum(short), "begins": np.cumsum([0, *short[:-1]]),
        "have": [have.get(i, 0) for i in range(len(quotas))], "blocks": blocks}.items()}
    extra = put["over"][F.col("_src")] + F.col("_number") - put["quota"][F.col("_src")]
    surplus = F.col("_number") >= put["quota"][F.col("_src")]
    other = F.size(F.filter(put["ends"], lambda e: e <= F.col("_extra")))
    final = (
        numbered.withColumn("_extra", F.when(surplus, extra))
        .withColumn("_to", F.when(surplus, other).otherwise(F.col("_src")))
        .withColumn("_num", F.when(surplus, put["have"][F.col("_to")] + F.col("_extra") - put["begins"][F.col("_to")]).otherwise(F.col("_number"))))
    block = _block_at("_num", put["blocks"][F.col("_to")], F.col("_to").cast("long"), F.lit(seed).cast("long"))
    return final.select("_slot", "_shard", F.col("_to").alias("_src"), block.alias("_block"))


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 32,
                 shard_slots: int = 65536, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(spans with _times, how often the mix takes their block; the sources' targets).

    Rows of the first: doc_id, _h (hash of doc_id and text), _src, _from, _size, _block,
    _words, _times. The second, one row a source: source, source_size, target.
    """
    spark = docs.sparkSession
    spans, sizes = packed(docs, block_words)
    goal = targets(sizes, weights, most)
    blocks = [-(-n // block_words) for _, n in sizes]
    quotas = [min(most * b, round(b * g / n)) if n else 0 for (_, n), g, b in zip(sizes, goal, blocks, strict=True)]
    slots = drawn(spark, quotas, blocks, shard_slots, seed)
    times = slots.groupBy("_src", "_block").agg(F.count("*").alias("_times"))
    taken = spans.join(times, ["_src", "_block"], "left").withColumn("_times", F.coalesce("_times", F.lit(0)))
    facts = spark.createDataFrame(
        [(s, i, n, float(g)) for i, ((s, n), g) in enumerate(zip(sizes, goal, strict=True))],
        "source string, _src int, source_size long, target double")
    return taken, facts


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes of it, repeats counted).

    Sizes are words; a null or empty text has none and is never taken. Sources
    are ordered by code point, null last, and weigh 5, 2, 1, repeating; targets
    stop at 3 times a source's size. Rows of one doc_id with one text share
    what is taken of them evenly, rounded down. Other columns stay; added names are replaced; reruns agree.
    """
    taken, facts = mixed_blocks(docs, **settings)
    per_row = taken.groupBy("_src", "_from", "doc_id", "_h").agg(F.sum(F.col("_words") * F.col("_times")).alias("_taken"))
    per_doc = per_row.groupBy(F.col("doc_id").alias("_id"), "_src", F.col("_h").alias("_hash")).agg(F.sum("_taken").alias("_taken"), F.count("*").alias("_rows"))
    added = ("size", "source_size", "target", "taken")
    base = docs.select(
        F.struct("*").alias("_all"), F.col("doc_id").alias("_own"), F.col("source").alias("_of"), F.xxhash64("doc_id", text_of()).alias("_hd"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("_words"))
    named = facts.select(F.col("source").alias("_s"), F.col("_src").alias("_at"), "source_size", "target")
    named = F.broadcast(named) if named.count() <= 10_000 else named
    joined = base.join(named, base._of.eqNullSafe(F.col("_s")))
    rows = joined.join(
        per_doc, joined._own.eqNullSafe(F.col("_id")) & (F.col("_hd") == F.col("_hash")) & (F.col("_at") == F.col("_src")), "left")
    return rows.select(
        *[F.col("_all")[c].alias(c) for c in docs.columns if c not in added], F.col("_words").alias("size"), "source_size", "target",
        F.coalesce(F.floor(F.col("_taken") / F.col("_rows")), F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = 32, **settings) -> DataFrame:
    """The mix as documents: columns of docs, up to `most` rows a document, the k-th with the words taken more than k times.

    A document all of whose words are taken k times has its text as it is; else
    its words in taken blocks, in order, joined by one space. n_chars follows the text.
    """
    taken, facts = mixed_blocks(docs, block_words=block_words, **settings)
    copies = taken.where("_times > 0").select(
        "*", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy"))
    begin = F.greatest(F.col("_block") * block_words, "_from") - F.col("_from")
    pieces = copies.groupBy("doc_id", "_h", "_src", "_from", "_size", "_copy").agg(
        F.sort_array(F.collect_list(F.struct((begin + 1).cast("int").alias("at"), F.col("_words").cast("int").alias("n")))).alias("_pieces"))
    base = docs.select(
        F.struct("*").alias("_all"), F.col("doc_id").alias("_own"), F.col("source").alias("_of"), F.xxhash64("doc_id", text_of()).alias("_hd"))
    order = facts.select(F.col("source").alias("_s"), F.col("_src").alias("_at"))
    order = F.broadcast(order) if order.count() <= 10_000 else order
    # texts move once: the rows that are equal here, of which one stays, and the join share this partitioning
    base = base.join(order, base._of.eqNullSafe(F.col("_s"))).drop("_of", "_s").repartition("_hd", "_at").dropDuplicates(["_own", "_hd", "_at"])
    rows = base.join(pieces, (F.col("_hd") == F.col("_h")) & (F.col("_at") == F.col("_src")) & F.col("_own").eqNullSafe(F.col("doc_id")))
    text = F.col("_all")["text"]
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    whole = F.aggregate("_pieces", F.lit(0), lambda a, p: a + p.n) == F.col("_size")
    some = F.array_join(F.flatten(F.transform("_pieces", lambda p: F.slice("_every", p.at, p.n))), " ")
    made = rows.withColumn("_every", F.when(~whole, words)).withColumn("_new", F.when(whole, text).otherwise(some))
    put = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return made.select(*[(put[c] if c in put else F.col("_all")[c]).alias(c) for c in docs.columns])
