"""Quality by importance resampling: generative n-gram models of target and raw text, Gumbel top-k.

Hashed word unigrams and bigrams are counted over all documents (raw text) and
over documents labelled good (target text). A document's log importance is the
log ratio of the two smoothed models, summed over its n-grams and divided by
their number plus a constant, so that short texts stay near zero. Importances
are perturbed with Gumbel noise from a seeded hash (tempered, so that chance
decides among near equals only), and the k largest are kept. k is the number of
documents whose importance reaches what all but a small share of good documents
reach; that share is read from labelled ones held out of the target text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import text_of, written

BUCKETS = 1 << 14
PAD = 64
#: Words' worth of raw text mixed into the target model.
PRIOR = 1 << 16


def hashed_ngrams(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    grams = list(map(zlib.crc32, words)) + [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]
    return np.array(grams, dtype=np.int64) % BUCKETS


def _counts(docs: DataFrame) -> np.ndarray:
    """[raw, target] counts of each bucket; docs has text and _good. A task sends at most 2 * BUCKETS rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen = np.bincount(hashed_ngrams(text.as_py()), minlength=BUCKETS)
                total[0] += seen
                if good:
                    total[1] += seen
        side, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(bucket), pa.array(total[side, bucket])], names=["side", "bucket", "n"])

    rows = docs.select("text", "_good").mapInArrow(run, "side long, bucket long, n long")
    out = np.zeros((2, BUCKETS))
    for side, bucket, n in rows.groupBy("side", "bucket").agg(F.sum("n")).collect():
        out[side, bucket] = n
    return out


def kth_largest(rows: DataFrame, column: str, k: int, width: int = 4096) -> float:
    """The k-th largest value of a double column: a histogram, narrowed until one bin's values are few."""
    low, high = rows.agg(F.min(column), F.max(column)).head()
    part, left = rows, k
    while True:
        n = part.count()
        if n <= width or low == high:
            return sorted((r[0] for r in part.select(column).collect()), reverse=True)[left - 1] if low != high else low
        step = (high - low) / 256
        bins = dict(part.groupBy(F.least(F.floor((F.col(column) - low) / step), F.lit(255)).alias("b")).count().collect())
        for b in range(255, -1, -1):
            if left <= bins.get(b, 0):
                break
            left -= bins.get(b, 0)
        part = part.where(F.least(F.floor((F.col(column) - low) / step), F.lit(255)) == b)
        low, high = part.agg(F.min(column), F.max(column)).head()


def score(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, lost: float = 0.002,
          temperature: float = 0.002, seed: int = 3) -> DataFrame:
    """docs with n_grams, log_ratio, gumbel_key and kept.

    labels has doc_id and quality (0 or 1); of the good ones the `labelled` with
    the smallest hash form the target text (half of them) and set k (the others). A null or empty text has no
    n-grams and log_ratio 0. Rows whose keys tie with the k-th are kept as well.
    Repeated rows are scored alike and kept together. Without a good label, or
    with an empty table, all documents are kept. Other columns pass through;
    added names are replaced.
    """
    added = ["n_grams", "log_ratio", "gumbel_key", "kept"]
    good = (
        labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(labelled)
        .withColumn("_held", F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(2)) == 1))
    names = [c for c in docs.columns if c not in added]
    base = docs.select(F.struct(*names).alias("_all"), F.col("doc_id").alias("_own"), text_of().alias("text"))
    marked = base.join(F.broadcast(good), F.col("_own") == F.col("_id"), "left").drop("_id")  # at most `labelled` rows
    raw, target = _counts(marked.withColumn("_good", ~F.coalesce("_held", F.lit(True))))
    share = (raw + 1) / (raw + 1).sum()
    weights = docs.sparkSession.sparkContext.broadcast(np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share))

    @F.arrow_udf(T.StructType([T.StructField("n_grams", T.LongType()), T.StructField("log_ratio", T.DoubleType())]))
    def scores(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:  # one text and its grams at a time
            grams = hashed_ngrams(text.as_py())
            rows.append((len(grams), float(weights.value[grams].sum() / (len(grams) + PAD))))
        return pa.StructArray.from_arrays(
            [pa.array([n for n, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.float64())], ["n_grams", "log_ratio"])

    # only the text goes to Python; a generator is not copied into each use
    scored = marked.select("*", F.inline_outer(F.array(scores("text"))))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "_own", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("gumbel_key", F.col("log_ratio") - temperature * F.log(-F.log(uniform)))
    small = written(keyed.select("_held", "log_ratio", "gumbel_key"), "quality_keys")
    floor = small.where("_held").agg(F.percentile("log_ratio", lost)).head()[0]
    if floor is None:
        return _result(keyed, F.lit(True), names)
    k = small.where(F.col("log_ratio") >= floor).count()
    least = kth_largest(small, "gumbel_key", k)
    return _result(keyed, F.col("gumbel_key") >= least, names)


def _result(keyed: DataFrame, kept, names: list[str]) -> DataFrame:
    return keyed.select(*[F.col("_all")[c].alias(c) for c in names], "n_grams", "log_ratio", "gumbel_key", kept.alias("kept"))
