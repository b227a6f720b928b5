"""Line dedup over levelled sorted runs of line hashes.

A run is an immutable table of line hashes, bucketed and sorted by hash. Every
hash lives in exactly one run, with the document that keeps the line. A new
batch is merge-anti-joined with the runs: hashes it brings first become a run of
their own, hashes that are known already become hits (a count per hash). Two
runs of one level are compacted into one of the next, so an index of n batches
holds at most log2(n) + 1 runs and each hash is rewritten at most as often.
Batches, runs and compactions share one bucketing: joins with runs shuffle
neither side's index. Line keys are known by 128 hash bits.

Everything is DataFrame work; no Python runs on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formproof.llm.common import WHITE, text_of, written
from formproof.session import scratch_dir

HASH = ["_h1", "_h2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters outside ASCII that lower() would change.
_OTHER_UPPER = r"[[^\x00-\x7F]&&[\p{javaUpperCase}\p{Lt}]]"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased, other characters as they are."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.rlike(bare, F.lit(_OTHER_UPPER)), F.translate(bare, _UPPER, _LOWER)).otherwise(F.lower(bare))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: _id, _row (hash of the text), _pos, hash."""
    lines = docs.select(
        F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_row"),
        F.posexplode(F.split(text_of(), "\n")).alias("_pos", "_line"),
    ).where(F.octet_length("_line") >= min_chars)
    keys = lines.select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
    return keys.where(F.length("_key") >= min_chars).select(
        "_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


class LineRuns:
    """The index: levels of sorted runs, and the hits of later batches on them."""

    def __init__(self, spark: SparkSession, min_chars: int = 20, fan: int = 2):
        self.spark, self.min_chars, self.fan = spark, min_chars, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hits: list[DataFrame] = []

    def _write_run(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.option("path", scratch_dir(self.spark, name)).bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        return name

    def _drop_run(self, name: str) -> None:
        place = self.spark.sql(f"describe formatted {name}").where("col_name = 'Location'").head().data_type
        self.spark.sql(f"drop table {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Take a batch in. Of the documents of one batch the largest doc_id keeps a new line."""
        lines = keyed_lines(batch, self.min_chars)
        keys = self._write_run(
            lines.groupBy(*HASH, "_id", "_row").agg(F.lit(1).alias("_one"))
            .groupBy(*HASH).agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper")))
        fresh, known = self.spark.table(keys), self.runs()
        for run in known:
            fresh = fresh.join(run.select(*HASH), HASH, "left_anti")
        name = keys
        if known:
            name = self._write_run(fresh)
            self.hits.append(written(self.spark.table(keys).join(
                self.spark.table(name).select(*HASH), HASH, "left_anti").select(*HASH, "_n"), "line_hits"))
            self._drop_run(keys)
        self._push(name, 0)

    def _push(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            parts, self.levels[level] = self.levels[level], []
            both = self.spark.table(parts[0])
            for part in parts[1:]:
                both = both.unionByName(self.spark.table(part))
            self._push(self._write_run(both), level + 1)
            for part in parts:
                self._drop_run(part)

    def repeated(self, min_docs: int) -> DataFrame:
        """Hashes that at least min_docs documents hold, with the document that keeps the line."""
        runs = self.runs()
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        if self.hits:
            hits = self.hits[0]
            for more in self.hits[1:]:
                hits = hits.unionByName(more)
            hits = hits.groupBy(*HASH).agg(F.sum("_n").alias("_more"))
            every = every.join(hits, HASH, "left").withColumn("_n", F.col("_n") + F.coalesce("_more", F.lit(0)))
        return every.where(F.col("_n") >= min_docs).select(*HASH, "_keeper")

    def clear(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop_run(name)
        self.levels, self.hits = [], []


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """Drop repeated lines everywhere but in the largest doc_id that holds them.

    Texts split at line feeds; a null or empty text is one empty line. Lines of
    fewer than min_chars code points, and lines in fewer than min_docs documents,
    stay. The corpus is indexed in batches of falling doc_id, so a line's first
    batch holds its keeper. Rows of one doc_id with one text count as one
    document, and all keep the line; a null doc_id is below every other, and
    rows without one keep a line only together. Columns of docs stay (text is
    replaced, null becomes empty); n_lines, n_dropped and n_kept_lines are added
    or replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    index = LineRuns(spark, min_chars)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).head()[0] or []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    for high, low in zip(edges, edges[1:], strict=False):
        part = docs
        if high is not None:
            part = part.where((F.col("doc_id") < high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") < high)
        if low is not None:
            part = part.where(F.col("doc_id") >= low)
        index.add(part)
    repeated = written(index.repeated(min_docs), "line_repeated")
    index.clear()
    drops = (
        keyed_lines(docs, min_chars).join(repeated, HASH)
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_pos")).alias("_drops")))
    return _without(docs, drops)


def _without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """Cut the dropped positions out of each text: the slices between them, in one pass."""
    base = docs.select(
        F.struct("*").alias("_all"), F.col("doc_id").alias("_own"), text_of().alias("_t"), F.xxhash64(text_of()).alias("_key"))
    joined = base.join(drops, base._own.eqNullSafe(drops._id) & (base._key == drops._row), "left")
    rows = joined.select(
        "_all", "_t", F.split("_t", "\n").alias("_lines"), F.coalesce("_drops", F.array().cast("array<int>")).alias("_cut"))
    kept = F.expr(
        "flatten(transform(sequence(0, size(_cut)), i -> slice(_lines,"
        " if(i = 0, 1, _cut[greatest(i - 1, 0)] + 2),"
        " if(i = size(_cut), size(_lines), _cut[least(i, size(_cut) - 1)])"
        " - if(i = 0, 0, _cut[greatest(i - 1, 0)] + 1))))")
    text = F.when(F.size("_cut") == 0, F.col("_t")).otherwise(F.array_join(kept, "\n"))
    added = ("n_lines", "n_dropped", "n_kept_lines")
    return rows.select(
        *[text.alias(c) if c == "text" else F.col("_all")[c].alias(c) for c in docs.columns if c not in added],
        F.size("_lines").cast("long").alias("n_lines"), F.size("_cut").cast("long").alias("n_dropped"),
        (F.size("_lines") - F.size("_cut")).cast("long").alias("n_kept_lines"))
