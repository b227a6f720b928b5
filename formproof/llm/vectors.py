"""Embedding near-dedup over pivot shards that a bound rules out.

Vectors of a label that are equal form one class. Each class lies in the shard
of its nearest pivot (a sample of the label's vectors, in proportion to their
number). A vector within the similarity asked for lies at most its angle beyond
the plane halfway between its own pivot and another's, so a class searches every
shard whose plane is not farther than that: no pair that links is left out. Of
two shards that search each other one direction is enough, as a link counts for
both ends. Where pivots tell vectors apart few shards are searched; where they
don't (vectors about equally far from one another) nearly all are.

Shards beyond a block are cut into blocks; queries stream past a block and are
compared with all of it in double precision, so no task holds more than a block
of the index. Links are counted in the task; of the pairs only a forest leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import written
from formproof.llm.links import components

BLOCK = 2048


def _unit(values) -> np.ndarray | None:
    """The vector at unit length in double precision; None if it can't link (null, empty, zero, non-finite)."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # keeps the squares of very large and very small components in range
    return x / np.sqrt((x * x).sum())


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit (binary doubles, null if the vector links with nothing), h1, h2 (hash of unit and label)."""
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"],
                           *T._parse_datatype_string("unit binary, h1 long, h2 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                unit = _unit(values) if label is not None else None
                if unit is None:
                    made.append((None, None, None))
                    continue
                raw = (np.round(unit, 12) + 0.0).tobytes()
                both = xxhash.xxh3_128_intdigest(raw + str(label).encode())
                made.append((unit.tobytes(), *(int(np.uint64(h).astype(np.int64)) for h in (both >> 64, both & 0xFFFFFFFFFFFFFFFF))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.binary()),
                 pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
                names=["vec_id", "label", "unit", "h1", "h2"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def _pivots(classes: DataFrame, per_shard: int, most: int) -> dict:
    """{(label, bytes of a vector): pivots}: one pivot for per_shard vectors, at most `most` in all; picked by hash."""
    n = max(1, classes.count())
    share = min(1.0 / per_shard, most / n)
    rows = classes.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "unit", "rep").collect()
    out: dict = {}
    for label, unit, rep in sorted(rows, key=lambda r: r.rep)[:2 * most]:
        out.setdefault((label, len(unit)), []).append(np.frombuffer(unit))
    return {k: np.stack(v) for k, v in out.items()}


def _searches(x: np.ndarray, pivots: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nearest pivot of each row of x, and the shards it searches: those that may hold vectors similar to it.

    A vector v of shard s has v.(p - s) <= 0 for every pivot p, so a row q within
    the angle of v has q.(p - s) <= sin(angle) |p - s|; p is the pivot nearest to
    q. Of two shards one searches the other: from each, those in the half circle after it.
    """
    n = len(pivots)
    reach = np.sqrt(1 - least * least) if least > 0 else 2.0
    own, shards = [], []
    for begin in range(0, len(x), max(1, (1 << 21) // n)):
        sim = x[begin:begin + max(1, (1 << 21) // n)] @ pivots.T
        near = sim.argmax(1)
        some, which = np.unique(near, return_inverse=True)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots[some] @ pivots.T)))[which]
        after = (np.arange(n) - near[:, None]) % n
        ahead = (2 * after < n) | ((2 * after == n) & (near[:, None] < np.arange(n)))
        go = ahead & (sim[np.arange(len(sim)), near][:, None] - sim <= reach * apart + 1e-6)  # spare for rounding
        own.append(near)
        shards += [np.flatnonzero(g) for g in go]
    return np.concatenate(own), shards


def _assigned(classes: DataFrame, pivots, least: float) -> DataFrame:
    """rep, label, unit, size, dims, shard (of the nearest pivot), searches (shards to search, its own among them)."""
    schema = T.StructType([classes.schema["rep"], classes.schema["label"], *T._parse_datatype_string(
        "unit binary, size long, dims int, shard int, searches array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units_ = batch.column(2).to_pylist()
            shard, searches, groups = [0] * len(units_), [[0]] * len(units_), {}
            for i, (label, unit) in enumerate(zip(batch.column(1).to_pylist(), units_, strict=True)):
                groups.setdefault((label, len(unit)), []).append(i)
            for key, at in groups.items():
                known = pivots.value.get(key)
                if known is not None:
                    near, others = _searches(np.stack([np.frombuffer(units_[i]) for i in at]), known, least)
                    for i, s, o in zip(at, near.tolist(), others, strict=True):
                        shard[i], searches[i] = s, o
            dims = pa.array([len(u) // 8 for u in units_], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, dims, pa.array(shard, pa.int32()), pa.array(searches, pa.list_(pa.int32()))], names=schema.names)

    return classes.select("rep", "label", "unit", "size").mapInArrow(run, schema)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from sorted batches; a run is cut where a batch ends."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        columns = [table[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(table)], strict=False):
            yield table.slice(int(a), int(b - a))


class Block:
    """A block of the index: its ids in order, unit vectors, class sizes, links counted, and what the forest connects."""

    def __init__(self, tables: list[pa.Table]):
        self.ids = np.concatenate([t["rep"].to_numpy() for t in tables])
        self.x = np.stack([np.frombuffer(u) for t in tables for u in t["unit"].to_pylist()])
        self.sizes = np.concatenate([t["size"].to_numpy() for t in tables])
        self.links = np.zeros(len(self.ids), dtype=np.int64)
        self.tree = np.arange(len(self.ids))

    def compared(self, rep: np.ndarray, q: np.ndarray, sizes: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Links of each query (and counts them for the block's rows), and pairs that connect all that these link.

        Of two rows of this block the one with the larger id asks.
        """
        hit = q @ self.x.T >= least
        hit &= ~own[:, None] | (rep[:, None] > self.ids)
        links = hit @ self.sizes
        self.links += sizes @ hit
        pairs = []
        for i in np.flatnonzero(links):
            at = np.flatnonzero(hit[i])
            trees, first = np.unique(self.tree[at], return_index=True)
            mine = self.tree[np.searchsorted(self.ids, rep[i])] if own[i] else -1
            pairs += [(int(rep[i]), int(self.ids[at[k]])) for k in first[trees != mine]]
            if own[i] or len(trees) > 1:
                trees = np.append(trees, mine) if own[i] else trees
                self.tree[np.isin(self.tree, trees)] = trees.min()
        return links, pairs


def _found(rows: DataFrame, least: float) -> DataFrame:
    """(a, a, n): n links of a; (a, b, 0): a forest of links. rows: label, dims, shard, block, query (0 index, 1 query), rep, unit, size, own."""
    keys = ["label", "dims", "shard", "block"]
    order = [*keys, "query", "rep"]
    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = rows.select(*order, "unit", "size", "own").repartition(tasks, *keys).sortWithinPartitions(*order)

    def counted(ids, n):
        some = n > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[some]), pa.array(n[some])], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for table in _grouped(batches, [*keys, "query"]):
            now = tuple(table[k][0].as_py() for k in keys)
            if now != key:
                if block:
                    yield counted(block.ids, block.links)
                key, held, block = now, [], None
            if table["query"][0].as_py() == 0:
                held.append(table)
                continue
            block = block or Block(held)
            for begin in range(0, len(table), 1024):
                part = table.slice(begin, 1024)
                rep, own = part["rep"].to_numpy(), part["own"].to_numpy(zero_copy_only=False)
                q = np.stack([np.frombuffer(u) for u in part["unit"].to_pylist()])
                links, pairs = block.compared(rep, q, part["size"].to_numpy(), own, least)
                yield counted(rep, links)
                a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), dtype=np.int64))], names=["a", "b", "n"])
        if block:
            yield counted(block.ids, block.links)

    return source.mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.93, per_shard: int = 1024, most_pivots: int = 65_536) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, label, embedding).

    Two vectors link when their labels are equal and not null and their cosine,
    in double precision, is at least `least`; vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. n_links counts other rows, so equal vectors (at 12 digits
    of their unit form) count one another. Pivots are a sample of at most
    most_pivots vectors; every pair that links is found. Other columns are left out; rows are never dropped; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = written(units(vectors), "vectors")
    classes = written(rows.where("unit is not null").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min_by("unit", "vec_id").alias("unit")), "vector_classes")
    pivots = spark.sparkContext.broadcast(_pivots(classes, per_shard, most_pivots))
    placed = written(_assigned(classes, pivots, least), "vector_shards")
    at = ["label", "dims", "shard"]
    sizes = placed.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, at).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    index = placed.drop("searches").withColumns({"query": F.lit(0), "own": F.lit(True)})
    queries = (
        placed.withColumnsRenamed({"shard": "_shard", "block": "_block"}).withColumn("shard", F.explode("searches")).drop("searches").join(sizes, at)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("shard <> _shard or block >= _block")
        .withColumns({"query": F.lit(1), "own": F.expr("shard = _shard and block = _block")}).drop("_shard", "_block", "blocks"))
    found = written(_found(index.unionByName(queries), least), "vector_found")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_links"))
    names = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "rep")
    known = (
        classes.select("label", "h1", "h2", "rep", "size").join(links, "rep", "left").join(names, "rep", "left")
        .select(F.col("label").alias("_l"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rep", "size", "_links", "component"))
    joined = rows.join(known, (rows.label == F.col("_l")) & (rows.h1 == F.col("_h1")) & (rows.h2 == F.col("_h2")), "left")
    name = F.coalesce("component", "rep", "vec_id")
    return joined.select(
        "vec_id", F.coalesce(F.col("_links"), F.lit(0)).__add__(F.coalesce(F.col("size") - 1, F.lit(0))).cast("long").alias("n_links"),
        name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))


def recall(vectors: DataFrame, result: DataFrame, least: float = 0.93, every: int = 50) -> float:
    """Links of the rows whose vec_id is divisible by `every` that the result counts, as a share of those brute force finds.

    The queries meet all rows in blocks: each task compares its rows with them.
    """
    rows = units(vectors).where("unit is not null")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "unit").collect()  # the audit's stated query set
    by_label: dict = {}
    for vec_id, label, unit in asked:
        by_label.setdefault((label, len(unit)), []).append((vec_id, np.frombuffer(unit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for vec_id, label, unit in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                known = by_label.get((label, len(unit)))
                if known:
                    hits = np.stack([k[1] for k in known]) @ np.frombuffer(unit) >= least
                    for (other, _), hit in zip(known, hits, strict=True):
                        if hit and other != vec_id:
                            total[other] = total.get(other, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["vec_id", "truth"])

    truth = rows.select("vec_id", "label", "unit").mapInArrow(run, "vec_id long, truth long").groupBy("vec_id").agg(F.sum("truth").alias("truth"))
    got = truth.join(result, "vec_id").agg(F.sum(F.least("n_links", "truth")), F.sum("truth")).head()
    return 1.0 if not got[1] else got[0] / got[1]
