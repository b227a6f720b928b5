"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at step j it emits the current character and
moves on if the shared random bit of (j, character) is one. Texts at a small edit
distance fall into step again after an edit, so edit distance becomes Hamming
distance between the emitted strings. A fingerprint samples the emitted string at
shared positions, 32 an octave of positions, four hash bits of the character
each: its size grows with the logarithm of the text, and fingerprints of texts
of any lengths compare position by position. A sample weighs as many positions
as it stands for; likeness is the weighted share of agreeing samples.

Near texts are found by banding: samples picked by hash form the keys of a few
bands, texts that share a key meet, and the likeness of fingerprints verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import mixed, text_of, written

PERIOD = 1 << 16
OCTAVE = 32  # samples an octave
_CODES = np.arange(0x110000, dtype=np.uint64)
_CLASS = (mixed(_CODES + np.uint64(0x51ED)) & np.uint64(15)).astype(np.uint8)
_VALUE = (mixed(_CODES + np.uint64(0xACE5)) & np.uint64(15)).astype(np.uint8)


def _waits() -> list[bytes]:
    """For each class of characters and step (modulo PERIOD), the steps until the walk has moved on."""
    out = []
    for c in range(16):
        bits = mixed(np.arange(2 * PERIOD, dtype=np.uint64) % np.uint64(PERIOD) + np.uint64(c << 32)) & np.uint64(1)
        ones = np.flatnonzero(bits)
        at = np.arange(PERIOD)
        out.append((ones[np.searchsorted(ones, at)] - at + 1).astype(np.uint8).tobytes())
    return out


_WAIT = _waits()


def _positions(octaves: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of the emitted string, and how many positions each stands for."""
    places, weights = [np.arange(OCTAVE)], [np.ones(OCTAVE)]
    for o in range(5, octaves):
        width = 1 << (o - 5)
        within = mixed(np.arange(OCTAVE, dtype=np.uint64) + np.uint64(o << 8)) % np.uint64(width)
        places.append((1 << o) + np.arange(OCTAVE, dtype=np.int64) * width + within.astype(np.int64))
        weights.append(np.full(OCTAVE, float(width)))
    return np.concatenate(places), np.concatenate(weights)


_PLACES, _WEIGHTS = _positions()
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


class Walk:
    """A walk over a text that comes in parts."""

    def __init__(self, step: int = 0, samples: bytes = b""):
        self.step, self.samples = step, samples

    def copy(self) -> Walk:
        return Walk(self.step, self.samples)

    def feed(self, text: str, part: int = 1 << 16) -> Walk:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes, values = _CLASS[codes].tobytes(), _VALUE[codes]
        waits, mask, j = _WAIT, PERIOD - 1, self.step
        for begin in range(0, len(classes), part):
            starts = []
            add = starts.append
            for c in classes[begin:begin + part]:
                add(j)
                j += waits[c][j & mask]
            places = _PLACES[len(self.samples):int(np.searchsorted(_PLACES, j))]
            if len(places):
                who = np.searchsorted(np.array(starts), places, side="right") - 1
                self.samples += _HEX[values[begin + who]].tobytes()
        self.step = j
        return self

    def print(self) -> str:
        """Length of the emitted string and the samples in it, as text."""
        return f"{self.step:x}." + self.samples.decode()


def likeness(a: str, b: str) -> float:
    """Weighted share of agreeing samples of two fingerprints, 0 to 1; two empty texts are alike."""
    x, y = (np.frombuffer(p.partition(".")[2].encode(), dtype=np.uint8) for p in (a, b))
    longest, shortest = max(len(x), len(y)), min(len(x), len(y))
    if not longest:
        return 1.0
    return float(_WEIGHTS[:shortest][x[:shortest] == y[:shortest]].sum() / _WEIGHTS[:longest].sum())


def fingerprint(text: str) -> str:
    return Walk().feed(text).print()


class _Doc:
    """A document, its fingerprint, and its walk up to the last third."""

    def __init__(self, key, text: str):
        self.key, self.text = key, text
        self.tail = len(text) // 3
        self.head = text[:len(text) - self.tail]
        self.at_cut = Walk().feed(self.head)
        self.print = self.at_cut.copy().feed(text[len(text) - self.tail:]).print()

    def against(self, after_text: str, after_print: str) -> dict:
        donor = after_text[:self.tail]
        edited = self.at_cut.copy().feed(donor).print()
        return {
            "doc_id": self.key, "n_chars": len(self.text),
            "edited_sha256": hashlib.sha256((self.head + donor).encode()).hexdigest(),
            "fingerprint": self.print, "edited_fingerprint": edited,
            "near_edited": likeness(self.print, edited), "near_next": likeness(self.print, after_print)}


def _fields(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


#: Columns of a partition's edge: its place, its last document, and its first one's text and fingerprint.
_EDGE = "part int, last_id long, last_text string, first_text string, first_print string"


def edited_prints(docs: DataFrame, part_rows: int = 256) -> DataFrame:
    """Fingerprint of each text and of its edited form, and likeness to it and to the next text.

    The next document is that of the next smaller doc_id (nulls last; rows of one
    doc_id in order of a hash of their texts), after the last the first. The
    edited text has its last floor(n_chars / 3) code points replaced by as many
    of the next one's first (all, if it has fewer). A null text is empty. One
    range exchange brings the documents in order; each task walks through its
    range and meets the next document in the stream. Only a partition's first and
    last documents need another partition: they are written, and joined by the
    partitions' order. A single document is its own next. Columns of docs but
    doc_id are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    fields = _fields(id_type)
    edge = T.StructType([f if f.name != "last_id" else T.StructField("last_id", id_type) for f in T._parse_datatype_string(_EDGE)])
    schema = T.StructType([*fields, *edge])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, rows = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = _Doc(key, text)
                first = first or (doc.text, doc.print)
                if last:
                    rows.append(last.against(doc.text, doc.print))
                last = doc
                if len(rows) >= part_rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if last:
            rows.append({"part": part, "last_id": last.key, "last_text": last.text, "first_text": first[0], "first_print": first[1]})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(
                    [_Doc(row["last_id"], row["last_text"]).against(row["first_text"], row["first_print"])],
                    pa.schema(list(arrow)[:len(fields)]))

    order = [F.col("doc_id").desc_nulls_last(), F.col("_h")]
    ranged = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("_h")).repartitionByRange(*order)
    walked = written(ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, schema), "editprint")
    edges = walked.where("part is not null").select(*edge.names)
    parts = edges.select("part")
    around = Window.orderBy("part")
    following = parts.select(
        "part", F.coalesce(F.lead("part").over(around), F.first("part").over(around)).alias("after"))
    ends = (
        edges.select("part", "last_id", "last_text").join(following, "part")
        .join(edges.select(F.col("part").alias("after"), "first_text", "first_print"), "after")
        .select("last_id", "last_text", "first_text", "first_print").mapInArrow(join_up, fields))
    return walked.where("part is null").select(*fields.names).unionByName(ends)


def band_keys(print_: str, bands: int = 16, rows: int = 6) -> list[int]:
    """Keys of a fingerprint: in each band a few samples, picked by hash from the three highest octaves it covers.

    Keys are made for the highest octave covered and the one below, so that texts
    on both sides of an octave's edge share some.
    """
    samples = np.frombuffer(print_.partition(".")[2].encode(), dtype=np.uint8)
    top, out = len(samples) // OCTAVE, []
    if not top:
        return [int(mixed(np.frombuffer(samples.tobytes().ljust(OCTAVE), dtype=np.uint64)).sum().astype(np.int64))] if len(samples) else []
    for level in {top, max(1, top - 1)}:
        low = max(0, level - 3) * OCTAVE
        for band in range(bands):
            at = low + mixed(np.arange(rows, dtype=np.uint64) + np.uint64((level << 20) | (band << 8))) % np.uint64(level * OCTAVE - low)
            key = np.uint64((level << 8) | band)
            for value in samples[at.astype(np.int64)]:
                key = mixed(np.array([key + np.uint64(value)]))[0]
            out.append(int(key.astype(np.int64)))
    return out


def _alike(samples: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of samples, its likeness (as in likeness()) to each of others."""
    wide = max(map(len, [*samples, *others]))
    sizes = np.array([len(x) for x in others])
    table = np.zeros((len(others), wide), dtype=np.uint8)  # no sample is 0
    for row, x in zip(table, others, strict=True):
        row[:len(x)] = x
    total = np.concatenate([[0.0], np.cumsum(_WEIGHTS[:wide])])
    for x in samples:
        longest = np.maximum(sizes, len(x))
        same = (table[:, :len(x)] == x) @ _WEIGHTS[:len(x)]
        yield np.where(longest == 0, 1.0, same / np.maximum(1.0, total[longest]))


def _pairs(key: int, ids: np.ndarray, prints: list[str], keys: list[np.ndarray], side: np.ndarray, least: float) -> Iterator[tuple]:
    """Arrays a, b, likeness of the alike pairs of a group: of all its rows, or across if it has two sides.

    A pair is given only in the smallest of the keys that it shares.
    """
    samples = [np.frombuffer(p.partition(".")[2].encode(), dtype=np.uint8) for p in prints]
    across = len(np.unique(side)) > 1
    left, right = (np.flatnonzero(side == k) for k in (0, 1)) if across else (np.arange(len(ids)),) * 2
    before = [k[k < key] for k in keys]
    sizes = np.array([len(k) for k in before])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(before)
    for i, alike in zip(left, _alike([samples[i] for i in left], [samples[j] for j in right]), strict=True):
        hit = alike >= least if across else (alike >= least) & (ids[right] > ids[i])
        at, value = right[hit], alike[hit]
        met = np.concatenate([[0], np.cumsum(np.isin(flat, before[i]))])
        new = met[starts[at] + sizes[at]] == met[starts[at]]
        yield np.minimum(ids[i], ids[at[new]]), np.maximum(ids[i], ids[at[new]]), value[new]


def near_links(prints: DataFrame, least: float = 0.8, block: int = 512) -> DataFrame:
    """(a, b, likeness) with a < b: all pairs that share a band key and whose fingerprints are alike.

    prints has doc_id and fingerprint; equal fingerprints are one node, their
    smallest doc_id. All nodes of a key are compared with one another: a key of
    many nodes is cut into blocks, and each pair of blocks is a group of its own.
    Null fingerprints and nulls in doc_id have no links.
    """
    spark = prints.sparkSession
    named = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id")).where("id is not null")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sorted(set(band_keys(p))) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["id", "fingerprint", "keys"])

    nodes = written(named.select("id", "fingerprint").mapInArrow(keyed, "id long, fingerprint string, keys array<long>"), "prints")
    keys = nodes.select("id", F.explode("keys").alias("key"))
    blocks = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    groups = ["key", "low", "high"]
    rows = (
        keys.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
        .join(nodes, "id").select(*groups, "side", "id", "fingerprint", "keys"))
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = rows.repartition(tasks, *groups).sortWithinPartitions(*groups)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            held = [x for x in (rest, batch) if x is not None]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table[c].to_numpy() for c in groups]
            cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
            edges = [0, *cuts, *([len(table)] if batch is None else [])]
            rest = None if batch is None else next(iter(table.slice(edges[-1]).combine_chunks().to_batches()), None)
            for begin, end in zip(edges, edges[1:], strict=False):
                part = table.slice(begin, end - begin)
                low, high, side = int(columns[1][begin]), int(columns[2][begin]), part["side"].to_numpy()
                if len(part) < 2 or (low != high and len(np.unique(side)) < 2):
                    continue
                of = [np.array(k, dtype=np.int64) for k in part["keys"].to_pylist()]
                for a, b, alike in _pairs(int(columns[0][begin]), part["id"].to_numpy(), part["fingerprint"].to_pylist(), of, side, least):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(alike)], names=["a", "b", "likeness"])

    return source.mapInArrow(compared, "a long, b long, likeness double")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
