"""Collocations by vertical partitioning of a suffix tree over words, in the manner of ERA.

Every word of a piece starts a suffix, truncated to four words. Suffixes of one
language that share a prefix form a subtree; subtrees are built independently of
one another, in groups that fit a memory budget:

1. Counting. Tasks cut texts into slices, keep the distinct suffixes of a slice with
   their counts, and count those by a hash of their first word, first two and
   first three words. Only these counts (3 * 2^bits, whatever the text) reach the driver.
2. Partitioning. One-word prefixes whose bucket exceeds the budget are extended
   by the next word, up to three; beyond that suffixes are dealt by all their
   words. Buckets within the budget are packed into groups of about a budget.
3. Building. Each slice sends a group one row: its distinct suffixes as number
   arrays with the words they use. A group sorts its suffixes; equal prefixes
   are the nodes of the truncated subtree, and the sums of their leaves' counts
   are exact frequencies. Nodes above a group's prefix are partial counts, and
   summed over the groups.

Equal suffixes are counted before they are sent, so a phrase that fills half the corpus costs a
group one leaf a slice. Cuts, scores and the removal of contained phrases are joins over the
frequent phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formproof.llm.common import mixed, text_of, written

DEPTH = 4
#: Bytes of text of a slice, and distinct suffixes of a group, to bound memory.
SLICE_BYTES = 6 << 20
BUDGET = 1 << 20
MOST_BITS = 18

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Ends of pieces become line feeds, tabs become spaces, A-Z becomes a-z.
_PLAIN = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r" + _UPPER, b" " + b"\n" * 10 + _LOWER)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers handed out in order of appearance; the empty word is 0, the end of a piece 1."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def _distinct(codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row of codes, and how often the row occurs; equal rows have equal hashes."""
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not (codes[order[1:][same]] == codes[order[:-1][same]]).all():  # different rows of one hash: by the rows themselves
        order = np.lexsort(codes.T)
        same = (codes[order[1:]] == codes[order[:-1]]).all(axis=1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))[:len(order)]
    return order[first], np.diff(np.append(first, len(order)))


def _slice(texts: list[bytes], numbers: _Numbers) -> np.ndarray:
    """The suffixes of the texts as rows of DEPTH word numbers, 0 after the end of a piece."""
    tokens = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
    found = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    found = np.concatenate([found[found > 0], np.ones(DEPTH, dtype=np.int64)])
    at = np.flatnonzero(found > 1)
    codes = np.zeros((len(at), DEPTH), dtype=np.int64)
    codes[:, 0] = found[at]
    for k in range(1, DEPTH):
        after = found[at + k]
        codes[:, k] = np.where((codes[:, k - 1] > 0) & (after > 1), after, 0)
    return codes


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Slices of a partition: their words, and for each language (its name, distinct suffixes, counts, prefix hashes)."""
    def cut(waiting: dict[str, list[bytes]]):
        numbers = _Numbers()
        parts = [(lang, _slice(texts, numbers)) for lang, texts in waiting.items()]
        words = list(numbers)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        hashes[0] = 0
        out = []
        for lang, codes in parts:
            state = np.full(len(codes), xxhash.xxh3_64_intdigest(lang.encode()), dtype=np.uint64)
            prefix = np.empty((DEPTH, len(codes)), dtype=np.uint64)
            for k in range(DEPTH):
                prefix[k] = state = mixed(state * _STEP + hashes[codes[:, k]])
            at, n = _distinct(codes, state)
            out.append((lang, codes[at], n, prefix[:, at]))
        return words, out

    waiting, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            waiting.setdefault(lang.as_py(), []).append(raw := text.as_py().encode())
            size += len(raw) + 1
            if size >= SLICE_BYTES:
                yield cut(waiting)
                waiting, size = {}, 0
    if waiting:
        yield cut(waiting)


def _loads(texts: DataFrame, bits: int) -> np.ndarray:
    """Of each prefix length under DEPTH and each bucket, the number of suffixes that slices send."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DEPTH - 1, 1 << bits), dtype=np.int64)
        for _, parts in _slices(batches):
            for *_, prefix in parts:
                for k in range(DEPTH - 1):
                    total[k] += np.bincount((prefix[k] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        depth, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[depth, bucket])], names=["depth", "bucket", "n"])

    rows = texts.mapInArrow(run, "depth int, bucket int, n long").groupBy("depth", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((DEPTH - 1, 1 << bits), dtype=np.int64)
    out[rows["depth"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def partition(loads: np.ndarray, budget: int) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Of each prefix length: the group of each bucket (-1: extend the prefix), and the parts of each bucket at the last.

    Also the first group of each length. Groups are filled bucket after bucket up to about the budget.
    """
    groups, starts, begin = [], [], 0
    for load in loads:
        light = np.where(load <= budget, load, 0)
        place = begin + np.cumsum(light) // budget
        groups.append(np.where(load <= budget, place, -1))
        starts.append(begin)
        begin = int(place[-1]) + 1
    parts = np.where(loads[-1] > budget, -(-loads[-1] // budget), 0)
    ends = begin + np.cumsum(parts)
    return groups, [parts, ends - parts], [*starts, begin]


def _dealt(prefix: np.ndarray, bits: int, plan) -> tuple[np.ndarray, np.ndarray]:
    """The group of each suffix, and the length of the prefix by which it was dealt."""
    groups, (parts, begin), _ = plan
    group = np.full(prefix.shape[1], -1, dtype=np.int64)
    depth = np.full(prefix.shape[1], DEPTH, dtype=np.int32)
    for k in range(DEPTH - 1):
        left = np.flatnonzero(group < 0)
        group[left] = groups[k][(prefix[k, left] >> np.uint64(64 - bits)).astype(np.int64)]
        depth[left[group[left] >= 0]] = k + 1
    left = np.flatnonzero(group < 0)
    bucket = (prefix[-2, left] >> np.uint64(64 - bits)).astype(np.int64)
    group[left] = begin[bucket] + (prefix[-1, left] % parts[bucket].astype(np.uint64)).astype(np.int64)
    return group, depth


_SENT = pa.schema([("group", pa.int64()), ("depth", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])


def _sent(texts: DataFrame, bits: int, plan) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(plan)  # at most 2^MOST_BITS numbers a prefix length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, slices in _slices(batches):
            for lang, codes, n, prefix in slices:
                group, depth = _dealt(prefix, bits, shared.value)
                order = np.argsort(group, kind="stable")
                codes, n, depth, group = codes[order], n[order], depth[order], group[order]
                ends = [*np.flatnonzero(np.diff(group) != 0) + 1, len(group)] if len(group) else []
                begin = 0
                for end in ends:
                    held = np.zeros(len(words), dtype=bool)
                    held[codes[begin:end]] = held[0] = True  # 0 stays the end of a piece
                    used = np.flatnonzero(held)
                    own = (np.cumsum(held) - 1)[codes[begin:end]]
                    listed = b"\n".join([words[w] for w in used[1:].tolist()])
                    yield pa.RecordBatch.from_pylist([{
                        "group": int(group[begin]), "depth": int(depth[begin]), "lang": lang, "words": listed,
                        "codes": own.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes(),
                        "counts": n[begin:end].astype("<u4").tobytes()}], _SENT)
                    begin = end

    return texts.mapInArrow(run, "group long, depth int, lang string, words binary, codes binary, counts binary")


_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])


def _subtree(rows: list[dict], least: int) -> tuple[list[str], list[int], list[int]]:
    """Phrases, their numbers of words and counts: the nodes of one group and language; the root is the empty phrase."""
    numbers, codes, counts = _Numbers(), [], []
    for row in rows:
        place = np.array([0, *map(numbers.__getitem__, row["words"].split(b"\n"))])
        counts.append(np.frombuffer(row["counts"], dtype="<u4").astype(np.int64))
        width = len(row["codes"]) // (DEPTH * len(counts[-1]))
        codes.append(place[np.frombuffer(row["codes"], dtype=f"<u{width}").astype(np.int64)].reshape(-1, DEPTH))
    code, n = np.concatenate(codes), np.concatenate(counts)
    pairs = [code[:, k] * len(numbers) + code[:, k + 1] for k in (0, 2)]
    order = np.lexsort((pairs[1], pairs[0]))
    code, n, words = code[order], n[order], list(numbers)
    phrases, sizes, totals = [""], [0], [int(n.sum())]
    fresh = np.zeros(len(code), dtype=bool)
    fresh[0] = True
    for k in range(DEPTH):
        fresh[1:] |= code[1:, k] != code[:-1, k]
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(n, at)
        wanted = code[at, k] > 0
        if k + 1 >= rows[0]["depth"]:  # complete here; shorter prefixes may lie in other groups as well
            wanted &= total >= least
        for place, count in zip(at[wanted].tolist(), total[wanted].tolist(), strict=True):
            phrases.append(b" ".join([words[w] for w in code[place, :k + 1].tolist()]).decode())
            sizes.append(k + 1)
            totals.append(count)
    return phrases, sizes, totals


def frequencies(docs: DataFrame, least: int = 30, budget: int = BUDGET) -> DataFrame:
    """(lang, phrase, k, f): the exact count f >= least of each phrase of k = 1 to 4 words; k = 0: of all words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = min(MOST_BITS, max(12, math.ceil(math.log2(size / budget + 1)) + 2))
    sent = _sent(texts, bits, partition(_loads(texts, bits), budget))

    def build(group: pa.Table) -> pa.Table:
        by_lang: dict[str, list[dict]] = {}
        for row in group.to_pylist():
            by_lang.setdefault(row["lang"], []).append(row)
        out = []
        for lang, rows in by_lang.items():
            phrases, sizes, totals = _subtree(rows, least)
            out.append(pa.table([pa.array([lang] * len(phrases)), pa.array(phrases), pa.array(sizes, pa.int32()), pa.array(totals)], schema=_COUNTED))
        return pa.concat_tables(out)

    nodes = sent.groupBy("group").applyInArrow(build, "lang string, phrase string, k int, f long")
    return nodes.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("k") == 0, 1).otherwise(least))


def _part(begin: Column, size: Column) -> Column:
    return F.array_join(F.slice("_w", begin, size), " ")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, budget: int = BUDGET, salts: int = 64) -> DataFrame:
    """The `top` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    docs has lang (null: `und`) and text (null: empty). A-Z is lower-cased, texts end pieces at
    `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. A phrase has 2 to 4 words of one piece, and occurs
    a >= least times (overlaps count). Its score is the least of
    floor(2000000 * a / (l + r)) over its cuts into a first part with l and a rest with r
    occurrences, at ties the first cut's. Phrases inside a longer one that is found at
    least 0.8 times as often are left out. Order: score, then a, both descending, then the
    phrase's bytes. Repeated rows count as often as they occur, so ties in all three don't exist. Empty
    texts and an empty table give no rows; columns of docs but lang and text are left out,
    whatever their names. Texts of any length are read whole; a slice of one text is as long as it.
    """
    found = written(frequencies(docs, least, budget), "phrases")
    some = found.where("k >= 2").withColumn("_w", F.split("phrase", " "))
    parts = found.where("k >= 1").select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    cuts = (
        some.select("lang", "phrase", F.col("f").alias("a"), "_w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
        .select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("_left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right"))
        .join(parts.withColumnsRenamed({"_part": "_left", "_f": "l"}), ["lang", "_left"])
        .join(parts.withColumnsRenamed({"_part": "_right", "_f": "r"}), ["lang", "_right"])
        # decimals: the product may pass 64 bits
        .withColumn("score", F.floor(F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")).cast("long")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_best"))
    inside = (
        some.where("k >= 3").select("lang", "f", "_w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("_size"))
        .select("lang", "f", "_w", "_size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("_size") + 1)).alias("_at"))
        .groupBy("lang", _part(F.col("_at"), F.col("_size")).alias("phrase")).agg(F.max("f").alias("_longer")))
    own = (
        scored.join(inside, ["lang", "phrase"], "left")
        .where(F.col("_longer").isNull() | (_exact("_longer") * 100 < _exact("a") * 80))
        .select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task sees all its phrases
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    few = own.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
