"""Jaccard join of word n-gram sets with signature trees.

Equal sets are collapsed into classes first. Sets at the similarity asked for
share a token among their first ones in any fixed order of tokens (prefix
filter); the order is by hash, with tokens that many documents hold last. Sets
meet by equi-join on prefix tokens. Within a group that shares a token, a
signature tree is built: its nodes hold OR-combined token bitmaps and size
ranges, and a dual traversal leaves out node pairs whose sizes or whose largest
possible overlap rule a link out, and pairs that are already in one component.
What remains are candidates, which are compared in full.

A group emits a forest of candidates, not all its pairs: rows attach to the
first row that may be similar, and rows that are certain to be connected if the
candidates hold need no more. Verified links contract components, candidates
that failed are remembered, and groups that emitted anything run again until
none does; so every pair of different components has been ruled out. Groups
beyond a page are spread over pages: in the first round only a few leaders visit
all pages; later, rows of the group's main component stay in their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import mixed, released, text_of, written
from formproof.llm.links import components

BITS = 2048
PAGE = 1024
LEADERS = 32
FAN = 16
#: At most so many frequent tokens are sent to the tasks (8 bytes each).
FREQUENT = 1 << 19
_SCALE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


#: Words of a slice of texts, and words whose hashes a task remembers.
SLICE_WORDS, REMEMBERED = 1 << 18, 1 << 17


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _rolled(hashed: np.ndarray, span: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(len(hashed) - span + 1, span, dtype=np.uint64)
        for i in range(span):
            out = mixed(out * _SCALE[i % 4] + hashed[i:len(hashed) - span + 1 + i])
    return out


def shingles(texts: Iterator[str | None], words: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its word n-grams; of a shorter text the whole sequence.

    Texts are cut and hashed in slices; n-grams across two texts are left out.
    """
    known = _Hashes()

    def worked(cuts: list[list[bytes]]) -> Iterator[np.ndarray]:
        if len(known) > REMEMBERED:
            known.clear()
        hashed = np.fromiter((known[w] for cut in cuts for w in cut), dtype=np.uint64, count=sum(map(len, cuts)))
        rolled = _rolled(hashed, words) if len(hashed) >= words else hashed[:0]
        begin = 0
        for cut in cuts:
            end = begin + len(cut)
            if len(cut) >= words:
                yield np.unique(rolled[begin:end - words + 1])
            else:
                yield _rolled(hashed[begin:end], len(cut)) if cut else np.empty(0, np.uint64)
            begin = end

    waiting, size = [], 0
    for text in texts:
        waiting.append((text or "").encode().lower().split())  # bytes: lower-cases A-Z, splits at [\x20\x09-\x0D]
        size += len(waiting[-1])
        if size >= SLICE_WORDS:
            yield from worked(waiting)
            waiting, size = [], 0
    yield from worked(waiting)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return tuple(int(np.uint64(x).astype(np.int64)) for x in (both >> 64, both & 0xFFFFFFFFFFFFFFFF))


def _prefix(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which a similar set must share one: the first in the order (frequent ones last, by rank)."""
    n = len(tokens)
    take = n - (-(-percent * n // 100)) + 1
    if not len(frequent):
        return tokens[:take]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = frequent[at] == tokens
    rare = tokens[~often]
    if len(rare) >= take:
        return rare[:take]
    late = tokens[often]
    return np.concatenate([rare, late[np.lexsort((late, rank[at[often]]))][:take - len(rare)]])


def _bitmap(tokens: np.ndarray) -> bytes:
    bits = np.zeros(BITS, dtype=bool)
    bits[(tokens >> np.uint64(20)) & np.uint64(BITS - 1)] = True
    return np.packbits(bits).tobytes()


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.uint64).view(np.int64)


def _sets(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """doc_id, n, h1, h2 (hash of the set), prefix, bits of every document."""
    schema = T.StructType([
        docs.schema["doc_id"], *T._parse_datatype_string("n long, h1 long, h2 long, prefix array<long>, bits binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value
        for batch in batches:
            sets = list(shingles((t.as_py() for t in batch.column(1)), words))
            hashed = [_digest(s) for s in sets]
            first = [_signed(_prefix(s, often, rank, percent)) if len(s) else _signed(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([h[0] for h in hashed], pa.int64()), pa.array([h[1] for h in hashed], pa.int64()),
                pa.array(first, pa.list_(pa.int64())), pa.array(map(_bitmap, sets), pa.binary())],
                names=["doc_id", "n", "h1", "h2", "prefix", "bits"])

    return docs.select("doc_id", text_of()).mapInArrow(run, schema)


def _tokens(docs: DataFrame, words: int, share: float) -> DataFrame:
    """(key, toks) with the first share of each set's tokens by hash."""
    schema = T.StructType([T.StructField("key", docs.schema["doc_id"].dataType), T.StructField("toks", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles((t.as_py() for t in batch.column(1)), words))
            lists = [_signed(s[:int(np.ceil(share * len(s)))]) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["key", "toks"])

    return docs.select("doc_id", text_of()).mapInArrow(run, schema)


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that more documents than a limit hold, sorted, with their counts.

    Counts cover the lower quarter by hash of every set, whence prefixes come.
    The limit is at least 16 and so large that FREQUENT tokens exceed it at
    most; it only orders tokens and decides no result.
    """
    counts = written(
        _tokens(docs, words, 0.25).select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 16"), "token_counts")
    limit, by_size = 16, counts.groupBy(F.floor(F.log2(F.col("c"))).alias("k")).count().collect()  # at most 64 rows
    while sum(r["count"] for r in by_size if 2 ** (r.k + 1) > limit) > FREQUENT:
        limit *= 2
    rows = counts.where(F.col("c") > limit).toPandas()
    tokens = rows["t"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["c"].to_numpy(dtype=np.int64)[order]


class _Tree:
    """Rows in order of size, and levels of nodes over them: OR of bitmaps, size range, least excess."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, n, n, excess)]
        while len(self.levels[-1][1]) > FAN:
            b, low, high, e = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut),
                np.maximum.reduceat(high, cut), np.maximum.reduceat(e, cut)))

    def partners(self, bits: np.ndarray, n: int, excess: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be similar to a set, and their common bits: nodes are entered from the top while their bound allows."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            b, low, high, e = (x[nodes] for x in self.levels[depth])
            common = np.bitwise_count(b & bits).sum(1, dtype=np.int64)
            overlap = common + np.minimum(e, excess)
            # overlap / (n + m - overlap) >= percent / 100 for the smallest size m in the node that sizes allow
            fits = (percent * low <= 100 * n) & (100 * high >= percent * n)
            fits &= overlap * (100 + percent) >= percent * (n + np.maximum(low, -(-percent * n // 100)))
            nodes, common = nodes[fits], common[fits]
            if depth:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        return nodes, common


class _Page:
    """Rows of posts as arrays; part() is a group of them."""

    def __init__(self, table: pa.Table):
        self.t, self.page, self.home, self.roams, self.rep, self.n, self.comp = (
            table[c].to_numpy() for c in ("t", "page", "home", "roams", "rep", "n", "comp"))
        self.bits = np.frombuffer(b"".join(table["bits"].to_pylist()), dtype=np.uint64).reshape(len(self.t), -1)
        self.failed = [set(x) if x else () for x in table["failed"].to_pylist()]

    def pairs_of_two(self, at: np.ndarray, percent: int, first_round: bool) -> list[tuple[int, int, int]]:
        """Candidates of the groups of two rows that begin at `at`."""
        i, j = at, at + 1
        common = np.bitwise_count(self.bits[i] & self.bits[j]).sum(1, dtype=np.int64)
        spare = self.n - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        fits = (self.comp[i] != self.comp[j]) & (100 * low >= percent * high)
        fits &= (common + np.minimum(spare[i], spare[j])) * (100 + percent) >= percent * (low + high)
        out = []
        for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
            a, b = (x, y) if self.rep[x] < self.rep[y] else (y, x)
            if self.rep[a] not in self.failed[b]:
                out.append((int(self.t[a]), int(self.rep[a]), int(self.rep[b])))
        return out

    def forest(self, begin: int, end: int, percent: int, first_round: bool) -> list[tuple[int, int, int]]:
        part = slice(begin, end)
        order = np.lexsort((self.rep[part], self.n[part])) + begin
        t = int(self.t[begin])
        pairs = _forest(self.rep[order], self.comp[order], self.home[order] == self.page[order], self.roams[order],
                        [self.failed[i] for i in order], self.bits[order], self.n[order], percent, first_round)
        return [(t, a, b) for a, b in pairs]


def _forest(rep, comp, here, free, failed, bits, n, percent: int, first_round: bool) -> list[tuple[int, int]]:
    """Candidate pairs that would connect all rows of a page (in order of size) that may be connected."""
    tree = _Tree(bits, n)
    excess = tree.levels[0][3]
    label = np.unique(comp, return_inverse=True)[1]
    out = []
    for i in np.argsort(rep, kind="stable"):
        if not first_round and not free[i]:
            continue  # rows of the main component meet the others when those take their turn
        if (label == label[0]).all():
            break
        near, common = tree.partners(bits[i], int(n[i]), int(excess[i]), percent)
        open_ = (label[near] != label[i]) & (here[i] | here[near])
        near, common = near[open_], common[open_]
        order = np.argsort(rep[near], kind="stable")
        near, common = near[order], common[order]
        if failed[i]:
            left = np.array([rep[j] not in failed[i] for j in near], dtype=bool)
            near, common = near[left], common[left]
        near_certain = common * 103 >= (percent + 3) * (n[i] + n[near] - common)
        doubtful = 0
        for sure in (True, False):
            which = near[near_certain == sure]
            if sure or first_round:  # one of each component; later all that are in doubt, as most of them fail
                which = which[np.sort(np.unique(label[which], return_index=True)[1])]
            for j in which:
                if label[j] == label[i] or (rep[i] in failed[j]):
                    continue
                out.append((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
                if sure:
                    label[label == label[j]] = label[i]
                else:
                    doubtful += 1
                    if doubtful == (4 if first_round else 256):
                        break  # the group runs again with what these have shown
    return out


def _candidates(posts: DataFrame, facts: DataFrame, percent: int, first_round: bool) -> DataFrame:
    """(t, a, b) from the groups of posts (t, rep); facts has rep, n, bits, comp, failed of each set.

    Bitmaps join the rows last, so that they are moved once.
    """
    rows = posts.join(facts.select("rep", "comp"), "rep")
    each = rows.groupBy("t", "comp").agg(F.count("*").alias("c"))
    stats = each.groupBy("t").agg(F.sum("c").alias("m"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("kinds"))
    pages = F.ceil(F.col("m") / PAGE).cast("int")
    roams = (F.pmod(F.xxhash64("rep"), F.col("m")) < LEADERS) if first_round else (F.col("comp") != F.col("main"))
    rows = (
        rows.drop("m").join(stats.where("kinds > 1"), "t")
        .withColumn("pages", pages).withColumn("home", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("pages")).cast("int"))
        .withColumn("roams", roams)
        .withColumn("page", F.explode(F.when(F.col("roams"), F.sequence(F.lit(0), F.col("pages") - 1)).otherwise(F.array("home"))))
        .select("t", "page", "home", "roams", "rep", "comp").join(facts.drop("comp"), "rep"))
    tasks = 2 * int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few and dear: not merged by size
    columns = ["t", "page", "home", "roams", "rep", "n", "bits", "comp", "failed"]
    paged = rows.select(columns).repartition(tasks, "t", "page").sortWithinPartitions("t", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_none(batches):
            held = [x for x in (rest, batch) if x is not None]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            t, page = table["t"].to_numpy(), table["page"].to_numpy()
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (page[1:] != page[:-1])) + 1
            whole = len(t) if batch is None else (int(cuts[-1]) if len(cuts) else 0)
            rest = None if batch is None else table.slice(whole).combine_chunks().to_batches()[0]
            if not whole:
                continue
            rows = _Page(table.slice(0, whole))
            edges = np.concatenate([[0], cuts[cuts < whole], [whole]])
            sizes = np.diff(edges)
            out = rows.pairs_of_two(edges[:-1][sizes == 2], percent, first_round)
            for begin, size in zip(edges[:-1].tolist(), sizes.tolist(), strict=True):
                if size > 2:
                    out += rows.forest(begin, begin + size, percent, first_round)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["t", "a", "b"])

    return paged.mapInArrow(run, "t long, a long, b long")


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs with ok: whether the whole sets are similar."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("toks").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("toks").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared * 100 >= percent * (F.size("x") + F.size("y") - shared)).alias("ok"))


def similar_sets(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each document.

    Two documents link when 100 * intersection >= percent * union of their sets
    of distinct word n-grams (words lower-cased in A-Z). A text of fewer words is
    one n-gram; without words the set is empty and links with nothing, and the
    component is the document itself. doc_id is a long; rows of one doc_id are
    one node, a row without doc_id keeps a null component unless it has equals
    that have one. Columns of docs but doc_id are left out. Rows are never
    dropped; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(_frequent(docs, words))
    whole = written(_sets(docs, words, percent, frequent), "sets")
    classes = written(whole.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"),
        F.min_by("prefix", "doc_id").alias("prefix"), F.min_by("bits", "doc_id").alias("bits")), "set_classes")
    sets = written(whole.select("doc_id", "n", "h1", "h2"), "set_ids")
    released(whole, spark=spark)
    labels = _linked(docs, classes.where("rep is not null"), words, percent)
    named = classes.select("h1", "h2", "rep").join(
        labels.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("_c"))
    rows = sets.join(named, ["h1", "h2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))


def _linked(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the representatives that have links."""
    spark = docs.sparkSession
    entries = classes.select("rep", F.explode("prefix").alias("t"))
    met = entries.groupBy("t").agg(F.count("*").alias("m")).where("m > 1")
    posts = written(entries.join(met, "t").select("t", "m", "rep"), "set_posts")
    links = failed = label = sets = None
    while True:
        first_round = label is None
        facts = classes.select("rep", "n", "bits").join(posts.select("rep").distinct(), "rep", "left_semi")
        if first_round:
            facts = facts.withColumns({"comp": F.col("rep"), "failed": F.lit(None).cast("array<long>")})
        else:
            lost = failed.groupBy(F.col("b").alias("rep")).agg(F.collect_set("a").alias("failed"))
            facts = facts.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
                "comp", F.coalesce("component", "rep")).drop("component").join(lost, "rep", "left")
        found = written(_candidates(posts, facts, percent, first_round), "set_candidates")
        again = found.select("t").distinct()
        if first_round:
            again = again.unionByName(posts.where(F.col("m") > PAGE).select("t")).distinct()
        if again.isEmpty():
            break
        posts = written(posts.join(again, "t", "left_semi"), "set_posts")
        released(spark=spark)
        if sets is None:
            wanted = posts.select(F.col("rep").alias("doc_id")).distinct()
            texts = docs.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text"))
            sets = written(_tokens(texts, words, 1.0), "set_tokens")
            released(spark=spark)
        # In the first round each set tries the smallest of its candidates only: most groups agree on it.
        pairs = found.groupBy("b").agg(F.min("a").alias("a")) if first_round else found.select("a", "b").distinct()
        checked = written(_verified(pairs, sets, percent), "set_checked")
        good, bad = checked.where("ok").select("a", "b"), checked.where("not ok").select("a", "b")
        links = good if links is None else links.unionByName(good)
        failed = bad if failed is None else failed.unionByName(bad)
        label = written(components(links), "set_labels")
        released(spark=spark)
    return label if label is not None else spark.createDataFrame([], "id long, component long")
