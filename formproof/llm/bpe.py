"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each task.

The text is cut by the tokenizer's pattern. The distinct words of a batch become
token-position rows (one a byte); a recursive query joins neighbouring tokens
with the merge table, contracts each word's leftmost pair of minimum rank, and
goes on until no word has a pair left. An ordered aggregation of token bytes
decodes. Encoded chunks of text, and the words they are made of, are kept in a cache of bounded size per worker. A word of
more than LONG_WORD bytes, for which a contraction a step would be quadratic,
merges over a heap instead, in the same order.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import heapq
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_WORD = 256
CACHED_CHUNKS = 250_000
#: Words merge together up to this sum of squared lengths, as the recursion keeps each step's rows.
MERGED = 1 << 22
#: The pattern whose matches lie inside the matches of CHUNK: texts are cut into chunks first, and only unknown chunks into words.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = r" ?\S+|\s+(?!\S)|\s+"
MARKS = tuple(".,;:!?")
#: Texts are worked on in slices of about so many characters, to bound memory.
SLICE_CHARS = 1 << 20

# Token-position rows join the merge table and gather by word: ids, and of each token the rank of its pair with the next
# (NONE at the end). Each step contracts a word's leftmost pair of minimum rank; only the two pairs beside it join again.
_ENCODE = """
with recursive step as (
    select word, ids, ranks, list_min(ranks) as best
    from (select s.word, list(s.id order by s.pos) as ids, list(coalesce(m.id, $none) order by s.pos) as ranks
          from seed s left join merges m on m.l = s.id and m.r = s.nid group by s.word)
    union all
    select word, ids, ranks, list_min(ranks)
    from (select x.word, x.ids[:x.p - 1] || [x.best] || x.ids[x.p + 2:] as ids,
              case when x.p > 1 then x.ranks[:x.p - 2] || [coalesce(a.id, $none)] else [] end
                  || [coalesce(b.id, $none)] || x.ranks[x.p + 2:] as ranks
          from (select word, ids, ranks, best, list_position(ranks, best) as p from step where best < $none) x
          left join merges a on a.l = x.ids[x.p - 1] and a.r = x.best
          left join merges b on b.l = x.best and b.r = x.ids[x.p + 2])
)
select word, unnest(ids) as id, generate_subscripts(ids, 1) as pos from step where best = $none order by word, pos
""".replace("$none", "2147483647")
_DECODE = """
select doc, string_agg(hex, '' order by pos) as hex
from tokens join vocab using (id) group by doc
"""


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class Codec:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = parse_ranks(content)
        self.find = regex.compile(pattern).findall
        self.chunks = regex.compile(CHUNK).findall if pattern == SPACED else self.find
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # ids and decoded bytes of chunks
        self.before: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # the cache's last generation
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, whole = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), id=pa.array(whole, pa.int32()))
        self._table("vocab", id=pa.array(self.ranks.values(), pa.int32()), hex=pa.array([t.hex() for t in self.ranks]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _merge(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]
        out = [b""] * len(raw)
        if short:
            sizes = np.fromiter((len(raw[i]) for i in short), dtype=np.int64)
            ends = np.cumsum(sizes)
            pos = (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32)
            ids = self.byte_id[np.frombuffer(b"".join(raw[i] for i in short), dtype=np.uint8)]
            nid = np.append(ids[1:], np.int32(-1))
            nid[ends - 1] = -1
            self.db.register("seed", pa.table({
                "word": np.repeat(np.arange(len(short), dtype=np.int32), sizes), "pos": pos, "id": ids, "nid": nid}))
            got = self.db.execute(_ENCODE).fetchnumpy()
            self.db.unregister("seed")
            word, ids = np.asarray(got["word"]), np.asarray(got["id"]).astype("<u4")
            stops = [0, *np.searchsorted(word, np.arange(len(short)), side="right").tolist()]
            for k, i in enumerate(short):
                out[i] = ids[stops[k]:stops[k + 1]].tobytes()
        for i, w in enumerate(raw):
            if len(w) > LONG_WORD:
                out[i] = np.array(self._merge_long(w), dtype="<u4").tobytes()
        return out

    def forget(self) -> None:
        """Empty the cache, so that a worker does not carry it into its next task, whatever that is."""
        self.known, self.before = ({}, {}), ({}, {})
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)  # freed memory goes back to the system

    def _cut(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk; of a word of letters, with a mark after it or not, they are plain."""
        if self.chunks is not self.find:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word[-1:] in MARKS and word[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Encode and decode the words of chunks that the cache lacks; a word is a chunk as well."""
        several = {c: ws for c in chunks if len(ws := self._cut(c)) > 1}
        words = list({*(c for c in chunks if c not in several), *(w for ws in several.values() for w in ws)})
        ids, begin, size = [], 0, 0
        for i, word in enumerate(words):
            size += min(len(word), LONG_WORD) ** 2
            if size >= MERGED or i + 1 == len(words):
                ids += self._merge(words[begin:i + 1])
                begin, size = i + 1, 0
        for known, values in zip(self.known, (ids, self.decode(ids)), strict=True):
            known.update(zip(words, values, strict=True))
            of = known.__getitem__
            known.update([(c, b"".join(map(of, ws))) for c, ws in several.items()])

    def _merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[i] != middle or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(word[i:end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if before[i] >= 0 and (r := self.ranks.get(word[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], i, stop))
        return [self.ranks[word[i:end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Of each text the token ids, as little-endian unsigned 32-bit integers, and the bytes they stand for."""
        cut = [self.chunks(t) for t in texts]
        every = set().union(*cut)
        if len(self.known[0]) + len(every) > CACHED_CHUNKS:
            self.before, self.known = self.known, ({}, {})
        lacking = every.difference(self.known[0])
        again = lacking.intersection(self.before[0])
        for known, before in zip(self.known, self.before, strict=True):
            known.update((c, before[c]) for c in again)
        if new := list(lacking - again):
            self._learn(new)
        return tuple([b"".join(map(known.__getitem__, cs)) for cs in cut] for known in self.known)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        sizes = np.array([len(x) // 4 for x in ids])
        if not sizes.sum():
            return [b""] * len(ids)
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        self.db.register("tokens", pa.table({
            "doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes),
            "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        got = dict(self.db.execute(_DECODE).fetchall())
        self.db.unregister("tokens")
        return [bytes.fromhex(got.get(i, "")) for i in range(len(ids))]


@cache
def _codec(content: bytes, pattern: str) -> Codec:
    return Codec(content, pattern)


def _slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _mapped(df: DataFrame, source: str, targets: list[str], vocabulary: str, pattern: str) -> DataFrame:
    """df with targets (ids, decoded) made from column source, batch by batch."""
    with open(vocabulary, "rb") as f:  # a vocabulary, not data: it has a fixed size
        content = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c not in targets]
    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(t, T.BinaryType()) for t in targets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        try:
            for batch in batches:
                values = batch.column(len(kept)).to_pylist()
                for begin, end in _slices(values, SLICE_CHARS):
                    now = values[begin:end]
                    made = [codec.decode(now)] if source == "ids" else codec.encode(now)
                    part = batch.slice(begin, end - begin)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in range(len(kept))), *(pa.array(m, pa.binary()) for m in made[:len(targets)])],
                        names=[*kept, *targets])
        finally:
            codec.forget()

    given = F.coalesce(source, F.lit("" if source == "text" else b""))
    return df.select(*kept, given.alias("_in")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit token ids) of the whole text.

    A null or empty text has no ids. Rows are worked on one by one: repeated
    rows, ties and extra columns pass through; a column named ids is replaced.
    """
    return _mapped(docs, "text", ["ids"], vocabulary, pattern)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """encode(), and `decoded` (binary): the bytes that the ids stand for, decoded chunk by chunk."""
    return _mapped(docs, "text", ["ids", "decoded"], vocabulary, pattern)


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """tokens with `decoded` (binary) made from their column `ids`; null counts as no ids."""
    return _mapped(tokens, "ids", ["decoded"], vocabulary, pattern)
