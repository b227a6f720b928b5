"""Sparse text classifier with answer interactions, held as tables.

Everything the model knows is a table: a row per feature with its block, term,
idf and coefficient.  A row of instances becomes long entries (block, term,
count); scores are a join with that table and a sum, explanations a join and a
short list.  Only words and characters, whose features have a configured limit, are
collected, to be looked up by number; other vocabulary and categories have no limit.

``fit_folds`` fits one model per fold of several splits.  Texts are cut into
entries once; document frequencies are counted per fold, and a fold's training
frequencies are the totals less its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.plan import once, rows_of
from ..functions.ranking import hashed_rank
from ..functions.text import WHITESPACE, is_blank, let, usable
from ..session import scratch_dir

KEYS = ("record_id", "pair_id")
CATEGORIES = ("pair_id", "test_id", "structured_value")
TEXT_BLOCKS = ("word", "char", "cross")
CAPPED = ("word", "char")  # blocks of a configured size: every task can hold their features


@dataclass(frozen=True)
class TextModelConfig:
    c: float = 1.0
    max_word_features: int = 30_000
    max_char_features: int = 30_000
    word_min_df: int = 2
    char_min_df: int = 3
    categories: Sequence[str] = CATEGORIES
    max_iter: int = 500
    tol: float = 5e-3  # of the gradient


def answer_and_text() -> Column:
    """H1: answer and explanation as one string."""
    return F.concat(
        F.lit("ANSWER "), F.col("structured_value"), F.lit(" [SEP] "), F.col("free_text")
    )


def word_grams(text: Column) -> Column:
    """H3: words of two or more characters, then their bigrams."""
    def both(words: Column) -> Column:
        pairs = F.zip_with(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
            F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(words, pairs)

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), both)


def _chunks(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[{WHITESPACE}]+"), lambda w: F.length(w) > 0)


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """H4: character n-grams of each blank-padded word."""
    padded = F.transform(_chunks(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        return F.when(
            F.length(w) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))),
                lambda i: F.substring(w, i, F.lit(n)),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(
        F.transform(
            padded, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])
        )
    )


_TOKEN = r"[a-z][a-z'-]+"


def _answer_side() -> Column:
    """What H2 puts before a token: the answer's polarity and test."""
    polarity = F.when(F.col("is_outside_leaning"), "OUT").otherwise("IN")
    return F.concat(polarity, F.lit("~"), F.col("test_id"), F.lit("~"))


def interaction_tokens() -> Column:
    """H2: each text token crossed with the answer's polarity and test."""
    tokens = F.regexp_extract_all(F.lower("free_text"), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.concat(_answer_side(), t))


def written(df: DataFrame, purpose: str, partition: Sequence[str] = ()) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dense() -> Mapping[str, Column]:
    """H7: polarity, usability, length, anomaly."""
    return {
        "is_outside": F.col("is_outside_leaning").cast("double"),
        "usable_text": usable(F.col("free_text")).cast("double"),
        "length": F.least(F.length("free_text"), F.lit(400)) / 400.0,
        "anomaly": (~is_blank(F.col("anomaly"))).cast("double"),
    }


def _char_counts(chunks: Sequence[str], low: int = 3, high: int = 5) -> dict[str, int]:
    """How often each of ``char_grams`` occurs; repeated words are cut once."""
    counts: dict[str, int] = {}
    for word, times in Counter(chunks).items():
        padded = f" {word} "
        for n in range(low, high + 1):
            for at in range(len(padded) - n + 1):
                gram = padded[at:at + n]
                counts[gram] = counts.get(gram, 0) + times
    return counts


class _Packing:
    """Character n-grams as numbers: 12 bits for each character of those met so far, of which the blank is the first."""

    BITS, MOST = 12, 4095

    def __init__(self) -> None:
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.chars = np.zeros(self.MOST + 1, dtype=np.uint32)
        self.known = 0
        self.learn(np.array([32], dtype=np.uint32))

    def learn(self, codes: np.ndarray) -> bool:
        """Number the characters; False, and nothing learnt, where they are too many."""
        new = np.unique(codes[self.number[codes] == 0])
        if self.known + len(new) > self.MOST or 0 in new:
            return False
        at = np.arange(self.known + 1, self.known + len(new) + 1)
        self.number[new], self.chars[at] = at, new
        self.known += len(new)
        return True

    def of(self, terms: Sequence[str]) -> np.ndarray | None:
        """The numbers of n-grams; None where their characters are too many."""
        codes = np.array(terms, dtype="U5").reshape(-1, 1).view(np.uint32).reshape(len(terms), 5)
        if any("\0" in t for t in terms) or not self.learn(codes[codes > 0]):
            return None
        return (self.number[codes].astype(np.int64) << (self.BITS * np.arange(5))).sum(axis=1)

    def terms(self, keys: np.ndarray) -> pa.Array:
        codes = self.chars[(keys[:, None] >> (self.BITS * np.arange(5))) & self.MOST]
        return pa.array(np.ascontiguousarray(codes).view("<U5").ravel(), pa.string())

    def rows(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers of each text's n-grams of known characters, in order, and how often each occurs."""
        codes = _codes("".join(texts))
        ids = np.append(self.number[codes].astype(np.int64), [0] * 4)
        blank, n = np.append(codes == 32, [True] * 4), len(codes)
        # a blank stands only at an end of an n-gram, so none reaches into the next text
        whole, key = ids[:n] > 0, ids[:n].copy()
        found, ends = [], np.cumsum([0, *map(len, texts)])
        for k in range(1, 5):
            whole &= ids[k:n + k] > 0
            key |= ids[k:n + k] << (self.BITS * k)
            if k >= 2:
                found.append((key[whole], np.append(0, np.cumsum(whole))[ends]))
            whole &= ~blank[k:n + k]
        for r in range(len(texts)):
            own = np.concatenate([keys[at[r]:at[r + 1]] for keys, at in found])
            own.sort()
            first = np.flatnonzero(np.diff(own, prepend=-1))
            yield own[first], np.diff(first, append=len(own))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _blank_padded(text: str) -> str:
    words = text.split()
    return f" {' '.join(words)} " if words else ""


def _totals(
    block: str, terms: pa.Array, at: np.ndarray, count: np.ndarray, row: np.ndarray, held: np.ndarray, models: int,
) -> pa.RecordBatch:
    """block, term, df, tf, and df and tf of the rows of each model's fold, of distinct entries of (row, term)."""
    n = len(terms)
    columns = [pa.array(np.bincount(at, minlength=n).astype(np.int64)), pa.array(np.bincount(at, count, n).astype(np.float64))]
    own = [np.bincount(at * models + held[row, j], minlength=n * models) for j in range(held.shape[1])]
    of = [np.bincount(at * models + held[row, j], count, n * models) for j in range(held.shape[1])]
    for sums, kind in ((own, np.int64), (of, np.float64)):
        if models:
            each = sum(sums).reshape(n, models).astype(kind)
            columns += [pa.array(np.ascontiguousarray(each[:, k])) for k in range(models)]
    label = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype=np.int8)), pa.array([block])).dictionary_decode()
    return pa.RecordBatch.from_arrays([label, terms, *columns], names=_total_names(models))


def _total_names(models: int) -> list[str]:
    return ["block", "term", "df", "tf", *[f"_df{k}" for k in range(models)], *[f"_tf{k}" for k in range(models)]]


def _distinct(row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term and count of the distinct pairs, by row."""
    pairs, count = np.unique(row.astype(np.int64) * max(1, n) + at, return_counts=True)
    return pairs // max(1, n), pairs % max(1, n), count


#: Rows, and n-grams, that are added up at once; rows that are looked up at once.
_CHUNK, _GRAMS, _LOOKED_UP = 2_000, 1 << 22, 128


def _text_totals(
    df: DataFrame, blocks: Sequence[str], held: Column | None = None, models: int = 0,
) -> DataFrame:
    """block, term, df, tf of text blocks, and _df<k>, _tf<k> of the rows that model k holds out; a row of each term a chunk of rows.

    ``held``: the numbers of the models, one of each split, that don't train on a row.
    """
    none = F.array().cast("array<string>")
    kinds = [T.StringType(), T.StringType(), T.LongType(), T.DoubleType(), *[T.LongType()] * models, *[T.DoubleType()] * models]
    schema = T.StructType([T.StructField(c, kind) for c, kind in zip(_total_names(models), kinds, strict=True)])

    def tokens_of(side: Sequence[str | None], text: Sequence[str | None]) -> tuple[list[str], list[int], list[int]]:
        terms, counts, row = [], [], []
        for r, found in enumerate(map(_cross_counts, side, text)):
            terms.extend(found)
            counts.extend(found.values())
            row.extend([r] * len(found))
        return terms, counts, row

    def listed(block: str, terms: list[str], counts: list[int], row: list[int], marks: np.ndarray) -> pa.RecordBatch:
        coded = pa.array(terms, pa.string()).dictionary_encode()
        return _totals(block, coded.dictionary, coded.indices.to_numpy(), np.array(counts, dtype=np.float64), np.array(row, dtype=np.int64), marks, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing, kept, size = _Packing(), [], 0  # keys, counts, marks of the rows

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                keys = np.concatenate([k for k, _, _ in kept])
                differing, at = np.unique(keys, return_inverse=True)
                row = np.repeat(np.arange(len(kept)), [len(k) for k, _, _ in kept])
                yield _totals("char", packing.terms(differing), at, np.concatenate([c for _, c, _ in kept]), row, np.stack([m for _, _, m in kept]), models)

        for batch in batches:
            for begin in range(0, len(batch), _CHUNK):
                words, text, side, marks = batch.slice(begin, _CHUNK).columns
                texts, n = text.to_pylist(), len(text)
                marks = marks.flatten().to_numpy().astype(np.int64).reshape(n, -1)
                if "word" in blocks:
                    coded = words.flatten().dictionary_encode()
                    lengths = np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                    row, at, count = _distinct(np.repeat(np.arange(n), lengths), coded.indices.to_numpy(), len(coded.dictionary))
                    yield _totals("word", coded.dictionary, at, count, row, marks, models)
                if "cross" in blocks:
                    yield listed("cross", *tokens_of(side.to_pylist(), texts), marks)
                if "char" not in blocks:
                    continue
                for first in range(0, n, _ROWS):
                    padded = [_blank_padded(t or "") for t in texts[first:first + _ROWS]]
                    codes = _codes("".join(padded))
                    if not packing.learn(codes):
                        yield from flush()
                        packing, kept, size = _Packing(), [], 0
                        if not packing.learn(codes):  # more characters than numbers: counted as texts
                            plain = [_char_counts(t.split()) for t in padded]
                            yield listed("char", [g for f in plain for g in f], [c for f in plain for c in f.values()],
                                         [first + r for r, f in enumerate(plain) for _ in f], marks)
                            continue
                    for r, (keys, count) in enumerate(packing.rows(padded)):
                        kept.append((keys, count, marks[first + r]))
                        size += len(keys)
                    if size >= _GRAMS:
                        yield from flush()
                        kept, size = [], 0
        yield from flush()

    words = word_grams(answer_and_text()) if "word" in blocks else none
    marks = F.array().cast("array<int>") if held is None else held
    rows = df.select(words.alias("words"), F.lower("free_text").alias("text"), _answer_side().alias("side"), marks.alias("held"))
    return rows.mapInArrow(run, schema)


def _near_entries(vocabulary: pa.Table, spark: SparkSession) -> Callable[..., Column]:
    """Of a row's words (an array) and lower-cased text: (t, v) of each term in the vocabulary (block, term, t) and its count, by block."""
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("v", T.DoubleType())]))

    @F.arrow_udf(schema)
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = shared.value
        own = {b: table.filter(pc.equal(table["block"], b)) for b in CAPPED}
        known = own["word"]["term"].combine_chunks()
        word_t, char_t = (own[b]["t"].to_numpy() for b in CAPPED)
        grams = own["char"]["term"].to_pylist()
        packing = _Packing()
        keys, plain = packing.of(grams), dict(zip(grams, char_t, strict=True))
        if keys is not None:
            order = np.argsort(keys)
            keys, char_t = keys[order], char_t[order]
        for words, text in batches:
            for begin in range(0, len(words), _LOOKED_UP):
                part, texts = words.slice(begin, _LOOKED_UP), [_blank_padded(t or "") for t in text.slice(begin, _LOOKED_UP).to_pylist()]
                n, t, v, size = len(part), [], [], np.zeros(len(part), dtype=np.int64)
                # words
                lengths = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                at = pc.fill_null(pc.index_in(part.flatten(), value_set=known), -1).to_numpy()
                row = np.repeat(np.arange(n), lengths)
                row, at, count = _distinct(row[at >= 0], at[at >= 0], len(known))
                ends = np.searchsorted(row, np.arange(n + 1))
                if keys is None:
                    each = (_char_counts(x.split()) for x in texts)
                    chars = (([plain[g] for g in f if g in plain], [c for g, c in f.items() if g in plain]) for f in each)
                else:
                    chars = (_matched(keys, char_t, *x) for x in packing.rows(texts))
                for r, (ct, cv) in enumerate(chars):
                    mine = slice(ends[r], ends[r + 1])
                    t += [word_t[at[mine]], ct]
                    v += [count[mine], cv]
                    size[r] = ends[r + 1] - ends[r] + len(ct)
                numbers = pa.array(np.concatenate(t).astype(np.int32)), pa.array(np.concatenate(v).astype(np.float64))
                yield pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.StructArray.from_arrays(numbers, names=["t", "v"]))

    return found


def _matched(keys: np.ndarray, t: np.ndarray, own: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
    hit = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
    return t[at[hit]], count[hit]


#: Rows whose counts leave a task at once.
_ROWS = 32


_COUNTS = T.ArrayType(T.StructType([
    T.StructField("block", T.StringType()), T.StructField("term", T.StringType()), T.StructField("v", T.DoubleType())]))


def _cross_counts(side: str | None, text: str | None) -> dict[str, int]:
    """How often each of ``interaction_tokens`` occurs; ``text`` is lower-cased."""
    if side is None or text is None:
        return {}
    return {side + token: times for token, times in Counter(re.findall(_TOKEN, text)).items()}


@F.arrow_udf(_COUNTS)
def _counted(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The distinct terms of each row's text blocks with their counts."""
    for columns in batches:
        for begin in range(0, len(columns[0]), _ROWS):
            terms, counts, codes, ends = [], [], [], [0]
            for words, chunks, side, text in zip(*(c.slice(begin, _ROWS).to_pylist() for c in columns), strict=True):
                for code, found in enumerate((Counter(words or ()), _char_counts(chunks or ()), _cross_counts(side, text))):
                    terms.extend(found)
                    counts.extend(found.values())
                    codes.append(np.full(len(found), code, dtype=np.int8))
                ends.append(len(terms))
            blocks = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(codes)), pa.array(TEXT_BLOCKS)).dictionary_decode()
            each = pa.StructArray.from_arrays(
                [blocks, pa.array(terms, pa.string()), pa.array(np.array(counts, dtype=np.float64))], names=["block", "term", "v"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)


def _version_counts(n: int) -> Callable[..., Column]:
    """The distinct interaction tokens of ``n`` versions of a row's text, with their counts in each, v0, v1 and so on."""
    names = ["term", *[f"v{k}" for k in range(n)]]
    kinds = [T.StringType(), *[T.DoubleType()] * n]
    schema = T.ArrayType(T.StructType([T.StructField(c, kind) for c, kind in zip(names, kinds, strict=True)]))

    @F.arrow_udf(schema)
    def counted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for begin in range(0, len(columns[0]), _ROWS):
                terms, counts, ends = [], [[] for _ in range(n)], [0]
                for side, *texts in zip(*(c.slice(begin, _ROWS).to_pylist() for c in columns), strict=True):
                    each = [_cross_counts(side, text) for text in texts]
                    known = list(dict.fromkeys(term for found in each for term in found))
                    terms.extend(known)
                    for held, found in zip(counts, each, strict=True):
                        held.extend(found.get(term, 0) for term in known)
                    ends.append(len(terms))
                numbers = [pa.array(np.array(held, dtype=np.float64)) for held in counts]
                rows = pa.StructArray.from_arrays([pa.array(terms, pa.string()), *numbers], names=names)
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return counted


def entries(
    df: DataFrame, cfg: TextModelConfig = TextModelConfig(), keys: Sequence[str] = KEYS,
    blocks: Sequence[str] = TEXT_BLOCKS, others: bool = True,
) -> DataFrame:
    """H1-H7: keys, block, term, v: a term's count in a text block, or a feature's value.

    ``keys`` identify a row of ``df``.  One exchange, of the texts: a row's terms are counted inside
    it.  A null category value and zero values have no entry.  ``others``: the categories and dense features.
    """
    none = F.array().cast("array<string>")
    grams = {"word": word_grams(answer_and_text()), "char": _chunks(F.col("free_text"))}
    text = F.lower("free_text") if "cross" in blocks else F.lit(None).cast("string")

    def entry(block: str, term: Column, v: Column) -> Column:
        return F.struct(F.lit(block).alias("block"), term.alias("term"), v.cast("double").alias("v"))

    single = [entry(f"x{k}", F.col(c).cast("string"), F.lit(1.0)) for k, c in enumerate(cfg.categories)]
    single += [entry("dense", F.lit(name), v) for name, v in _dense().items()]
    found = [_counted(*[grams[b] if b in blocks else none for b in grams], _answer_side(), text)] if blocks else []
    found += [F.array(*single)] if others else []
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows_of(df.repartition(partitions, *keys), F.concat(*found), keys, "term")
    return rows.where(F.col("v") != 0)


@dataclass
class EntryParts:
    """``entries`` as two tables: those of the capped blocks, which need a vocabulary, and all others."""

    df: DataFrame
    cfg: TextModelConfig
    keys: tuple[str, ...]
    blocks: tuple[str, ...]

    @property
    def far(self) -> DataFrame:
        return entries(self.df, self.cfg, self.keys, [b for b in self.blocks if b not in CAPPED])

    @property
    def capped(self) -> list[str]:
        return [b for b in self.blocks if b in CAPPED]

    def near(self, vocabulary: pa.Table) -> DataFrame:
        """keys, e: array of (t, v): the terms of capped blocks that a row has, with their counts."""
        spark = self.df.sparkSession
        words = word_grams(answer_and_text()) if "word" in self.blocks else F.array().cast("array<string>")
        text = F.lower("free_text") if "char" in self.blocks else F.lit(None).cast("string")
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.df.repartition(partitions, *self.keys)
        return rows.select(*self.keys, _near_entries(vocabulary, spark)(words, text).alias("e"))


def entry_parts(
    df: DataFrame, cfg: TextModelConfig = TextModelConfig(), keys: Sequence[str] = KEYS, blocks: Sequence[str] = TEXT_BLOCKS,
) -> EntryParts:
    return EntryParts(df, cfg, tuple(keys), tuple(blocks))


def _is_capped() -> Column:
    return F.col("block").isin(*CAPPED)


def _met(parts: DataFrame | EntryParts, table: DataFrame, on: Sequence[str]) -> list[DataFrame]:
    """Entries joined with a table of features: the many entries of capped blocks stay where they are, as numbers."""
    if isinstance(parts, DataFrame):
        return [parts.where(_is_capped()).join(F.broadcast(table.where(_is_capped())), list(on)), parts.where(~_is_capped()).join(table.where(~_is_capped()), list(on))]
    far = parts.far.join(table.where(~_is_capped()), list(on))
    if not parts.capped:
        return [far]
    features = table.where(F.col("block").isin(*parts.capped))
    known = features.select("block", "term").distinct().toArrow()  # a bounded number of terms a model
    known = known.append_column("t", pa.array(np.arange(len(known), dtype=np.int32)))
    by = [c for c in on if c not in ("block", "term")]
    numbers = features.join(F.broadcast(features.sparkSession.createDataFrame(known)), ["block", "term"])
    near = parts.near(known).select(*parts.keys, F.inline("e")).join(F.broadcast(numbers), [*by, "t"]).drop("t")
    return [near, far]


def _each(parts: Sequence[DataFrame], what: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [what(p) for p in parts])


def _is_text() -> Column:
    return F.col("block").isin(*TEXT_BLOCKS)


def feature_name() -> Column:
    """The term, a category as x<number>_<value>, or a dense feature's name."""
    return F.when(F.col("block").startswith("x"), F.concat_ws("_", "block", "term")).otherwise(F.col("term"))


def vocabulary(counts: DataFrame, cfg: TextModelConfig, by: Sequence[str] = ()) -> DataFrame:
    """H3-H6: by, block, term, df, idf of the features of each model.

    ``counts``: by, block, term, df (rows that hold it), tf (its count), n (rows of the model).
    Words and characters are cut to the most frequent terms (ties by term), as configured.
    """
    least = F.when(F.col("block") == "char", cfg.char_min_df).when(_is_text(), cfg.word_min_df).otherwise(1)
    kept = counts.where(F.col("df") >= least)
    limit = F.when(F.col("block") == "word", cfg.max_word_features).otherwise(cfg.max_char_features)
    order = [F.desc("tf"), F.asc("term")]
    # the most frequent of each part first, so that no task sorts a whole vocabulary
    part = W.partitionBy(*by, "block", F.pmod(F.xxhash64("term"), F.lit(32))).orderBy(*order)
    whole = W.partitionBy(*by, "block").orderBy(*order)
    capped = kept.where(F.col("block").isin("word", "char"))
    for window in (part, whole):
        capped = capped.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= limit).drop("_r")
    both = capped.unionByName(kept.where(~F.col("block").isin("word", "char")))
    idf = F.when(_is_text(), F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).otherwise(1.0)
    return both.select(*by, "block", "term", "df", idf.alias("idf"))


def numbered(features: DataFrame) -> tuple[DataFrame, list[str], list[int]]:
    """block, term, i of the distinct features, numbered from 0 block by block; the blocks, and where each ends."""
    terms = features.select("block", "term").distinct()
    sizes = sorted(terms.groupBy("block").count().collect())
    ends, starts = [], {}
    for block, n in sizes:
        starts[block] = ends[-1] if ends else 0
        ends.append(starts[block] + n)
    ranked = hashed_rank(terms.withColumn("_h", F.md5("term")), ["block"], "_h", out="_i", total="_n")
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map().cast("map<string,int>")
    return ranked.select("block", "term", (F.col("_i") - 1 + start[F.col("block")]).cast("int").alias("i")), [b for b, _ in sizes], ends


def count_features(found: DataFrame, n: int) -> DataFrame:
    """block, term, df, tf over all rows of ``entries``, with the number of rows."""
    counts = found.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("v").alias("tf"))
    return written(counts, "counts").withColumn("n", F.lit(n))  # read twice


def count_terms(
    df: DataFrame, n: int, cfg: TextModelConfig = TextModelConfig(), keys: Sequence[str] = KEYS, blocks: Sequence[str] = TEXT_BLOCKS,
) -> DataFrame:
    """As ``count_features`` of all ``entries`` of ``df``; those of texts are added up where they are counted."""
    singles = entries(df, cfg, keys, ()).groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("v").alias("tf"))
    counts = singles.unionByName(_summed(_text_totals(_dealt(df, keys), blocks))) if blocks else singles
    return written(counts, "counts").withColumn("n", F.lit(n))  # read twice


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _summed(totals: DataFrame) -> DataFrame:
    return totals.groupBy("block", "term").agg(*[F.sum(c).alias(c) for c in totals.columns if c not in ("block", "term")])


def _raw() -> Column:
    """A text term's damped count by idf; any other entry's value."""
    return F.when(_is_text(), (1.0 + F.log("v")) * F.col("idf")).otherwise(F.col("v"))


def vectors(found: DataFrame | EntryParts, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H8: keys, features: array of (i, w) by i; each text block has unit length.

    ``found``: ``entries`` or ``entry_parts``; ``features``: block, term, idf, i.
    """
    parts = _met(found, features.select("block", "term", "idf", "i"), ["block", "term"])
    one = _each(parts, lambda rows: rows.withColumn("w", _raw()).groupBy(*keys, "block").agg(
        F.collect_list(F.struct("i", "w")).alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    ))
    unit = F.transform(
        "e", lambda x: F.struct(x["i"].alias("i"), F.when(_is_text(), x["w"] / F.col("norm")).otherwise(x["w"]).alias("w"))
    )
    return (
        one.withColumn("e", unit).groupBy(*keys)
        .agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("features"))
    )


@dataclass
class TextModel:
    """A fitted model, or one per value of the columns ``by``.

    ``features``: by, block, term, idf, i, coef; ``fits``: by, intercept and
    the largest violation of the optimality conditions.
    """

    features: DataFrame | None = None
    fits: DataFrame | None = None
    cfg: TextModelConfig = TextModelConfig()
    by: tuple[str, ...] = ()
    blocks: tuple[str, ...] = TEXT_BLOCKS
    name: str = "tfidf_logreg"

    def _known(self) -> DataFrame:
        if self.features is None:
            raise RuntimeError("the text model must be fitted before it can be used")
        return self.features

    def _met(self, df: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
        known = self._known().select(*self.by, "block", "term", "idf", "coef")
        return _met(entry_parts(df, self.cfg, [*keys, *self.by], self.blocks), known, [*self.by, "block", "term"])

    def score(self, df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
        """Add ``score``, the probability of the positive class.

        ``df`` carries the columns ``by``, which pick the model of each row.
        """
        keys = list(keys)
        per_block = _each(self._met(df, keys), lambda met: met.withColumn("_w", _raw()).groupBy(*keys, *self.by, "block").agg(
            F.sum(F.col("_w") * F.col("coef")).alias("_dot"), F.sum(F.col("_w") * F.col("_w")).alias("_sq")
        ))
        part = F.when(_is_text(), F.col("_dot") / F.sqrt("_sq")).otherwise(F.col("_dot"))
        margins = per_block.groupBy(*keys, *self.by).agg(F.sum(part).alias("_margin"))
        scored = df.join(margins, [*keys, *self.by], "left")
        start = self.fits.select(*self.by, "intercept")
        scored = scored.join(start, list(self.by)) if self.by else scored.crossJoin(F.broadcast(start))  # a row per model
        total = F.coalesce("_margin", F.lit(0.0)) + F.col("intercept")
        return scored.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).drop("_margin", "intercept")

    def score_versions(self, df: DataFrame, versions: Mapping[str, Column], keys: Sequence[str] = KEYS) -> DataFrame:
        """A row per row of ``df`` and version of its text: ``variant``, and its ``score``.

        As ``score`` of a table with a row per version. Versions share most of their terms, so a row's
        terms meet the model once for all of them. For models of interaction tokens alone.
        """
        if tuple(self.blocks) != ("cross",):
            raise ValueError("versions are scored by models of interaction tokens alone")
        keys, names = list(keys), list(versions)
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = {f"_t{k}": F.lower(text) for k, text in enumerate(versions.values())}
        rows = once(df.repartition(partitions, *keys, *self.by), {"_side": _answer_side(), **texts})
        rows = rows.select(*keys, *self.by, _version_counts(len(names))("_side", *texts).alias("_e"))
        rows = rows_of(rows, "_e", [*keys, *self.by], "term")
        known = self._known().where("block = 'cross'").select(*self.by, "term", "idf", "coef")

        def summed(k: int) -> list[Column]:
            w = F.when(F.col(f"v{k}") > 0, (1.0 + F.log(f"v{k}")) * F.col("idf")).otherwise(0.0)
            return [F.sum(w * F.col("coef")).alias(f"_dot{k}"), F.sum(w * w).alias(f"_sq{k}")]

        margins = rows.join(known, [*self.by, "term"]).groupBy(*keys, *self.by).agg(*[c for k in range(len(names)) for c in summed(k)])
        start = self.fits.select(*self.by, "intercept")
        scored = df.join(margins, [*keys, *self.by], "left")
        scored = scored.join(start, list(self.by)) if self.by else scored.crossJoin(F.broadcast(start))

        def score(k: int) -> Column:
            margin = F.when(F.col(f"_sq{k}") > 0, F.col(f"_dot{k}") / F.sqrt(f"_sq{k}"))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.coalesce(margin, F.lit(0.0)) + F.col("intercept"))))

        each = F.array(*[F.struct(F.lit(name).alias("variant"), score(k).alias("score")) for k, name in enumerate(names)])
        return scored.select(*df.columns, F.inline(each))

    def top_features(self, df: DataFrame, k: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
        """Add ``top_features``: the k strongest readable pushes to a flag, at most.

        Only positive ones; names starting with a blank are unreadable
        fragments and are left out; ties go by name.
        """
        keys = list(keys)
        push = F.col("_w") * F.col("coef")
        name = feature_name()
        shown = F.when((push > 0) & ~F.startswith(name, F.lit(" ")), F.struct((-push).alias("m"), name.alias("f")))
        per_block = _each(self._met(df, keys), lambda met: met.withColumn("_w", _raw()).groupBy(*keys, *self.by, "block").agg(
            F.slice(F.array_sort(F.collect_list(shown)), 1, k).alias("_best"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm")
        ))
        scaled = F.transform(
            "_best", lambda b: F.struct(F.when(_is_text(), b["m"] / F.col("_norm")).otherwise(b["m"]).alias("m"), b["f"].alias("f"))
        )
        best = per_block.withColumn("_best", scaled).groupBy(*keys, *self.by).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k).alias("_best")
        )
        pushes = F.transform("_best", lambda b: F.struct(b["f"].alias("feature"), (-b["m"]).alias("weight")))
        none = F.array().cast("array<struct<feature:string,weight:double>>")
        return df.join(best, [*keys, *self.by], "left").withColumn("top_features", F.coalesce(pushes, none)).drop("_best")


def class_weights(train: DataFrame) -> tuple[float, float, int]:
    """Balanced weights n/(2 n_class); one class only is an error."""
    row = train.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p")
    ).first()
    if row.p == 0 or row.p == row.n:
        raise ValueError("the training data holds a single class")
    return row.n / (2.0 * (row.n - row.p)), row.n / (2.0 * row.p), row.n


#: Entries of a block of rows, numbers of a piece of a gradient, of a sketch of the curvature, and of the steps kept.
BLOCK_ENTRIES, PIECE, SKETCH, STEPS = 1 << 18, 1 << 16, 1 << 22, 1 << 25
_BLOCK = "y binary, held binary, segment binary, start binary, at binary, code binary, value binary, norm binary"
_KINDS = ("f8", "i4", "i8", "i8", "i4", None, "f8", "f8")


def _packed(rows: DataFrame, idf: Broadcast, text_ends: list[int]) -> DataFrame:
    """label, held, e (array of i, u) as blocks of rows in plain number arrays.

    Entries go by row and place.  A segment is what a row has in one text block, or in no text block;
    ``start`` is its first entry, ``norm`` its length in each model.  Few values differ: an entry has its value's number.
    """
    names = ["y", "held", "segment", "start", "at", "code", "value", "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = idf.value, len(text_ends) + 1
        for batch in batches:
            label, held, e = batch.columns
            offsets, entry = e.offsets.to_numpy(), e.values
            place, values = entry.field("i").to_numpy(), entry.field("u").to_numpy()
            width = len(held.values) // max(1, len(held))  # a model of each split
            marks = held.flatten().to_numpy().astype(np.int32)
            begin = 0
            while begin < len(label):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_ENTRIES)) - 1)
                end = min(end, len(label))
                part = slice(offsets[begin], offsets[end])
                owner = np.repeat(np.arange(end - begin), np.diff(offsets[begin:end + 1]))
                order = np.lexsort((place[part], owner))
                at, value = place[part][order].astype(np.int32), values[part][order].astype(np.float64)
                of = owner[order] * n + np.searchsorted(text_ends, at, side="right")
                start = np.flatnonzero(np.diff(of, prepend=-1))
                segment = of[start]
                norm = np.ones((len(known), len(start)))
                text = segment % n < n - 1
                for m in range(len(known) if len(start) else 0):
                    length = np.sqrt(np.add.reduceat(np.square(value * known[m][at]), start))
                    norm[m] = np.where(text & (length > 0), length, 1.0)
                differing, code = np.unique(value, return_inverse=True)
                arrays = (
                    label.to_numpy()[begin:end].astype(np.float64), marks[begin * width:end * width],
                    segment.astype(np.int64), start.astype(np.int64), at,
                    code.astype(np.min_scalar_type(max(1, len(differing)) - 1)), differing, norm)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=names)
                begin = end

    return rows.select(F.col("label").cast("double"), "held", "e").mapInArrow(run, _BLOCK)


def _unpacked(batch: pa.RecordBatch, splits: int, models: int) -> Iterator[tuple[np.ndarray, ...]]:
    """y, held, segment, start, at, value, norm of the blocks of ``_packed``."""
    for row in zip(*(column for column in batch.columns), strict=True):
        y, held, segment, start, at, code, value, norm = (
            x.as_py() if kind is None else np.frombuffer(x.as_py(), dtype=kind) for x, kind in zip(row, _KINDS, strict=True))
        code = np.frombuffer(code, dtype=f"u{len(code) // max(1, len(at)) or 1}")
        yield y, held.reshape(len(y), splits), segment, start, at, value[code], norm.reshape(models, -1)


def _added(blocks: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sums of the numbered arrays that tasks make of their blocks: sent in pieces, which are added by piece."""

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, total in run(batches):
            for k in range(0, len(total), PIECE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m], pa.int32()), pa.array([k], pa.int64()), pa.array([total[k:k + PIECE].tobytes()], pa.binary())], names=["m", "k", "s"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.float64) for x in table["s"])
        return pa.table({"m": table["m"][:1], "k": table["k"][:1], "s": pa.array([total.tobytes()], pa.binary())})

    pieces = blocks.mapInArrow(pieces_of, "m int, k long, s binary").groupBy("m", "k").applyInArrow(add, "m int, k long, s binary").toArrow()
    found: dict[int, list[tuple[int, bytes]]] = {}
    for m, k, part in zip(*(pieces[x].to_pylist() for x in ("m", "k", "s")), strict=True):
        found.setdefault(m, []).append((k, part))
    return {m: np.concatenate([np.frombuffer(part, dtype=np.float64) for _, part in sorted(parts)]) for m, parts in found.items()}


def _evaluate(
    blocks: DataFrame, points: dict[int, np.ndarray], idf: Broadcast, weights: np.ndarray, n_text: int, splits: int, c: float,
) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient of the objective of each model at its point (coefficients, then the intercept)."""
    shared = blocks.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        given, known = shared.value, idf.value
        size = len(next(iter(given.values()))) - 1
        sums = {m: np.zeros(size + 2) for m in given}  # gradient, the intercept's, loss
        pulls = {m: known[m] * point[:-1] for m, point in given.items()}
        for batch in batches:
            for y, held, segment, start, at, value, norm in _unpacked(batch, splits, len(known)):
                owner, lengths = segment // (n_text + 1), np.diff(start, append=len(at))
                for m, point in given.items():
                    dot = np.add.reduceat(value * pulls[m][at], start) if len(start) else np.zeros(0)
                    margin = np.bincount(owner, dot / norm[m], len(y)) + point[-1]
                    trains = ~(held == m).any(axis=1)
                    weight = np.where(y > 0, weights[m, 1], weights[m, 0]) * trains
                    r = weight * (1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y)
                    sums[m][:size] += np.bincount(at, value * np.repeat(r[owner] / norm[m], lengths), size)
                    sums[m][size] += r.sum()
                    sums[m][size + 1] += (weight * (np.logaddexp(0, margin) - y * margin)).sum()
        for m, total in sums.items():
            total[:size] *= known[m]
            yield m, total

    out = {}
    totals = _added(blocks, run)
    for m, point in points.items():
        # without rows there is nothing but the penalty
        total = totals.get(m, np.zeros(len(point) + 1))
        gradient = c * total[:-1]
        gradient[:-1] += point[:-1]
        out[m] = c * total[-1] + 0.5 * point[:-1] @ point[:-1], gradient
    shared.unpersist()
    return out


def _curvature(
    blocks: DataFrame, size: int, idf: Broadcast, weights: np.ndarray, n_text: int, splits: int, c: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Directions (columns) in which the objective of the first model is most curved, and how much beyond the penalty.

    A Nystroem approximation of the curvature, from one pass over all rows.  It only tells the search where to
    stretch its steps, so it alters the way to the optimum, not the optimum; the other models share it.
    """
    rank = max(2, min(32, SKETCH // (size + 1), size + 1))

    def probes() -> np.ndarray:
        return np.random.default_rng(7).standard_normal((rank, size + 1), dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        known, probe, sums = idf.value, probes(), np.zeros((rank, size + 1), dtype=np.float32)
        pulls = probe[:, :size] * known[0].astype(np.float32)
        for batch in batches:
            for y, _, segment, start, at, value, norm in _unpacked(batch, splits, len(known)):
                owner, lengths = segment // (n_text + 1), np.diff(start, append=len(at))
                # the slope of the logistic function is a quarter at most, and falls as the fit improves
                slope = c * np.where(y > 0, weights[0, 1], weights[0, 0]) / 8
                scaled = value / np.repeat(norm[0], lengths)
                of = np.repeat(owner, lengths)
                for k in range(rank):
                    dot = np.add.reduceat(scaled * pulls[k][at], start) if len(start) else np.zeros(0)
                    r = slope * (np.bincount(owner, dot, len(y)) + probe[k, size])
                    sums[k, :size] += np.bincount(at, scaled * r[of], size)
                    sums[k, size] += r.sum()
        sums[:, :size] *= known[0]
        for k in range(rank):
            yield k, sums[k].astype(np.float64)

    totals = _added(blocks, run)
    probe = probes().T.astype(np.float64)
    image = np.stack([totals.get(k, np.zeros(size + 1)) for k in range(rank)], axis=1)
    shift = 1e-6 * max(float(np.linalg.norm(image)) / np.sqrt(size + 1), 1e-9)  # keeps the small matrix definite beside rounding
    image += shift * probe
    small = probe.T @ image
    root = np.linalg.cholesky((small + small.T) / 2 + 1e-9 * np.trace(small) * np.eye(rank))
    directions, values, _ = np.linalg.svd(np.linalg.solve(root, image.T).T, full_matrices=False)
    return directions, np.maximum(0.0, values ** 2 - shift)


def _stretch(directions: np.ndarray, values: np.ndarray, used: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A vector divided by the curvature as far as ``_curvature`` knows it; features that are not ``used`` stay out."""
    least = 1.0 + values[-1]
    factor = least / (1.0 + values) - 1.0

    def of(v: np.ndarray) -> np.ndarray:
        v = v * used
        return (v + directions @ (factor * (directions.T @ v))) * used

    return of


def _minimise(
    size: int, tol: float, max_iter: int, memory: int = 10, stretch: Callable[[np.ndarray], np.ndarray] = np.copy,
) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float]]:
    """L-BFGS: yields points, is sent (loss, gradient), returns the last point and its largest gradient entry.

    ``stretch``: a symmetric, positive guess at the inverse of the curvature, up to a factor.
    """
    x, past = np.zeros(size), []
    f, g = yield x
    for _ in range(max_iter):
        if np.abs(g).max(initial=0.0) <= tol:
            break
        d, used = g.copy(), []
        for s, y, rho, _ in reversed(past):
            used.append(rho * (s @ d))
            d -= used[-1] * y
        d = stretch(d)
        if past:
            d *= past[-1][3]
        for (s, y, rho, _), a in zip(past, reversed(used), strict=True):
            d += s * (a - rho * (y @ d))
        slope, step = -(g @ d), 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(d)))
        for _ in range(40):
            after, h = yield x - step * d
            if after <= f + 1e-4 * step * slope:
                break
            step /= 2
        s, y = -step * d, h - g
        if s @ y > 1e-14 * (y @ y):
            past = [*past[1 - memory:], (s, y, 1.0 / (s @ y), (s @ y) / (y @ stretch(y)))]
        x, f, g = x + s, after, h
    return x, float(np.abs(g).max(initial=0.0))


def _fit_models(
    parts: EntryParts, rows: DataFrame, features: DataFrame, models: Sequence[tuple], balances: Sequence[tuple[float, float]],
    cfg: TextModelConfig, keys: Sequence[str], by: Sequence[str], splits: int,
) -> tuple[DataFrame, list[tuple[float, float]]]:
    """H9: (by, block, term, df, idf, coef) and (intercept, violation) of models fitted together.

    ``parts``: ``entry_parts`` of the rows; ``rows``: keys, label, held: the numbers of the models that don't train on a row; ``features``: by, block, term, df, idf.
    The objective of each model is 0.5*|w|^2 + C * sum(weight * loss); the intercept is not penalised.
    All models share one matrix of damped counts, written once with the lengths of its rows in each
    model; idf and unit length are applied while it is read. Only arrays of numbers, a number a feature, reach the driver.
    """
    spark = rows.sparkSession
    terms, blocks_, ends = numbered(features)
    terms = written(terms, "terms")
    order = {b: k for k, b in enumerate(sorted(blocks_, key=lambda b: (b not in TEXT_BLOCKS, b)))}
    # text blocks come first, so that a place tells its block
    shift, at = {}, 0
    for b in order:
        k = blocks_.index(b)
        begin = ends[k - 1] if k else 0
        shift[b], at = at - begin, at + ends[k] - begin
    text_ends, at = [], 0
    for b in order:
        k = blocks_.index(b)
        at += ends[k] - (ends[k - 1] if k else 0)
        if b in TEXT_BLOCKS:
            text_ends.append(at)
    size = ends[-1] if ends else 0
    moved = F.col("i") + F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])[F.col("block")]
    terms = written(terms.withColumn("i", moved.cast("int")), "places")
    idf = np.zeros((len(models), size))
    number = {m: k for k, m in enumerate(models)}
    listed = features.join(terms, ["block", "term"]).select(*by, "i", "idf").toArrow()
    columns = [listed[c].to_pylist() for c in by]
    which = np.array([number[m] for m in zip(*columns, strict=True)] if by else [0] * len(listed), dtype=np.int64)
    idf[which, listed["i"].to_numpy()] = listed["idf"].to_numpy()
    shared = spark.sparkContext.broadcast(idf)
    damped = F.when(_is_text(), 1.0 + F.log("v")).otherwise(F.col("v"))
    met = parts.far.join(terms.where(~_is_capped()), ["block", "term"]).groupBy(*keys).agg(
        F.collect_list(F.struct("i", damped.alias("u"))).alias("e"))
    if parts.capped:
        near = parts.near(terms.where(_is_capped()).select("block", "term", F.col("i").alias("t")).toArrow())
        met = met.unionByName(near.select(*keys, F.transform("e", lambda x: F.struct(x["t"].alias("i"), (1.0 + F.log(x["v"])).alias("u"))).alias("e")))
    matrix = met.groupBy(*keys).agg(F.flatten(F.collect_list("e")).alias("e"))
    blocks = written(_packed(matrix.join(rows, list(keys)), shared, text_ends), "matrix")
    directions, values = _curvature(blocks, size, shared, np.array(balances), len(text_ends), splits, cfg.c)
    memory = max(10, min(30, STEPS // (2 * (size + 1) * len(models))))
    runs = {m: _minimise(size + 1, cfg.tol, cfg.max_iter, memory, _stretch(directions, values, np.append(idf[m] > 0, True)))
            for m in range(len(models))}
    points, done = {m: next(r) for m, r in runs.items()}, {}
    while points:
        values = _evaluate(blocks, points, shared, np.array(balances), len(text_ends), splits, cfg.c)
        for m, value in values.items():
            try:
                points[m] = runs[m].send(value)
            except StopIteration as end:
                done[m] = end.value
                del points[m]
    coefficients = pa.table({
        **{c: pa.array([models[m][k] for m in range(len(models)) for _ in range(size)]) for k, c in enumerate(by)},
        "i": pa.array(np.tile(np.arange(size, dtype=np.int32), len(models))),
        "coef": pa.array(np.concatenate([done[m][0][:-1] for m in range(len(models))])),
    })
    table = features.join(terms, ["block", "term"]).join(spark.createDataFrame(coefficients), [*by, "i"])
    return written(table, "model"), [(float(done[m][0][-1]), done[m][1]) for m in range(len(models))]


def fit(train: DataFrame, cfg: TextModelConfig = TextModelConfig(), keys: Sequence[str] = KEYS) -> TextModel:
    """H8, H9: fit vocabularies, then a class-balanced L2 logistic regression."""
    negative, positive, n = class_weights(train)
    features = written(vocabulary(count_terms(train, n, cfg, keys), cfg), "features")
    rows = train.select(*keys, "label", F.array().cast("array<int>").alias("held"))
    table, fits = _fit_models(entry_parts(train, cfg, keys), rows, features, [()], [(negative, positive)], cfg, keys, (), 0)
    return TextModel(table, train.sparkSession.createDataFrame(fits, "intercept double, violation double"), cfg)


def training_classes(folded: DataFrame) -> DataFrame:
    """Split, fold, n_train, positives, refused: what each fold's model would train on.

    ``folded``: label and ``folds``: array of (split, fold).  A model is refused
    if its training rows have a single class.
    """
    own = folded.select("label", F.inline("folds")).groupBy("split", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p"))
    whole = own.groupBy("split").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    n_train, positives = F.col("_n") - F.col("n"), F.col("_p") - F.col("p")
    return own.join(whole, "split").select(
        "split", "fold", n_train.alias("n_train"), positives.alias("positives"),
        ((positives == 0) | (positives == n_train)).alias("refused"))


def fold_features(
    folded: DataFrame, cfg: TextModelConfig = TextModelConfig(), keys: Sequence[str] = KEYS,
    blocks: Sequence[str] = TEXT_BLOCKS, others: bool = True,
) -> DataFrame:
    """split, fold, block, term, df, idf: the features of the model of every (split, fold).

    ``folded``: rows whose ``folds`` are an array of (split, fold), one of each split.
    Frequencies are counted once per fold; what a model trains on is the total less its own fold.
    """
    keys, by = list(keys), ["split", "fold"]
    models = sorted(training_classes(folded).select(*by, "n_train").collect())  # splits x folds
    fold = folded.schema["folds"].dataType.elementType["fold"].dataType
    held = held_models([(m.split, m.fold) for m in models])
    parts = [_text_totals(_dealt(folded, keys), blocks, held, len(models))] if blocks else []
    if others:
        # a row's few other entries, beside the models that hold it out
        single = entries(folded.withColumn("_held", held), cfg, [*keys, "_held"], ())
        own = [F.array_contains("_held", k) for k in range(len(models))]
        parts.append(single.groupBy("block", "term").agg(
            F.count(F.lit(1)).alias("df"), F.sum("v").alias("tf"), *[F.count_if(mine).alias(f"_df{k}") for k, mine in enumerate(own)],
            *[F.sum(F.when(mine, F.col("v")).otherwise(0.0)).alias(f"_tf{k}") for k, mine in enumerate(own)]))
    counts = _summed(reduce(DataFrame.unionByName, parts))
    rest = F.array(*[F.struct(
        F.lit(m.split).alias("split"), F.lit(m.fold).cast(fold).alias("fold"), (F.col("df") - F.col(f"_df{k}")).alias("df"),
        (F.col("tf") - F.col(f"_tf{k}")).alias("tf"), F.lit(m.n_train).alias("n")) for k, m in enumerate(models)])
    left = written(counts, "fold_counts").select("block", "term", F.inline(rest)).where("df > 0")
    return vocabulary(left, cfg, by)


def held_models(models: Sequence[tuple]) -> Column:
    """The numbers of the models (split, fold) that don't train on a row."""
    number = F.create_map(*[F.lit(x) for k, m in enumerate(models) for x in (f"{m[0]}|{m[1]}", k)])
    return F.transform("folds", lambda f: number[F.concat_ws("|", f["split"], f["fold"].cast("string"))])


def fit_folds(folded: DataFrame, cfg: TextModelConfig = TextModelConfig(), keys: Sequence[str] = KEYS) -> TextModel:
    """A model for every (split, fold), fitted on the rows of the split's other folds.

    ``folded``: instances with ``folds``: array of (split, fold), one of each split.
    A fold whose training rows have a single class is an error (H10).
    """
    keys, by = list(keys), ["split", "fold"]
    spark = folded.sparkSession
    classes = training_classes(folded).collect()  # splits x folds
    if refused := [(r.split, r.fold) for r in classes if r.refused]:
        raise ValueError(f"the training data of {refused} holds a single class")
    models = sorted((r.split, r.fold) for r in classes)
    train = {(r.split, r.fold): (r.n_train, r.positives) for r in classes}
    features = written(fold_features(folded, cfg, keys), "fold_features")
    balances = [(n / (2.0 * (n - p)), n / (2.0 * p)) for n, p in (train[m] for m in models)]
    rows = folded.select(*keys, "label", held_models(models).alias("held"))
    table, fits = _fit_models(entry_parts(folded, cfg, keys), rows, features, models, balances, cfg, keys, by, len({s for s, _ in models}))
    fitted = spark.createDataFrame([(*m, *f) for m, f in zip(models, fits, strict=True)], "split string, fold int, intercept double, violation double")
    return TextModel(table, fitted, cfg, tuple(by))


def residuals(balance: tuple[float, float, int]) -> Column:
    """A row's weighted residual: what it pulls the margin by."""
    return F.when(F.col("label") == 1, balance[1]).otherwise(balance[0]) * (F.col("label") - F.col("score"))


def optimality(model: TextModel, train: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """H9: block, term, violation of each feature's optimality condition, and the intercept's.

    The objective is strictly convex, so these conditions single out the fit: C times a feature's sum of
    weighted residuals is its coefficient, and all residuals sum to 0.
    """
    keys = list(keys)
    pull = model.score(train, keys).select(*keys, residuals(class_weights(train)).alias("r"))
    rows = vectors(entry_parts(train, model.cfg, keys, model.blocks), model._known(), keys)  # the model's table has i
    sums = rows.select(*keys, F.inline("features")).join(pull, keys).groupBy("i").agg(F.sum(F.col("r") * F.col("w")).alias("s"))
    own = model._known().join(sums, "i", "left").select(
        "block", "term", F.abs(model.cfg.c * F.coalesce("s", F.lit(0.0)) - F.col("coef")).alias("violation"))
    return own.unionByName(pull.agg(F.abs(F.sum("r")).alias("violation")).select(
        F.lit("intercept").alias("block"), F.lit("").alias("term"), "violation"))


def explain(form_ref: Column) -> Column:
    """Which learned features drove the flag; needs ``top_features``."""
    readable = F.array_join(
        F.transform(
            "top_features",
            lambda r: F.concat(
                F.lit("“"), F.substring_index(r["feature"], "~", -1), F.lit("”")
            ),
        ),
        ", ",
    )
    return F.when(
        F.size("top_features") == 0, F.lit("The text model found nothing against the answer.")
    ).otherwise(
        F.concat(
            form_ref, F.lit(" has the answer “"), F.col("structured_value"), F.lit("”; on the test “"),
            F.replace(F.col("test_id"), F.lit("_"), F.lit(" ")),
            F.lit("” the text model sees most against it in "), readable, F.lit("."),
        )
    )
