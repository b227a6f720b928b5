"""Periodic runs of words, by a dictionary of basic factors.

A basic factor is a stretch of 2^k words. The dictionary names the factors of
each power of two so that equal factors have equal names: names of single words
come from a table of words, and the name of a factor twice as long is that of the pair
of its halves. A factor that occurs once is left out, and with it every longer
one that holds it, so prose costs little beyond the first levels.

A run with smallest period p and at least 3p words shows at the level 2^k in
[p, 2p): there the next occurrence of the factor at i is exactly at i + p, for
every i of the run from which the factor and its successor still fit (an
earlier one would, by Fine and Wilf, give the run a smaller period). These
places are consecutive, so their successors form an arithmetic progression of
step p: each maximal progression proposes one period, and its extension to the end of the last
factor's successor is the whole run. Each run appears at one level only.

Texts are worked on in slices of many documents at once; time is n log n in the
words of a slice, also for a text that repeats a single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import text_of

#: Words of a slice, to bound memory; a longer text is a slice of its own.
SLICE_WORDS = 1 << 18


class _Numbers(dict):
    """Numbers handed out in order of appearance."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def progressions(symbols: np.ndarray, longest: int, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of each run of at least max(least, times * period) symbols; longest bounds a run's length.

    times is 3 or more: the argument of the module needs three periods.
    """
    total, size = len(symbols), 1
    name = symbols.astype(np.int64, copy=True)
    at = np.arange(total)
    found = []
    while len(at) and size // 2 < longest // times:
        order = np.argsort(name[at], kind="stable")
        place = at[order]
        names = name[place]
        same = names[1:] == names[:-1]
        # the dictionary of the next level holds repeated factors only
        repeated = np.zeros(len(place), dtype=bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        dense = np.cumsum(np.concatenate([[0], ~same])) if len(names) else names
        name[place] = np.where(repeated, dense, -1)
        step = place[1:] - place[:-1]
        near = same & (2 * step > size) & (step <= size)
        left, period = place[:-1][near], step[near]
        if len(left):
            order = np.lexsort((left, period))
            left, period = left[order], period[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(left) != 1) | (np.diff(period) != 0)]))
            last = np.append(first[1:], len(left)) - 1
            length = left[last] - left[first] + period[first] + size
            enough = length >= np.maximum(least, times * period[first])
            found.append((left[first][enough], length[enough], period[first][enough]))
        at = np.sort(place[repeated])
        at = at[at + size < total]
        at = at[name[at + size] >= 0]
        joined = name[at] * (int(dense[-1]) + 1 if len(names) else 1) + name[at + size]
        name[:] = -1
        name[at] = joined
        size *= 2
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _worked(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Of each list of words its runs (start, length, period), and the text that keeps one period of each."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    numbers = _Numbers()
    words = np.fromiter((numbers[w] for ws in texts for w in ws), dtype=np.int64, count=int(ends[-1]))
    symbols = np.repeat(np.arange(len(texts)), sizes) * max(1, len(numbers)) + words  # no factor is shared by two texts
    start, length, period = progressions(symbols, int(sizes.max(initial=0)))
    owner = np.searchsorted(ends, start, side="right")
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, ws in enumerate(texts):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            out.append(([], b" ".join(ws).decode()))
            continue
        own = start[a:b] - (ends[k] - sizes[k])
        gone = np.zeros(len(ws) + 1, dtype=np.int64)
        np.add.at(gone, own + period[a:b], 1)
        np.add.at(gone, own + length[a:b], -1)
        kept = np.cumsum(gone[:-1]) == 0
        out.append((list(zip(own.tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)),
                    b" ".join([w for w, stays in zip(ws, kept.tolist(), strict=True) if stays]).decode()))
    return out


_PARTS = ("start", "length", "period")
_FOUND = T.StructType([
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _PARTS]))),
    T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([(c, pa.int64()) for c in _PARTS])


@F.arrow_udf(_FOUND)
def _found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        done, waiting, size = [], [], 0
        for text in column:
            waiting.append((text.as_py() or "").encode().split())  # ASCII white space, as in the contracts
            size += len(waiting[-1])
            if size >= SLICE_WORDS:
                done += _worked(waiting)
                waiting, size = [], 0
        if waiting:
            done += _worked(waiting)
        runs = pa.array([[dict(zip(_PARTS, r, strict=True)) for r in x[0]] for x in done], pa.list_(_RUN))
        yield pa.StructArray.from_arrays([runs, pa.array([x[1] for x in done], pa.string())], ["runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs with `runs` (array of start, length, period by start, then period) and `collapsed`.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0. A run is a
    stretch of words with smallest period `period`, of at least 24 words and three
    periods, that no neighbouring word extends. `collapsed` is the words left,
    joined by one space, when each run keeps its first period only; runs may
    overlap, and a word goes if any run drops it. A null, empty or blank text has no
    run and an empty `collapsed`. Rows are worked on one by one, without a
    shuffle: repeated rows and ties give equal results, other columns pass through, those named
    runs or collapsed are replaced, an empty table stays empty. A text of any length is
    worked on whole, in memory in proportion to its words.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    # a generator keeps the optimiser from copying the function into each use of its result
    return docs.select(*kept, F.inline_outer(F.array(_found(text_of()))))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period (exactly; ties: smallest start, then period); null without runs."""
    def better(a: Column, b: Column) -> Column:
        mine, other = a["length"].cast("decimal(19,0)") * b["period"], b["length"].cast("decimal(19,0)") * a["period"]
        return F.when(other > mine, b).otherwise(a)  # runs come in order, so a tie keeps the earlier

    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), better)


def written_out(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    return F.array_join(
        F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
