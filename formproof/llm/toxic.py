"""Toxicity by maximum-scoring segments of token log-odds, calibrated as extreme values.

Learning, from a bounded sample of labelled documents (distinct texts):

1. Units are words and prefixes of words that occur in enough toxic texts, and
   at twice the clean texts' rate or more. Their counts in
   toxic and clean texts (texts that hold them, as words of one text don't occur
   independently) give log-odds with an informative Dirichlet prior, whose weights are the
   units' shares of all documents. A unit scores the lower bound of its log-odds, if positive; a
   word scores its best unit, and any other word nothing.
2. Every token also costs a constant, so that in clean text a sum of scores drifts down. Lambda
   is the positive root of E[exp(lambda * score)] = 1 over clean tokens; a
   passage of score S in n tokens is then expected K * n * exp(-lambda * S) times by chance
   (its E-value, an extreme-value law), with K from the passages of clean texts.
3. A text's evidence is the sum of -ln E over its passages with E < 1. Two numbers turn
   evidence into a probability (logistic, on texts scored by units that were
   counted in the other folds of the sample).

Scoring finds all maximal segments of each whole text in one linear scan. No
label, id, language or source enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import text_of, written

_LETTERS = re.compile(r"[^\W_]+")
#: The words of str.split(), with their places.
_SPACED = re.compile(r"\S+")
#: Lengths of prefixes that are units, marked by a star.
PREFIXES = range(3, 8)
#: Words a task remembers, to bound memory.
REMEMBERED = 200_000


def units(word: str) -> list[str]:
    low = word.lower()
    return [low, *(low[:k] + "*" for k in PREFIXES if k < len(low))]


class _Memory:
    """What is found for each word as written, which may hold several runs of letters; forgets all when it has grown too large."""

    def __init__(self, wanted):
        self.wanted = wanted
        self.heads = {u[:PREFIXES[0]] for u in wanted}
        self.seen: set[str] = set()
        self.found: dict[str, object] = {}

    def learn(self, words: set[str]) -> bool:
        """Whether anything is found for some of the words."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.found = set(), {}
        heads, first = self.heads, PREFIXES[0]
        new = words - self.seen
        for word in new:
            low = word.lower()
            if not low.isalnum():
                if low[:-1].isalnum():  # a full stop or comma, most often
                    low = low[:-1]
                else:
                    if held := [u for part in _LETTERS.findall(low) if part[:first] in heads for u in units(part) if u in self.wanted]:
                        self.found[word] = self.of(held)
                    continue
            if low[:first] in heads and (held := [u for u in units(low) if u in self.wanted]):
                self.found[word] = self.of(held)
        self.seen |= new
        return not self.found.keys().isdisjoint(words)

    def of(self, held: list[str]):
        return held


class _Values(_Memory):
    """Of a word the best score among its units."""

    def of(self, held: list[str]) -> float:
        return max(self.wanted[u] for u in held)

    def points(self, text: str) -> tuple[int, list[int], list[float]]:
        """The number of words, and the places and scores of those that score."""
        words = text.split()
        if not self.learn(set(words)):
            return len(words), [], []
        at = [i for i, w in enumerate(words) if w in self.found]
        return len(words), at, [self.found[words[i]] for i in at]


@dataclass
class Model:
    """Scores of units, and what turns passages into a probability."""

    scores: dict[str, float] = field(default_factory=dict)
    cost: float = 0.05
    rate: float = 1.0  # lambda
    spread: float = 1.0  # K
    base: float = 0.0
    slope: float = 0.0
    constant: float | None = None  # the score of every text, where there is nothing to learn from

    def evidence(self, total: float, n: int) -> float:
        """-ln E of a passage."""
        return self.rate * total - math.log(self.spread * max(n, 1))

    def probability(self, evidence: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.base + self.slope * math.log1p(evidence)))))


def segments(at: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa) as first token, last token, sum.

    at has the ascending places of the tokens that score; all tokens, these too, cost `cost`.
    """
    before, after, first, last, lower = [], [], [], [], []
    total, place = 0.0, 0
    for i, s in zip(at, scores, strict=True):
        total -= cost * (i - place)
        place = i + 1
        left, right, start = total, total + s - cost, i
        total = right
        if right <= left:
            continue
        while True:
            # the nearest earlier segment that begins below; those in between begin above
            j = len(before) - 1
            while j >= 0 and before[j] >= left:
                j = lower[j]
            if j < 0 or after[j] >= right:
                break
            left, start = before[j], first[j]
            for kept in (before, after, first, last, lower):
                del kept[j:]
        for kept, value in ((before, left), (after, right), (first, start), (last, i), (lower, j)):
            kept.append(value)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, before, after, strict=True)]


def _counted(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(unit, part, n): the number of texts of each value of the integer column `part` that hold a unit.

    wanted None: all units. The unit '' counts all texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # at most `candidates` units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = defaultdict(Counter), None if shared.value is None else _Memory(shared.value)

        def full() -> pa.RecordBatch:
            rows = [(u, part, n) for part, counts in own.items() for u, n in counts.items()]
            own.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["unit", "part", "n"])

        for batch in batches:
            for text, part in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words, seen = set(text.as_py().split()), {""}
                if memory is None:
                    seen.update(u for low in set(_LETTERS.findall(" ".join(words).lower())) for u in units(low))
                elif memory.learn(words):
                    seen.update(u for w in memory.found.keys() & words for u in memory.found[w])
                own[part].update(seen)
                if sum(map(len, own.values())) > 4 * REMEMBERED:
                    yield full()
        yield full()

    return texts.select("text", "part").mapInArrow(run, "unit string, part int, n long").groupBy("unit", "part").agg(F.sum("n").alias("n"))


def log_odds(toxic: np.ndarray, clean: np.ndarray, share: np.ndarray, n_toxic: float, n_clean: float, prior: float, bound: float) -> np.ndarray:
    """Lower bounds of the units' log-odds under a Dirichlet prior of `prior` texts for each text counted."""
    weight = prior * (n_toxic + n_clean)
    alpha = weight * share
    a, b = toxic + alpha, clean + alpha
    ratio = np.log(a / (n_toxic + weight - a)) - np.log(b / (n_clean + weight - b))
    return ratio - bound * np.sqrt(1 / a + 1 / b)


def _root(values: np.ndarray, counts: np.ndarray, cost: float) -> float:
    """The positive root of E[exp(x * (value - cost))] = 1; values of tokens that score, with the counts of all."""
    share = counts / counts.sum()
    low, high = 0.0, 1.0
    over = lambda x: float((share * np.exp(np.minimum(x * (values - cost), 700))).sum()) > 1
    while not over(high) and high < 1e3:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Base and slope (not negative) of a logistic fit with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    features = np.stack([np.ones(len(x)), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ features, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p) + 1e-9)) @ features.T + np.diag([1e-9, 1e-3]), features @ (target - p) - np.array([0, 1e-3 * w[1]]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    if w[1] < 0:
        return math.log((n1 + 1) / (n0 + 1)), 0.0
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, least_texts: int = 3, candidates: int = 50_000,
        least_ratio: float = 2.0, prior: float = 0.1, bound: float = 2.0, cost: float = 0.05, folds: int = 5, seed: int = 11) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic).

    At most `labelled` labels, those of smallest hash, are learnt from (several
    of one doc_id count as the largest; nulls don't count), and at most `candidates` units, of those in `least_texts`
    toxic texts or more those in most; both are bounds of the model. Counts for the prior cover all documents.
    Without a toxic label every text will score 0, with toxic ones only 1, and without a unit
    that tells them apart the share of toxic texts.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(labelled))
    texts = (
        docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `labelled` rows
        .groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    part = F.pmod("h", F.lit(folds)) + folds * (F.col("toxic") > 0).cast("int")
    sample = written(texts.select("text", part.cast("int").alias("part")), "toxic_sample")
    size = np.zeros((2, folds))
    for r in sample.groupBy("part").agg(F.count("*").alias("n")).collect():
        size[divmod(r.part, folds)] = r.n
    n_clean, n_toxic = size.sum(axis=1)
    if not n_toxic or not n_clean:
        return Model(constant=1.0 if n_toxic else 0.0)
    held = (
        _counted(sample.where(F.col("part") >= folds), None).where("unit <> ''").groupBy("unit").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least_texts).orderBy(F.desc("n"), "unit").limit(candidates))
    names = [r.unit for r in held.select("unit").collect()]
    place = {u: k for k, u in enumerate(["", *names])}
    counts, everywhere = np.zeros((2, folds, len(place))), np.zeros(len(place))
    for r in _counted(sample, set(names)).collect():
        counts[(*divmod(r.part, folds), place[r.unit])] = r.n
    # a unit not more frequent in toxic texts of the sample is no evidence
    over = counts[1].sum(axis=0) * n_clean > counts[0].sum(axis=0) * n_toxic * least_ratio
    over[0] = True
    counts, names = counts[:, :, over], [u for u, kept in zip(names, over[1:], strict=True) if kept]
    place, everywhere = {u: k for k, u in enumerate(["", *names])}, everywhere[over]
    for r in _counted(docs.select(text_of().alias("text"), F.lit(0).alias("part")), set(names)).collect():
        everywhere[place[r.unit]] = r.n
    share = everywhere[1:] / max(1.0, everywhere[0])

    def scored(without: int | None) -> dict[str, float]:
        clean, toxic = (counts[side].sum(axis=0) - (0 if without is None else counts[side, without]) for side in (0, 1))
        value = log_odds(toxic[1:], clean[1:], share, toxic[0], clean[0], prior, bound)
        return {u: float(v) for u, v in zip(names, value, strict=True) if v > cost}

    model = Model(scored(None), cost)
    if not model.scores:
        return Model(constant=n_toxic / (n_toxic + n_clean))
    other = sample.sparkSession.sparkContext.broadcast([scored(k) for k in range(folds)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [_Values(s) for s in other.value]
        for batch in batches:
            rows = []
            for text, part in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n, at, s = values[part % folds].points(text.as_py())
                rows.append({"toxic": part >= folds, "n": n, "at": at, "s": s})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("toxic", pa.bool_()), ("n", pa.int64()), ("at", pa.list_(pa.int64())), ("s", pa.list_(pa.float64()))]))

    points = written(sample.mapInArrow(read, "toxic boolean, n long, at array<long>, s array<double>"), "toxic_points")
    clean = points.where("not toxic")
    tokens = clean.agg(F.sum("n")).head()[0] or 1
    bins = clean.select(F.explode("s").alias("s")).groupBy(F.round(F.col("s") * 8).alias("b")).count().collect()  # scores have a bounded range
    values = np.array([0.0, *(r.b / 8 for r in bins), max(model.scores.values())])
    number = np.array([0.0, *(r["count"] for r in bins), 1.0])
    number[0] = max(1.0, tokens - number.sum())
    model.cost = max(cost, 2 * float((values * number).sum() / number.sum()))
    model.rate = _root(values, number, model.cost)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def sums(at: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([[t for *_, t in segments(a, b, model.cost)] for a, b in zip(at.to_pylist(), s.to_pylist(), strict=True)], pa.list_(pa.float64()))

    passages = written(points.select("toxic", "n", sums("at", "s").alias("sums")), "toxic_passages")
    least = max(0.0, min(model.scores.values()) - model.cost)
    found = passages.where("not toxic").agg(F.sum(F.size(F.filter("sums", lambda x: x >= least)))).head()[0] or 0
    model.spread = (found + 1) / (tokens * math.exp(-model.rate * least))
    evidence = F.aggregate(
        F.transform("sums", lambda x: model.rate * x - F.log(model.spread * F.greatest("n", F.lit(1)))), F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    rows = passages.select(evidence.alias("e"), F.col("toxic").cast("double").alias("y")).toArrow()  # at most `labelled` rows
    model.base, model.slope = _logistic(np.log1p(rows["e"].to_numpy()), rows["y"].to_numpy())
    return model


_PASSAGE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("log_odds", T.DoubleType()), T.StructField("e_value", T.DoubleType())])
_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(_PASSAGE))])


def score(docs: DataFrame, model: Model, e_value: float = 0.01) -> DataFrame:
    """docs with `score` (0 to 1) and `passages`: start, end (code points, end exclusive), log_odds and e_value.

    Passages are all maximal segments expected at most e_value times by chance in
    a clean text of that length, in order. Null and empty texts have the score of no evidence and
    no passage. Rows are worked on one by one, whole, without a
    shuffle: repeated rows and ties get equal results, other columns pass through, those
    named score or passages are replaced, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `candidates` units

    @F.arrow_udf(_SCORED)
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        values, none = _Values(model.scores), model.probability(0.0)
        for column in columns:
            scores, passages = [], []
            for text in column:
                text = text.as_py() or ""
                n, at, s = values.points(text)
                total, kept = 0.0, []
                if at:
                    found = [(a, b, t, model.evidence(t, n)) for a, b, t in segments(at, s, model.cost)]
                    total = sum(max(0.0, x[3]) for x in found)
                    if kept := [x for x in found if math.exp(-min(700.0, x[3])) <= e_value]:
                        places = [m.span() for m in _SPACED.finditer(text)]
                        kept = [{"start": places[a][0], "end": places[b][1], "log_odds": t, "e_value": math.exp(-min(700.0, x))} for a, b, t, x in kept]
                scores.append(model.probability(total) if total else none)
                passages.append(kept)
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, pa.list_(_ARROW))], ["score", "passages"])

    kept = [c for c in docs.columns if c not in ("score", "passages")]
    return docs.select(*kept, F.inline_outer(F.array(scored(text_of()))))  # a generator is not copied into each use


_ARROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_odds", pa.float64()), ("e_value", pa.float64())])
