"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Four fixed shapes give the base spans, which always stay. Further candidates
(tokens that mix letters and digits) are judged; shapes that fail their check
serve as negative evidence and are never added. On every candidate, base spans included, five labelers vote yes, no
or abstain: shape (regular expressions), gazetteer, context words, mixture of
letters and digits, and delimiters. Expectation-maximisation over the counts of
vote patterns (at most 3^5 rows, whatever the corpus) estimates how reliable
each labeler is; the posteriors are soft labels for a logistic classifier over
binned span features, trained on counts of feature patterns (a bounded number as
well). Candidates it accepts are added unless they overlap a base span.

The texts are read once, row by row, and only spans are written; counts are
Spark aggregates over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]{8,}")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")

# What the labelers know: openings of credentials, endings of domains, words before personal data or plain numbers.
GAZETTEER = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ")
ENDINGS = (".com", ".org", ".net", ".edu", ".gov", ".io", ".de", ".fr", ".es", ".uk", ".eu")
CUES = re.compile(r"mail|phone|tel\b|call|mobile|fax|card|visa|password|passwd|secret|token|api.?key|key\b|pin\b|login|contact|\bip\b|server|host", re.I)
PLAIN = re.compile(r"page|chapter|figure|fig\.|section|version|isbn|vol\.|table|part|model|size", re.I)
_SECRET = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{16,}|[A-Za-z0-9_+/-]{32,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list, list]:
    """(kind, start, end) of the fixed shapes that pass their check, and of those that fail it."""
    good = [(0, *span) for span in emails(text)] if "@" in text else []
    bad = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            (good if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts) else bad).append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19:
                (good if _luhn(digits) else bad).append((2, *m.span()))
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            (good if 8 <= n <= 15 else bad).append((3, *m.span()))
    return good, bad


def _judged(text: str, kind: int, start: int, end: int, checked: bool) -> list[int]:
    """[kind, start, end, votes, features]: votes in base 3 (0 abstains, 1 no, 2 yes), features as one number."""
    span, before = text[start:end], text[max(0, start - 24):start]
    digits, letters = len(_DIGIT.findall(span)), len(_LETTER.findall(span))
    changes, cue, plain = len(_CHANGE.findall(span)), bool(CUES.search(before)), bool(PLAIN.search(before))
    delimited = before.rstrip(" \"'")[-1:] in ("=", ":")
    known = span.startswith(GAZETTEER) or kind == 0 and span.endswith(ENDINGS) or kind == 3 and span[1:2] != "0"
    votes = (
        (2 if kind < 4 and checked or kind == 4 and _SECRET.fullmatch(span) else 1 if kind == 5 else 0),
        2 if known else 0,
        2 if cue else 1 if plain else 0,
        2 if changes >= 4 or digits >= 16 else 1 if changes <= 1 and digits < 8 else 0,
        2 if delimited else 0)
    bins = (
        (kind, 6), (sum(len(span) >= x for x in (12, 20, 32)), 4), (min(3, 4 * digits // max(1, digits + letters)), 4),
        (sum(changes >= x for x in (2, 4, 8)), 4), (int(cue) + 2 * int(plain), 4), (int(delimited), 2), (int(known), 2))
    code = 0
    for value, width in bins:
        code = code * width + value
    return [kind, start, end, int("".join(map(str, votes)), 3), code]


#: Widths of the bins in a feature number, in order.
WIDTHS = (6, 4, 4, 4, 4, 2, 2)
LABELERS = 5


def candidates(text: str) -> tuple[list, list]:
    """Base spans [kind, start, end], and all judged candidates (base spans first)."""
    good, bad = base_spans(text)
    if not good and not bad and not _DIGIT.search(text):
        return [], []
    taken = sorted((s, e) for _, s, e in good)
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else None
    starts = [s for s, _ in taken]

    def free(start: int, end: int) -> bool:
        i = int(np.searchsorted(starts, end)) - 1
        return i < 0 or ends[i] <= start

    judged = [_judged(text, k, s, e, True) for k, s, e in good]
    for m in _TOKEN.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and free(*m.span()):
            judged.append(_judged(text, 4, *m.span(), False))
    judged += [_judged(text, 5, s, e, False) for _, s, e in bad if free(s, e)]
    return [list(x) for x in good], judged


_INTS = T.ArrayType(T.ArrayType(T.IntegerType()))


def _extract(docs: DataFrame) -> DataFrame:
    nested = pa.list_(pa.list_(pa.int32()))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], nested), pa.array([f[1] for f in found], nested)],
                names=["doc_id", "base", "judged"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("base", _INTS), T.StructField("judged", _INTS)])
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: P(yes | pattern), and P(vote | class) of each labeler as [class, labeler, vote].

    Starts from the majority vote. A little weight on each labeler's own sense
    keeps the classes from changing places where votes are few.
    """
    yes, no = (votes == 2).sum(1), (votes == 1).sum(1)
    post = (yes + 0.5) / (yes + no + 1.0)
    prior = np.array([[1.0, 2.0, 0.5], [1.0, 0.5, 2.0]])  # class no, class yes
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        for v in range(3):
            table[:, :, v] = weight @ (votes == v) + prior[:, None, v]
        table /= table.sum(2, keepdims=True)
        share = (weight.sum(1) + 1) / (weight.sum() + 2)
        log = np.log(share)[:, None] + np.stack([
            np.log(table[c, np.arange(votes.shape[1]), votes]).sum(1) for c in range(2)])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table


def _one_hot(codes: np.ndarray) -> np.ndarray:
    columns, rest = [], codes.astype(np.int64)
    for width in reversed(WIDTHS):
        columns.append(np.eye(width)[rest % width])
        rest = rest // width
    return np.hstack([np.ones((len(codes), 1)), *columns])


def fit_classifier(codes: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-regularised logistic model of soft labels, by Newton steps."""
    x = _one_hot(codes)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (soft - p)) - ridge * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, gradient)
    return w


def _accepted(judged: DataFrame) -> list[int]:
    """Feature numbers of spans that the trained classifier calls personal data."""
    patterns = (
        judged.select(F.explode("judged").alias("j")).groupBy(F.col("j")[3].alias("votes"), F.col("j")[4].alias("code"))
        .count().orderBy("votes", "code").collect())  # at most 3^5 times the number of feature numbers, none a document
    if not patterns:
        return []
    code, n = (np.array([r[i] for r in patterns]) for i in (1, 2))
    rest, votes = np.array([r[0] for r in patterns]), []
    for _ in range(LABELERS):
        votes.append(rest % 3)
        rest = rest // 3
    soft, _ = reliabilities(np.array(votes[::-1]).T, n)
    weights = fit_classifier(code, soft, n)
    every = np.unique(code)
    return every[_one_hot(every) @ weights > 0].tolist()


def _spans(rows: Column) -> Column:
    """(kind, start, end) structs in order of kind, then start."""
    rows = F.array_sort(F.transform(rows, lambda r: F.struct(r[0].alias("k"), r[1].alias("start"), r[2].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.transform(rows, lambda r: F.struct(F.element_at(names, r.k + 1).alias("kind"), r.start.alias("start"), r.end.alias("end")))


def find_spans(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, base and spans, arrays of (kind, start, end).

    Offsets count code points, end exclusive; kinds are ordered as in KINDS. A
    null text is empty and has no spans; other columns of docs are left out;
    repeated rows are kept, and an empty table gives an empty result.
    """
    found = written(_extract(docs), "pii_spans")
    accepted = F.array(*map(F.lit, _accepted(found))).cast("array<int>")
    added = F.filter("judged", lambda j: (j[0] == KINDS.index("secret")) & F.array_contains(accepted, j[4]))
    return found.select(
        "doc_id", _spans(F.col("base")).alias("base"),
        _spans(F.concat("base", F.transform(added, lambda j: F.slice(j, 1, 3)))).alias("spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
