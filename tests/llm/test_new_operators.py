"""Toxicity, periodic runs and collocations on small tables, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from formproof.llm import phrases, queries, runs, toxic

LONG = "w " * 30_000


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(max(1, n)), rng.randint(1, 25)
        for i in range(a + p, min(n, a + rng.randint(10, 110))):
            words[i] = words[i - p]
    return [f"w{x}" for x in words]


def test_runs_match_brute_force():
    rng = random.Random(4)
    texts = [periodic(rng, rng.randint(0, 150), rng.choice([1, 2, 3, 30])) for _ in range(300)]
    worked = runs._worked([[w.encode() for w in ws] for ws in texts])
    for words, (got, collapsed) in zip(texts, worked, strict=True):
        assert got == brute_runs(words)
        gone = {i for s, n, q in got for i in range(s + q, s + n)}
        assert collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert sum(len(x[0]) for x in worked) > 100


def test_runs_of_tables(spark):
    two = "a b " * 20 + "c"
    some = [(1, "x " * 24, "k"), (1, "x " * 24, "k"), (2, "x " * 23, None), (None, two, "k"), (3, None, "k"), (4, "", "k"), (5, " \t\n", "k"), (6, LONG, "k")]
    table = spark.createDataFrame([(*r, "z", "z", "z") for r in some], "doc_id long, text string, lang string, runs string, collapsed string, start string")
    got = runs.periodic_runs(table)
    assert got.columns == ["doc_id", "text", "lang", "start", "runs", "collapsed"]
    rows = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed, r.start) for r in got.collect())
    assert rows == Counter([
        (1, ((0, 24, 1),), "x", "z"), (1, ((0, 24, 1),), "x", "z"), (2, (), " ".join("x" * 23), "z"), (None, ((0, 40, 2),), "a b c", "z"),
        (3, (), "", "z"), (4, (), "", "z"), (5, (), "", "z"), (6, ((0, 30_000, 1),), "w", "z")])
    assert runs.periodic_runs(table.where("false")).count() == 0


def test_strongest_run_is_exact(spark):
    listed = [[(0, 30, 10), (5, 24, 8), (40, 27, 9)], [(0, 30, 10), (50, 31, 10)], [], [(0, 10**9 + 1, 10**8), (3, 10**9 + 2, 10**8)]]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(listed)], "i int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r.i: r.b for r in table.select("i", runs.strongest(F.col("runs")).alias("b")).collect()}
    for i, x in enumerate(listed):
        want = min(x, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert (tuple(got[i]) if got[i] else None) == want


def test_planted_repeats(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:20] + [1, 2]
    words = [f"v{k}" for k in range(97)]
    table = spark.createDataFrame([(i, " \n".join(words)) for i in ids] + [(None, "a  b")], "doc_id long, text string")
    for r in queries.with_repeats(table).collect():
        if r.doc_id is None:
            assert r.text == "a  b"
            continue
        h, want = zlib.crc32(str(r.doc_id).encode()), list(words)
        if h % 10 == 0:
            g = h // 10
            a = g % 97
            p = 1 + (97 - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(97)]
        assert r.text.split() == want


def brute_phrases(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            if any(100 * b >= 80 * a for q, b in frequent.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("budget, slice_bytes, top", [(1 << 21, 1 << 22, 2000), (40, 3000, 25)])
def test_phrases_match_brute_force(spark, budget, slice_bytes, top, monkeypatch):
    """With a tiny budget prefixes are extended to all lengths, and groups meet in the sums."""
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
    rng = random.Random(8)
    vocabulary = ["The", "é", "of", "a", "B", "straße", "x\x00y", "İ", "zz"]
    rows = []
    for i in range(150):
        words = [rng.choices(vocabulary, [9, 7, 5, 3, 3, 2, 1, 1, 1])[0] for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    rows += [("en", None), (None, ""), ("en", "!!"), ("hot", "a b c d " * 400), ("hot", "a b c d " * 400), ("one", "a b " * 29)]
    table = spark.createDataFrame([(*r, "z", "z") for r in rows], "lang string, text string, phrase string, n string").repartition(3)
    got = phrases.collocations(table, least=12, top=top, budget=budget, salts=3)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 12, top)
    assert phrases.collocations(table.where("false")).count() == 0


def test_partition_keeps_groups_within_the_budget():
    loads = np.array([[5, 100, 7, 0, 3], [50, 60, 0, 0, 0], [50, 0, 0, 60, 1]])
    groups, (parts, begin), starts = phrases.partition(loads, 10)
    assert [g.tolist() for g in groups][0] == [0, -1, 1, 1, 1] and starts[0] == 0
    assert parts.tolist() == [5, 0, 0, 6, 0] and begin[3] - begin[0] == 5
    held = Counter(g for g in groups[0] if g >= 0)
    assert all(n <= 4 for n in held.values()) and max(groups[0]) < min(g for g in groups[1] if g >= 0)


def brute_segments(scores):
    """Split at the best segment, over and over: the definition of maximal segments."""
    def work(a, b):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        *_, i, j = best
        return work(a, i) + [(i, j - 1, best[0])] + work(j, b)
    return work(0, len(scores))


def test_segments_match_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(0, 18)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        scores = [rng.choice([16, 64, 160, 330]) / 64 for _ in at]
        cost = 0.75
        plain = [-cost] * n
        for i, s in zip(at, scores, strict=True):
            plain[i] += s
        got = toxic.segments(at, scores, cost)
        assert [x[2] for x in got] == [x[2] for x in brute_segments(plain)]
        assert all(sum(plain[a:b + 1]) == t for a, b, t in got)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "rs", "x", "ly", "mp", "é", "st")]
    rows, labels, want = [], [], {}
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vermin", "Filth,", f"zork{rng.choice(words)}"]))
        rows.append((i, " ".join(text)))
        want[i] = int(bad)
        if i < 450:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, toxic int"), want


def test_toxicity_on_held_out_texts(spark, labelled):
    docs, labels, want = labelled
    model = toxic.fit(docs, labels)
    got = {r.doc_id: r for r in toxic.score(docs, model).collect()}
    held = [i for i in want if i >= 450]
    assert sum((got[i].score >= 0.5) == want[i] for i in held) >= 0.97 * len(held)
    r = got[455]
    assert r.passages and all(re.search("vermin|filth|zork", r.text[p.start:p.end], re.I) and p.e_value <= 0.01 for p in r.passages)
    assert not any(got[i].passages for i in held if not want[i])
    odd = spark.createDataFrame([(1, "vermin " * 30_000, "z", "z"), (None, None, "z", "z"), (2, "", "z", "z"), (2, "", "z", "z"), (3, "kan", "z", "z")],
                                "doc_id long, text string, score string, passages string")
    scored = toxic.score(odd, model).collect()
    clean = min(x.score for x in scored)
    assert sorted((x.doc_id or 0, x.score > 0.5, len(x.passages)) for x in scored) == [(0, False, 0), (1, True, 1), (2, False, 0), (2, False, 0), (3, False, 0)]
    assert sum(x.score == clean for x in scored) == 4
    assert (scored[0].passages[0].start, scored[0].passages[0].end) == (0, 7 * 30_000 - 1)
    assert toxic.score(odd.where("false"), model).count() == 0


def test_toxicity_without_labels(spark, labelled):
    docs, labels, _ = labelled
    few = docs.limit(5)
    none = labels.where("false")
    assert {r.score for r in toxic.score(few, toxic.fit(docs, none)).collect()} == {0.0}
    assert {r.score for r in toxic.score(few, toxic.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    same = labels.withColumn("toxic", (F.col("doc_id") % 2).cast("int")).where("doc_id % 5 <> 0").limit(8)
    assert all(0 <= r.score <= 1 for r in toxic.score(few, toxic.fit(docs, same)).collect())
    twice = labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert toxic.fit(docs, twice) == toxic.fit(docs, labels)
