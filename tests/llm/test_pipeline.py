"""The pipeline's stages one after another on small tables, each against brute force on its own input."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from formproof.llm import bpe, quality

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "sa", "no") for b in ("n", "rs", "x", "ly", "mp", "é", "st")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    notice = prose(12)
    docs = []
    for i in range(90):
        lines = [prose(rng.randint(8, 20)) for _ in range(rng.randint(2, 5))]
        if i % 4 == 0:
            lines.append(notice)
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    near = docs[7][1].split(" ")
    near[3] = "other"
    docs += [(90, docs[5][1], "en", "s1"), (91, " ".join(near), "en", None), (92, "", "en", "s0"), (None, None, None, None)]
    docs += [(100 + i, "\n".join(f"$$ {rng.randint(0, 9)} %% {rng.randint(0, 99)} ## buy" for _ in range(12)), "en", "s2") for i in range(20)]
    place = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i, *_ in docs if i is not None and i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    """(input rows, output rows) of each stage, written and read as the pipeline does."""
    out, place = {}, tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, tables).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        out[name] = before, docs.collect()
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mix", "encode"]
    for name in list(stages)[:-1]:
        assert list(stages[name][1][0].asDict()) == corpus_pipeline.COLUMNS


def test_quality_is_the_top_by_its_own_keys(spark, tables, stages):
    before, after = stages["quality"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    scored = quality.score(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()
    kept = sorted((r.gumbel_key for r in scored if r.kept), reverse=True)
    assert all(r.gumbel_key < kept[-1] for r in scored if not r.kept)
    assert Counter((r.doc_id, r.text) for r in scored if r.kept) == Counter((r.doc_id, r.text) for r in after)
    assert not any(r.doc_id is not None and r.doc_id >= 100 for r in after)
    assert sum(1 for r in after if r.doc_id is not None and r.doc_id < 90) >= 80


def test_lines_by_brute_force(stages):
    before, after = stages["line_dedup"]
    key = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    holders = defaultdict(set)
    for r in before:
        for line in (r.text or "").split("\n"):
            holders[key(line)].add(-1 if r.doc_id is None else r.doc_id)
    want = Counter()
    for r in before:
        me = -1 if r.doc_id is None else r.doc_id
        stay = [x for x in (r.text or "").split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == me]
        want[r.doc_id, "\n".join(stay)] += 1
    assert Counter((r.doc_id, r.text) for r in after) == want
    assert any(len(x) >= 3 and len(k) >= 20 for k, x in holders.items()) and all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates_by_brute_force(stages):
    before, after = stages["near_duplicates"]

    def grams(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = [(r.doc_id, grams(r.text)) for r in before if r.doc_id is not None]
    name = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i in name if name[i] == i)
    assert 90 not in {r.doc_id for r in after}


def test_mix_takes_words_of_its_documents(stages):
    before, after = stages["mix"]
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in before}
    taken = Counter()
    for r in after:
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        it = iter(words[r.doc_id])
        assert own and all(w in it for w in own)  # in order
        taken[r.doc_id] += len(own)
    assert all(n <= 3 * len(words[i]) for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(map(len, words.values()))) <= 0.1 * sum(map(len, words.values()))


def test_encoding_matches_tiktoken(stages):
    before, after = stages["encode"]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    want = Counter((r.doc_id, np.array(real.encode_ordinary(r.text or ""), dtype="<u4").tobytes()) for r in before)
    assert Counter((r.doc_id, bytes(r.ids)) for r in after) == want
    assert all(r.decodes and r.n_tokens == len(r.ids) // 4 for r in after)
