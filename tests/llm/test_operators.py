"""The training-data operators on small tables, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from formproof.llm import bpe, editprint, html, lines, mix, pii, quality, setjoin, shards, vectors

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "rs", "x", "ly", "Mp", "é")]
#: Columns that operators add or use inside.
CLASHES = "n_lines size target taken kept ids decoded n_grams shard slot _id _row _all _src _h _pos label rep t a b n".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = [prose(rng, 9) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [prose(rng, rng.randint(3, 20)) for _ in range(rng.randint(1, 5))]
        parts += [rng.choice([s, s.upper(), f" \t{s}\r"]) for s in shared if rng.random() < 0.3]
        rng.shuffle(parts)
        out.append((i, "\n".join(parts), f"s{i % 3}" if i % 7 else "hot"))
    base = out[10][1].split(" ")
    for i in range(60, 70):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        out.append((i, " ".join(near), "hot"))
    out += [(70, out[3][1], "s0"), (71, None, None), (72, "", None), (73, "\n\n", "s1"), (74, " \t ", "s1"), (75, "one", None)]
    out += [(76, "x" * 3000 + " " + "ab" * 900 + "\n" + prose(rng, 4000), "hot"), (77, "mail A.b@c-d.org, ip 1.2.3.4 or 1.2.3.400; +1 (319) 555-5132!", "s2")]
    out += [(78, "card 4111 1111 1111 1111 no 4111 1111 1111 1112 password=b7db7aa4a5fcc78305 a@b@c.de x@y @z.com", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, ties and clashing columns."""
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    some = [(1, "same words in this line here", "a"), (1, "same words in this line here", "a"), (None, "same words in this line here", "a"),
            (None, None, None), (2, None, "b"), (2, "same words in this line here", None), (3, "", "b")]
    return spark.createDataFrame([(*r, *("z" * len(CLASHES))) for r in some], f"doc_id long, text string, source string, {names}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def kept_lines(rows):
    keys = defaultdict(set)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            keys[key(line)].add(i)
    out = {}
    for i, text, _ in rows:
        cut = (text or "").split("\n")
        keep = [x for x in cut if len(key(x)) < 20 or len(keys[key(x)]) < 3 or max(keys[key(x)]) == i]
        out[i] = ("\n".join(keep), len(cut), len(cut) - len(keep))
    return out


def test_lines_match_brute_force(docs, rows):
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect()}
    want = kept_lines(rows)
    assert got == want and any(w[2] for w in want.values())


def test_lines_odd_and_empty(odd, empty):
    got = lines.dedup_lines(odd).collect()
    assert len(got) == 7 and all(r["_id"] == "z" and r["_row"] == "z" for r in got)
    assert {(r.doc_id, r.text) for r in got if r.n_dropped} == {(1, ""), (None, "")}  # doc 2 keeps the line
    assert lines.dedup_lines(empty).count() == 0


def test_line_runs_stay_few(spark, docs):
    index = lines.LineRuns(spark)
    for i in range(5):
        index.add(docs.where(f"doc_id % 5 = {i}"))
    assert len(index.runs()) <= 3
    runs = [r.select(*lines.HASH).count() for r in index.runs()]
    every = lines.keyed_lines(docs, 20).select(*lines.HASH).distinct().count()
    assert sum(runs) == every
    index.clear()


def brute_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_match_plain_patterns():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab.-@+12345 ()é%\n") for _ in range(rng.randint(0, 60)))
        good, _ = pii.base_spans(text)
        assert [(pii.KINDS[k], a, b) for k, a, b in good] == brute_spans(text), text


def test_pii_spans(docs, rows, odd, empty):
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    for i, text, _ in rows:
        assert [tuple(s) for s in got[i].base] == brute_spans(text)
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
    assert pii.find_spans(odd).count() == 7 and pii.find_spans(empty).count() == 0


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) + 1 for p in (0.95, 0.9, 0.6)], axis=1)
    post, table = pii.reliabilities(votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.93 and table[1, 0, 2] > table[1, 2, 2]


def test_shards_law(docs, rows, odd, empty):
    got = shards.shuffled_shards(docs, shards=8).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 8
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))] != sorted(r[0] for r in rows)
    assert shards.shuffled_shards(odd).count() == 7 and shards.shuffled_shards(empty).count() == 0


def test_written_shards(docs, tmp_path):
    placed = shards.shuffled_shards(docs, shards=4)
    shards.write_shards(placed, str(tmp_path / "out"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_quality_separates_held_out(spark, odd, empty):
    rng = random.Random(3)
    junk = [f"w{rng.randrange(40)}!!" for _ in range(40)]
    some = [(i, prose(rng, 80) if i % 4 else " ".join(rng.choice(junk) for _ in range(80))) for i in range(400)]
    table = spark.createDataFrame(some, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.score(table, labels).collect() if r.doc_id >= 200}
    assert sum(kept[i] for i in kept if i % 4) >= 0.95 * 150 and sum(kept[i] for i in kept if i % 4 == 0) <= 5
    assert quality.score(odd, labels).count() == 7 and quality.score(empty, labels).count() == 0
    assert all(r.kept for r in quality.score(odd, labels.where("false")).collect())


def test_kth_largest(spark):
    values = [random.Random(4).choice([0.5, 1.5, random.random()]) for _ in range(300)]
    table = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 7, 150, 300):
        assert quality.kth_largest(table, "v", k, width=10) == sorted(values, reverse=True)[k - 1]


def test_edited_prints(docs, rows, odd, empty):
    got = {r.doc_id: r for r in editprint.edited_prints(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text, _), (_, after, _) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == editprint.fingerprint(text) and r.edited_fingerprint == editprint.fingerprint(edited)
        assert r.near_next == editprint.likeness(r.fingerprint, editprint.fingerprint(after))
    assert editprint.edited_prints(odd).count() == 7 and editprint.edited_prints(empty).count() == 0


def test_likeness_follows_edits():
    rng = random.Random(6)
    text = prose(rng, 900)
    cut = rng.randrange(len(text))
    near = text[:cut] + "inserted words" + text[cut:]
    assert editprint.likeness(*map(editprint.fingerprint, (text, near))) > 0.8
    assert editprint.likeness(*map(editprint.fingerprint, (text, prose(rng, 900)))) < 0.45
    assert editprint.likeness(editprint.fingerprint(""), editprint.fingerprint("")) == 1.0


def test_near_links_find_edited_copies(spark):
    rng = random.Random(11)
    some = []
    for i in range(40):
        words = prose(rng, 300).split(" ")
        some.append((2 * i, " ".join(words)))
        words[150] = "edited"
        some.append((2 * i + 1, " ".join(words)))
    some += [(200, some[0][1]), (201, None), (202, "")]
    prints = spark.createDataFrame([(i, editprint.fingerprint(t or "")) for i, t in some], "doc_id long, fingerprint string")
    found = {(r.a, r.b): r.likeness for r in editprint.near_links(prints, least=0.7).collect()}
    of = dict(some)
    near = {i: editprint.likeness(*(editprint.fingerprint(of[2 * i + k]) for k in (0, 1))) for i in range(40)}
    close = [(2 * i, 2 * i + 1) for i in near if 0.7 <= near[i] < 1]  # those with equal prints are one node
    assert len(close) > 15 and sum(p in found for p in close) >= 0.9 * len(close)
    assert all(a // 2 == b // 2 for a, b in found)
    assert editprint.near_links(prints.where("false")).count() == 0


def test_near_links_compare_all_of_a_key(spark):
    rng = random.Random(13)
    words, some = prose(rng, 300).split(" "), []
    for i in range(120):
        copy = list(words)
        copy[200 + rng.randrange(100)] = f"edit{i}"
        some.append((i, editprint.fingerprint(" ".join(copy))))
    some += [(200 + i, editprint.fingerprint("ab"[i % 2] * (1 + i % 5))) for i in range(12)]
    first = {}
    for i, p in some:
        first.setdefault(p, i)
    want = {}
    for p, i in first.items():
        for q, j in first.items():
            if i < j and set(editprint.band_keys(p)) & set(editprint.band_keys(q)) and editprint.likeness(p, q) >= 0.6:
                want[i, j] = editprint.likeness(p, q)
    prints = spark.createDataFrame(some, "doc_id long, fingerprint string")
    for block in (16, 512):
        got = editprint.near_links(prints, least=0.6, block=block).collect()
        assert {(r.a, r.b): r.likeness for r in got} == want and len(got) == len(want)
    assert len(want) > 0.5 * len(first) * (len(first) - 1) / 2 and len(first) > 40


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(8)
    made = []
    for i in range(300):
        centre = np.random.default_rng(i % 40).normal(size=16)
        made.append((i, (centre + rng.normal(size=16) * 0.12).astype("float32").tolist(), i % 3))
    made += [(300, made[0][1], 0), (301, made[0][1], 0), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] * 16, 1), (305, made[0][1], None),
             (306, [None] * 16, 0), (307, [], 0)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")
    result = vectors.near_vectors(table, per_shard=64)
    got = {r.vec_id: r for r in result.collect()}
    unit = {i: vectors._unit(v) for i, v, label in made if label is not None}
    links = defaultdict(set)
    for i, _, a in made:
        for j, _, b in made:
            if i != j and a == b and unit.get(i) is not None and unit.get(j) is not None and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)
    assert len(got) == len(made)
    assert all(got[i].n_links <= len(links[i]) for i in got)
    assert sum(got[i].n_links for i in got) >= 0.9 * sum(map(len, links.values())) > 0
    for i in (302, 303, 304, 305, 306, 307):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert vectors.recall(table, result, every=5) >= 0.9
    assert vectors.near_vectors(table.where("false")).count() == 0


def test_vectors_link_across_many_shards(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1300, 64))
    other = rng.normal(size=(1300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.choice([0.92, 0.935, 0.96], size=(1300, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other, base[:40]])
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    classes = vectors.units(table).withColumnRenamed("vec_id", "rep")
    assert len(vectors._pivots(classes, 8, 65_536)[0, 8 * 64]) >= 256
    result = vectors.near_vectors(table, per_shard=8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in result.collect()}
    assert [got[i].n_links for i in range(len(x))] == linked.sum(1).tolist() and linked.sum() > 1600
    name = np.arange(len(x))
    for _ in range(4):
        name = np.minimum(name, np.where(linked, name, len(x)).min(1))
    assert [got[i].component_id for i in range(len(x))] == name.tolist()
    assert vectors.recall(table, result) == 1.0


def test_mix_targets(docs, rows, odd, empty):
    got = mix.mix(docs, block_words=4, shard_slots=64).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(re.findall(mix.WORD, t or ""))) for i, t, _ in rows)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r.size
    assert all(size[s] == next(r.source_size for r in got if r.source == s) for s in size)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 or all(target[s] == 3 * size[s] for s in size)
    assert all(abs(taken[s] - target[s]) <= 12 for s in size)
    again = mix.mix(docs, block_words=4, shard_slots=64).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mix.mix(odd).count() == 7 and mix.mix(empty).count() == 0
    copies = mix.mixed_documents(docs, block_words=4, shard_slots=64)
    assert sum(len(re.findall(mix.WORD, r.text)) for r in copies.collect()) == sum(taken.values())


def test_targets_and_permutation():
    goal = mix.targets([("a", 10), ("b", 100), ("c", 100)], (5, 2, 1), 3)
    assert [float(g) for g in goal] == [30.0, 120.0, 60.0]
    for n in (1, 2, 7, 64, 1000):
        out = mix.permuted(np.arange(n), np.full(n, n), np.full(n, 99, dtype=np.uint64))
        assert sorted(out.tolist()) == list(range(n))


def test_bpe_matches_tiktoken(docs, rows, odd, empty):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    real = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, pattern).collect()}
    for i, text, _ in rows:
        assert np.frombuffer(got[i].ids, dtype="<u4").tolist() == real.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()
    again = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert {r.doc_id: bytes(r.decoded) for r in again} == {i: (t or "").encode() for i, t, _ in rows}
    assert bpe.encode_decode(odd, path, pattern).count() == 7 and bpe.encode(empty, path, pattern).count() == 0


def grams(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("words, percent, page", [(4, 85, 1024), (2, 60, 8)])
def test_set_join_matches_brute_force(docs, rows, words, percent, page, monkeypatch):
    monkeypatch.setattr(setjoin, "PAGE", page)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similar_sets(docs, words, percent).collect()}
    sets = {i: grams(t, words) for i, t, _ in rows}
    name = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((name[i], name[j]))
                name = {k: a if v == b else v for k, v in name.items()}
    assert got == {i: (len(sets[i]), name[i]) for i in sets}


def test_set_join_odd_and_empty(odd, empty):
    got = sorted(map(tuple, setjoin.similar_sets(odd).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 0, None), (2, 0, 2), (2, 3, 1), (3, 0, 3)], key=str)
    assert setjoin.similar_sets(empty).count() == 0


def test_html_main_text(spark):
    rng = random.Random(9)
    pages, want = [], {}
    for i in range(60):
        body = [f"{prose(rng, 20)}. {prose(rng, 12)}." for _ in range(4)]
        pages.append((i, f"u{i}", f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></ul></nav>"
                      f"<div class=\"ad\">{prose(rng, 9)}. Buy.</div><article><h1>Big &amp; small</h1>{''.join(f'<p>{b}' for b in body)}</article><footer>&copy; me</footer></body></html>"))
        want[i] = " ".join(["Big & small", *body])
    pages += [(60, None, None), (61, "u", ""), (61, "u", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.main_text(table).collect()]
    assert len(got) == 63
    for i, text, n in got:
        assert text == want.get(i, "") and n == len(text)
    assert html.main_text(table.where("false")).count() == 0


def test_html_structures():
    page = html.Page("<div><p>One <b>bo</b>ld &lt;x&gt;<br>two<li>a<li>b<table><tr><td>c<td>d</table>")
    assert page.decode(np.ones(len(page.tag))) == "One bold <x> two a b c d"
    page = html.Page("a<script>x</script>b<!-- c --><style>y")
    assert page.decode(np.ones(len(page.tag))) == "a b"


def test_html_raw_ends_after_letters_that_grow():
    page = html.Page("<body><p>İİİ one</p><SCRIPT>x < y</Script><p>two</p><style>z</STYLE>three</body>")
    assert page.decode(np.ones(len(page.tag))) == "İİİ one two three"


def test_crc_and_hash_helpers():
    assert len(quality.hashed_ngrams("a b c")) == 5 and math.isclose(zlib.crc32(b"a") % quality.BUCKETS, quality.hashed_ngrams("A")[0])
