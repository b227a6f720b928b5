from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formproof.functions.ranking import hashed_rank, score_bucket
from formproof.operators import calibration, metrics, review, splits, textmodel, variants


def table(spark, y, s, parts=3):
    rows = [(f"r{i % 17}", f"p{i}", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "record_id string, pair_id string, label int, score double").repartition(parts)


def average_precision(y, s):
    ap, tp, n = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        hit = s == v
        tp, n = tp + y[hit].sum(), n + hit.sum()
        ap += y[hit].sum() / y.sum() * tp / n
    return ap


def auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return np.mean([(a > n).mean() + 0.5 * (a == n).mean() for a in p])


@pytest.mark.parametrize("kind", ["continuous", "coarse", "crowded"])
def test_ranking_metrics_match_numpy(spark, kind):
    rng = np.random.default_rng(1)
    y = (rng.random(800) < 0.1).astype(int)
    s = rng.random(800)
    if kind == "coarse":
        s = np.round(s, 1)
    if kind == "crowded":
        s = np.concatenate([s[:400] * 1e-9, 1 - s[400:] * 1e-9])
    df = table(spark, y, s)
    row = metrics.ranking_metrics(metrics.score_steps(df)).first()
    assert math.isclose(row.pr_auc, average_precision(y, s), rel_tol=1e-9)
    assert math.isclose(row.roc_auc, auc(y, s), rel_tol=1e-9)
    curve = metrics.pr_curve(metrics.score_steps(df))
    assert curve.count() == len(set(s))


def test_score_bucket_never_decreases(spark):
    v = sorted([0.0, 1.0, 0.5, 0.5000001, 0.4999999, *np.random.default_rng(0).random(500), 1e-300, 1 - 1e-16])
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in v], "v double").select(score_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def test_single_class_is_nan(spark):
    row = metrics.ranking_metrics(metrics.score_steps(table(spark, [0, 0], [0.1, 0.2]))).first()
    assert math.isnan(row.pr_auc) and math.isnan(row.roc_auc)


def test_threshold_rules(spark):
    y = np.array([1] * 10 + [0] * 90)
    s = np.zeros(100)
    s[:3] = 0.9
    row = metrics.threshold_for_recall(table(spark, y, s), 0.8).first()
    assert row.threshold == 0.9 and row.recall == 0.3
    row = metrics.threshold_for_recall(table(spark, y, np.zeros(100)), 0.8).first()
    assert row.threshold == 1.0 and row.n_flags == 0
    df = table(spark, y, s).withColumn("m", F.lit("x"))
    ev = metrics.evaluate(df, ["m"]).first()
    assert len(ev.notes) == 2 and "30%" in ev.notes[0] and ev.threshold == 0.9


def test_bins_follow_the_edges(spark):
    df = spark.createDataFrame([(0.3, 0), (0.30000000000000004, 1), (1.0, 1), (0.0, 0)], "v double, b int")
    got = [r[0] for r in df.select(calibration.bin_number(F.col("v"), 10)).collect()]
    assert got == [2, 3, 9, 0]
    rng = np.random.default_rng(2)
    s, y = rng.random(500), (rng.random(500) < 0.3).astype(int)
    row = calibration.calibration(calibration.reliability_bins(table(spark, y, s))).first()
    edges = np.linspace(0, 1, 11)
    ece = rel = res = 0.0
    for a, b in zip(edges[:-1], edges[1:]):
        m = (s >= a) & (s < b)
        ece += m.sum() * abs(s[m].mean() - y[m].mean())
        rel += m.sum() * (s[m].mean() - y[m].mean()) ** 2
        res += m.sum() * (y[m].mean() - y.mean()) ** 2
    assert math.isclose(row.ece, ece / 500, rel_tol=1e-9)
    assert math.isclose(row.reliability, rel / 500, rel_tol=1e-9)
    assert math.isclose(row.resolution, res / 500, rel_tol=1e-9)


def test_bootstrap_interval_is_close_to_resampling_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", f"p{i}_{j}", 1, float(rng.random() < 0.7)) for i in range(60) for j in range(rng.integers(1, 4))]
    df = spark.createDataFrame(rows, "record_id string, pair_id string, label int, score double")
    a = calibration.bootstrap_recall(df, 0.5, n_boot=800).first()
    b = calibration.bootstrap_recall(df.repartition(7), 0.5, n_boot=800).first()
    assert a == b
    ids = sorted({r[0] for r in rows})
    tp = np.array([sum(r[3] for r in rows if r[0] == i) for i in ids])
    pos = np.array([sum(1 for r in rows if r[0] == i) for i in ids])
    est = []
    for _ in range(2000):
        pick = rng.integers(0, len(ids), len(ids))
        est.append(tp[pick].sum() / pos[pick].sum())
    lo, hi = np.percentile(est, [2.5, 97.5])
    assert abs(a.low - lo) < 0.03 and abs(a.high - hi) < 0.03
    none = calibration.bootstrap_recall(df.withColumn("label", F.lit(0)), 0.5, n_boot=20).first()
    assert (none.low, none.high) == (0.0, 1.0)


def inst(spark, n=300):
    rows = [
        (f"r{i % 40}", f"p{i}", f"u{i % 23}" if i % 5 else "", int(i % 11 == 0)) for i in range(n)
    ]
    return spark.createDataFrame(rows, "record_id string, pair_id string, unit_key string, label int")


@pytest.mark.parametrize("kind", ["record", "unit"])
def test_folds_and_splits(spark, kind):
    df = inst(spark)
    folded = splits.with_folds(df, kind, 5).withColumn("g", splits.group_key(kind)).collect()
    assert len(folded) == 300 and {r.fold for r in folded} == set(range(5))
    by_group = {}
    for r in folded:
        by_group.setdefault(r.g, set()).add(r.fold)
    assert all(len(f) == 1 for f in by_group.values())
    assert {r.fold for r in folded if r.label} == set(range(5))
    again = splits.with_folds(df.repartition(6), kind, 5).collect()
    assert {(r.pair_id, r.fold) for r in folded} == {(r.pair_id, r.fold) for r in again}
    side = splits.make_split(df, kind).withColumn("g", splits.group_key(kind)).collect()
    sides = {}
    for r in side:
        sides.setdefault(r.g, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    assert {r.split for r in side if r.label} == {"train", "test"}


def test_unknown_split_kind():
    with pytest.raises(ValueError):
        splits.group_key("day")


def test_hashed_rank_is_a_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("s"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = hashed_rank(df, ["s"], "h").collect()
    for s in range(3):
        mine = sorted((r for r in rows if r.s == s), key=lambda r: r.h)
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert {r.stratum_size for r in mine} == {len(mine)}


# ---------------------------------------------------------------- text model
@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        bad = i % 4 == 0
        words = rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 6).tolist()
        if bad and i % 8 == 0:
            words.append("trouble")
        rows.append((f"r{i}", f"p{i % 3}", "t", "yes" if i % 2 else "no", " ".join(words), bool(i % 2), int(bad), None))
    cols = "record_id string, pair_id string, test_id string, structured_value string, free_text string, is_outside_leaning boolean, label int, anomaly string"
    return spark.createDataFrame(rows, cols).repartition(3).cache()


def dense(model, df, names):
    """The rows of df as a numpy matrix over the model's features."""
    known = {(r.block, r.term): (r.i, r.coef) for r in model.features.select("block", "term", "i", "coef").collect()}
    rows = textmodel.vectors(textmodel.entries(df), model.features.select("block", "term", "idf", "i"), textmodel.KEYS).collect()
    x = np.zeros((len(names), len(known)))
    at = {k: j for j, k in enumerate(names)}
    for r in rows:
        for e in r.features:
            x[at[r.record_id], e.i] += e.w
    coef = np.zeros(len(known))
    for i, c in known.values():
        coef[i] = c
    return x, coef, {k: i for k, (i, _) in known.items()}


def test_text_model_reaches_the_optimum(texts):
    model = textmodel.fit(texts, textmodel.TextModelConfig(tol=1e-5))
    scored = {r.record_id: r for r in model.score(texts).collect()}
    names = sorted(scored)
    x, coef, place = dense(model, texts, names)
    y = np.array([scored[k].label for k in names], dtype=float)
    n = len(names)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    fit = model.fits.first()
    prob = 1 / (1 + np.exp(-(x @ coef + fit.intercept)))
    gradient = coef + x.T @ (weight * (prob - y))
    assert np.abs(gradient).max() < 1e-4 and abs((weight * (prob - y)).sum()) < 1e-4 and fit.violation < 1e-4
    assert np.allclose([scored[k].score for k in names], prob, atol=1e-9)
    for block in textmodel.TEXT_BLOCKS:
        part = x[:, [i for (b, _), i in place.items() if b == block]]
        norms = np.linalg.norm(part, axis=1)
        assert part.shape[1] and np.all((np.abs(norms - 1) < 1e-9) | (norms == 0))
    worst = textmodel.optimality(model, texts).agg(F.max("violation")).first()[0]
    assert worst < 1e-4
    top = model.top_features(texts.where("record_id = 'r0'")).first().top_features
    assert any("trouble" in t.feature for t in top) and all(not t.feature.startswith(" ") for t in top)
    assert len(top) <= 4 and [t.weight for t in top] == sorted((t.weight for t in top), reverse=True) and top[-1].weight > 0
    with pytest.raises(ValueError):
        textmodel.fit(texts.withColumn("label", F.lit(0)))
    with pytest.raises(RuntimeError):
        textmodel.TextModel().score(texts)


def test_fold_models_equal_fits_on_their_training_rows(texts):
    fold = (F.substring("record_id", 2, 9).cast("int") / 4).cast("int") % 2
    folded = texts.withColumn("folds", F.array(
        F.struct(F.lit("a").alias("split"), fold.alias("fold")), F.struct(F.lit("b").alias("split"), (F.floor(fold / 2) + F.when(F.col("pair_id") == "p0", 1).otherwise(0)).cast("int").alias("fold"))))
    cfg = textmodel.TextModelConfig(tol=1e-5)
    both = textmodel.fit_folds(folded, cfg)
    assert {tuple(r) for r in both.fits.select("split", "fold").collect()} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    assert both.fits.agg(F.max("violation")).first()[0] < 1e-4
    held = folded.select("*", F.inline("folds"))
    got = {(r.split, r.record_id): r.score for r in both.score(held).collect()}
    for split, k in (("a", 1), ("b", 0)):
        side = held.where(F.col("split") == split).drop("folds")
        alone = textmodel.fit(side.where(F.col("fold") != k), cfg)
        for r in alone.score(side.where(F.col("fold") == k)).collect():
            assert abs(r.score - got[split, r.record_id]) < 1e-3
    with pytest.raises(ValueError):
        textmodel.fit_folds(texts.withColumn("folds", F.array(F.struct(F.lit("l").alias("split"), F.col("label").alias("fold")))), cfg)


def test_minimise_finds_the_least_point():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12))
    h, c = a.T @ a + np.eye(12), rng.normal(size=12)
    run = textmodel._minimise(12, 1e-8, 500)
    x = next(run)
    try:
        while True:
            x = run.send((0.5 * x @ h @ x - c @ x, h @ x - c))
    except StopIteration as end:
        x, worst = end.value
    assert worst <= 1e-8 and np.allclose(x, np.linalg.solve(h, c), atol=1e-7)


def test_entries_are_counted_in_their_row(spark):
    from collections import Counter

    rows = [(f"r{i}", "p", "t", "yes", text, True, None) for i, text in enumerate(["Aa bb aa bb\tccc ünï  x", "", None, "aa " * 400, "y" * 3000])]
    df = spark.createDataFrame(rows, "record_id string, pair_id string, test_id string, structured_value string, free_text string, is_outside_leaning boolean, anomaly string")
    found = textmodel.entries(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    got = {(r.record_id, r.block, r.term): r.v for r in found.where(F.col("block").isin(*textmodel.TEXT_BLOCKS)).collect()}
    grams = df.select("record_id", textmodel.word_grams(textmodel.answer_and_text()).alias("word"), textmodel.char_grams(F.col("free_text")).alias("char"), textmodel.interaction_tokens().alias("cross"))
    want = {(r.record_id, b, t): n for r in grams.collect() for b in textmodel.TEXT_BLOCKS for t, n in Counter(r[b] or ()).items()}
    assert got == want and len(got) == found.where(F.col("block").isin(*textmodel.TEXT_BLOCKS)).count()


def test_tokens(spark):
    df = spark.createDataFrame([("A bc  déf a-b x_1",)], "t string")
    words, chars = df.select(textmodel.word_grams(F.col("t")), textmodel.char_grams(F.col("t"))).first()
    assert words == ["bc", "déf", "x_1", "bc déf", "déf x_1"]
    assert chars[:5] == [" a ", " bc", "bc ", " bc ", " dé"] and " déf " in chars


# ------------------------------------------------------------- review, variants
def test_priority_goldens(spark):
    from formproof.catalog import demo

    rows = [("a", 6.0, False), ("b", 4.0, False), ("c", 1.0, False), ("d", 1.0, True), ("e", None, None)]
    df = spark.createDataFrame(rows, "id string, s double, g boolean")
    got = dict(df.select("id", review.priority_level(F.col("s"), F.col("g"), demo.REVIEW)).collect())
    assert got == {"a": "close", "b": "moderate", "c": "light", "d": "urgent", "e": "none"}


def test_review_output_has_no_status(spark):
    from formproof.catalog import base, reviewing

    t = base.Tables(spark, "/root/testdata/sf0.001")
    for name, df in reviewing._assess(t.form, None).tables().items():
        assert not {"status", "outcome_label"} & set(df.columns) or name == "instances"


def test_variant_rendering(spark):
    df = spark.createDataFrame([("1", "p", "the worker sets the method"), ("2", "p", "it is here and is fine.")],
                               "record_id string, pair_id string, free_text string")
    regs = {
        "plain": {"openers": [""], "closers": [""]},
        "soft": {"openers": ["I think"], "closers": ["bye"], "add_second_sentence_rate": 1.0, "softeners": {" is ": " may be "}},
    }
    got = {(r.record_id, r.variant): r.free_text for r in variants.make_variants(df, regs).collect()}
    assert got[("1", "plain")] == "The worker sets the method."
    assert got[("2", "plain")] == "It is here and is fine."
    assert got[("2", "soft")] == "I think it may be here and is fine. Bye."


def test_a_first_letter_stays_one_letter(spark):
    texts = ["ßachzu", "«ﬁn", "ᾳ", "ŉ", "élan", "1 ab", "", " "]
    got = {r.t: r.u for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", variants.capitalise(F.col("t")).alias("u")).collect()}
    assert got == dict(zip(texts, ["ẞachzu", "«ﬁn", "ᾼ", "ŉ", "Élan", "1 Ab", "", " "], strict=True))


def test_identical_variants_agree(spark):
    rows = [("r", f"p{i}", v, 1, "a", 0.5 if i else 0.1) for i in range(3) for v in ("x", "y")]
    df = spark.createDataFrame(rows, "record_id string, pair_id string, variant string, label int, archetype string, score double")
    wide = variants.side_by_side(df, ["x", "y"])
    row = variants.agreement_summary(variants.record_agreement(wide, ["x", "y"], 0.4), ["x", "y"]).first()
    assert row.mean_jaccard == 1.0 and row.records_fully_agreeing == 1
    assert variants.worst_flips(wide, ["x", "y"], 0.4).count() == 0


def test_replicates_of_several_keys_are_the_draws_of_each_record(spark):
    rows = [(f"r{i}", k, (i + j) % 3, 1 + i % 4) for i in range(40) for j, k in enumerate("abc") if (i + j) % 5]
    per = spark.createDataFrame(rows, "record_id string, level string, tp long, pos long").repartition(3, "record_id")
    got = calibration.bootstrap_replicates(per, ["level"], 30, 7)
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])

    def draw(record, r):
        digest = hashlib.md5(f"7|{record}|{r // 4}".encode()).hexdigest()
        return int((edges <= int(digest[8 * (r % 4):][:8], 16) / (16 ** 8 - 1)).sum())

    want = {}
    for level in "abc":
        for r in range(30):
            own = [(draw(i, r), tp, pos) for i, k, tp, pos in rows if k == level]
            if total := sum(m * pos for m, _, pos in own):
                want[level, r] = sum(m * tp for m, tp, _ in own) / total
    assert {(x.level, x.replicate): x.recall for x in got.collect()} == want
    # no row for each record and replicate is made on the way
    assert "sequence(" not in got._jdf.queryExecution().toString()


def test_versions_score_as_rows_of_their_own(spark):
    rows = [("r1", "p", True, "en", "it's fine and fine"), ("r2", "p", False, "en", "trash 7 X"), ("r3", "p", True, "fr", ""), ("r4", "p", True, None, "fine")]
    df = spark.createDataFrame(rows, "record_id string, pair_id string, is_outside_leaning boolean, test_id string, free_text string").withColumns(
        {"structured_value": F.lit("good"), "anomaly": F.lit(None).cast("string")})
    known = [("cross", t, 1.0 + k / 3, (-1.0) ** k) for k, t in enumerate(["OUT~en~fine", "OUT~en~it's", "IN~en~trash", "IN~en~more", "OUT~en~more"])]
    model = textmodel.TextModel(
        spark.createDataFrame(known, "block string, term string, idf double, coef double"), spark.createDataFrame([(0.25,)], "intercept double"),
        textmodel.TextModelConfig(categories=()), (), ("cross",))
    versions = {"a": F.col("free_text"), "b": F.concat(F.lit("More "), F.col("free_text"), F.lit(" fine"))}
    got = {(r.record_id, r.variant): r.score for r in model.score_versions(df, versions).collect()}
    want = {}
    for name, text in versions.items():
        for r in model.score(df.withColumn("free_text", text)).collect():
            want[r.record_id, name] = r.score
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    assert len(set(got.values())) > 4


def test_a_fit_takes_few_passes_over_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    common, rare = [f"com{k}" for k in range(40)], [f"rare{k}" for k in range(400)]
    rows = []
    for k in range(2000):
        words = [*rng.choice(common, 30), *rng.choice(rare, 10), *(["gift"] if k % 9 == 0 and rng.random() < 0.5 else [])]
        rows.append((f"r{k}", "p", "t", ("yes", "no")[k % 2], " ".join(words), k % 2 == 0, None, int(k % 9 == 0)))
    train = spark.createDataFrame(
        rows, "record_id string, pair_id string, test_id string, structured_value string, free_text string, is_outside_leaning boolean, anomaly string, label int")
    passes, once = [], textmodel._evaluate
    monkeypatch.setattr(textmodel, "_evaluate", lambda *args: passes.append(1) or once(*args))
    model = textmodel.fit(train, textmodel.TextModelConfig(tol=1e-4))
    assert model.fits.first().violation <= 1e-4 and len(passes) <= 80, len(passes)


def test_terms_counted_by_number_equal_those_counted_as_text(spark):
    many = " ".join(chr(0x4E00 + k) * 3 for k in range(4200))  # more characters than the numbers hold
    texts = ["Aa bb aa bb\tccc ünï  x", "", None, "aa " * 400, "y" * 3000, "a\0b a\0b", "🙂 🙂🙂 a", many, many, "\x1fé é é é x x"] * 3
    rows = [(f"r{k}", "p", "t", "yes", text, True, None) for k, text in enumerate(texts)]
    df = spark.createDataFrame(
        rows, "record_id string, pair_id string, test_id string, structured_value string, free_text string, is_outside_leaning boolean, anomaly string")

    def told(counts):
        return {(r.block, r.term): (r.df, r.tf, r.n) for r in counts.collect()}

    want = told(textmodel.count_features(textmodel.entries(df), len(texts)))
    totals = textmodel._text_totals(df.coalesce(1), textmodel.TEXT_BLOCKS)
    assert totals.count() < textmodel.entries(df).count() / 2  # added up before they leave a task
    assert told(textmodel.count_terms(df, len(texts))) == want
    features = textmodel.vocabulary(textmodel.count_terms(df, len(texts)), textmodel.TextModelConfig())
    features = textmodel.written(features.join(textmodel.numbered(features)[0], ["block", "term"]), "numbered")
    one, other = (
        {r.record_id: [(e.i, round(e.w, 9)) for e in r.features] for r in textmodel.vectors(found, features, textmodel.KEYS).collect()}
        for found in (textmodel.entries(df), textmodel.entry_parts(df)))
    assert one == other and len(one) == len(texts)
    few = features.where("length(term) < 5 or block != 'char'").where("ascii(term) < 128")
    one, other = (
        {r.record_id: [(e.i, round(e.w, 9)) for e in r.features] for r in textmodel.vectors(found, few, textmodel.KEYS).collect()}
        for found in (textmodel.entries(df), textmodel.entry_parts(df)))
    assert one == other
