"""Queries of families Q-S: review tables, profiling, streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import crossfield, deid, instances, profile, review, rules, validate
from ..plans.assess import Assessment, assess, build_method
from ..session import scratch_dir
from ..streaming import streams
from . import demo
from .base import Tables, op
from .deidentify import _CLEAN
from .scoring import _EXPLAIN, _TERMS
from .sql import (
    CROSS, DECISIONS, FINDINGS, FORM, FORM_HITS, FORM_INST, LABELLED, ROLLUP, ROUTE, SCORED,
)

SPEC, CFG = demo.FORM, demo.REVIEW
METHOD = "rules_as_authored"

_BAND = """CASE WHEN score >= 0.80 THEN 'High priority' WHEN score >= 0.42 THEN 'Priority'
 WHEN score >= 0.35 THEN 'Worth a look' END"""
_TIER = {"fulfilment": "foundational", "urgency": "major", "market": "contributing"}
_TIER_SQL = "CASE test_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TIER.items()) + " END"
_FLAG_MAT = f"CASE WHEN structured_field = 'q3_segment' THEN 'decisive' ELSE {_TIER_SQL} END"
_CROSS_MAT = "CASE check_id WHEN 'x_urgent_machinery' THEN 'decisive' ELSE 'foundational' END"
_MAT_W = "CASE materiality WHEN 'foundational' THEN 2.0 WHEN 'major' THEN 1.5 ELSE 1.0 END"


def _banded(t: Tables) -> DataFrame:
    return review.with_bands(rules.score_rules(t.form_inst, demo.FORM_RULES), CFG, METHOD)


@op(
    "Q1_bands",
    f"WITH {SCORED} SELECT pair_id, round(score, 6) AS score, {_BAND} AS band_label FROM scored",
)
def _(t: Tables):
    df = review.with_bands(t.scored, CFG, METHOD)
    return df.select("pair_id", F.round("score", 6).alias("score"), "band_label")


@op(
    "Q2_banded_flags",
    f"""WITH {FORM_HITS}, {_EXPLAIN}, b AS (SELECT *, {_BAND} AS band_label FROM explained)
     SELECT record_id, pair_id, row_number() OVER (PARTITION BY record_id ORDER BY b.score DESC, pair_id) AS place, form_ref, test_id,
      round(score, 6) AS score, band_label, explanation FROM b WHERE band_label IS NOT NULL""",
)
def _(t: Tables):
    refs = rules.form_refs(SPEC)
    return review.banded_flags(_banded(t)).select(
        "record_id", "pair_id", "place", refs.alias("form_ref"), "test_id",
        F.round("score", 6).alias("score"), "band_label", rules.explain(refs).alias("explanation"),
    )


@op(
    "Q3_gate_materiality",
    f"""WITH {FORM}, {FORM_INST} SELECT record_id, pair_id,
     CASE WHEN structured_field = 'q3_segment' THEN 'decisive' END AS label FROM form_inst""",
)
def _(t: Tables):
    m = review.gate_materiality(F.col("structured_field"), CFG)
    return t.form_inst.select("record_id", "pair_id", m["label"].alias("label"))


@op(
    "Q4_tier_materiality",
    f"WITH {FORM}, {FORM_INST} SELECT record_id, pair_id, {_TIER_SQL} AS label FROM form_inst",
)
def _(t: Tables):
    m = review.tier_materiality(F.col("test_id"), CFG)
    return t.form_inst.select("record_id", "pair_id", m["label"].alias("label"))


@op(
    "Q5_flag_materiality",
    f"""WITH {FORM}, {FORM_INST} SELECT record_id, pair_id, {_FLAG_MAT} AS label,
     structured_field = 'q3_segment' AS is_gate FROM form_inst""",
)
def _(t: Tables):
    m = review.flag_materiality(CFG)
    return t.form_inst.select(
        "record_id", "pair_id", m["label"].alias("label"), m["is_gate"].alias("is_gate")
    )


def _cross(t: Tables) -> DataFrame:
    rows = crossfield.cross_field_table(t.form, SPEC.cross_field_checks)
    return rows.withColumn(
        "materiality", review.cross_field_materiality(F.col("fields"), SPEC, CFG)
    )


@op(
    "Q6_cross_field_materiality",
    f"WITH {FORM}, {CROSS} SELECT record_id, check_id, {_CROSS_MAT} AS label FROM cross_",
)
def _(t: Tables):
    return _cross(t).select("record_id", "check_id", F.col("materiality.label").alias("label"))


def _priority_sql(form: str = "form") -> str:
    return f"""fb AS (SELECT *, {_BAND} AS band FROM form_scored), it AS (
      SELECT record_id, CASE band WHEN 'Worth a look' THEN 1 WHEN 'Priority' THEN 2 ELSE 3 END AS w,
       {_FLAG_MAT} AS materiality FROM fb WHERE band IS NOT NULL
      UNION ALL SELECT record_id, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
       {_CROSS_MAT} FROM cross_),
     pr AS (SELECT record_id, sum(w * {_MAT_W}) AS s, bool_or(materiality = 'decisive') AS g, count(*) AS n
      FROM it GROUP BY record_id),
     priority AS (SELECT f.record_id, coalesce(n, 0) AS n_items, CASE WHEN n IS NULL THEN 'none' WHEN g THEN 'urgent'
       WHEN s >= 6 THEN 'close' WHEN s >= 3 THEN 'moderate' ELSE 'light' END AS priority
      FROM {form} f LEFT JOIN pr USING (record_id))"""


@op(
    "Q7_review_priority",
    f"WITH {FORM_HITS}, {CROSS}, {_priority_sql()} SELECT record_id, n_items, priority FROM priority",
)
def _(t: Tables):
    flags = _banded(t).where(F.col("band_label").isNotNull()).withColumn(
        "materiality", review.flag_materiality(CFG)
    )
    items = review.priority_items(flags, _cross(t), CFG)
    return review.review_priority(t.form, items, CFG)


def _assess(df: DataFrame, work_dir: str | None) -> Assessment:
    method = build_method(METHOD, SPEC, ruleset=demo.FORM_RULES)
    return assess(df, SPEC, method, CFG, demo.DEID, demo.VALIDATION, work_dir)


# the composed plan scores the scrubbed texts
_CLEAN_FORM_HITS = FORM_HITS.replace(
    FORM, FORM.replace("form AS (", "raw_form AS (", 1)
    + f", form AS (SELECT * REPLACE ({_CLEAN} AS text) FROM raw_form)", 1
)


@op(
    "Q8_assessment_priority",
    f"WITH {_CLEAN_FORM_HITS}, {CROSS}, {_priority_sql()} SELECT record_id, n_items, priority FROM priority",
)
def _(t: Tables):
    return _assess(t.form, scratch_dir(t.spark, "q8")).priority


@op(
    "Q8_assessment_flags",
    f"""WITH {_CLEAN_FORM_HITS}, {_EXPLAIN}, b AS (SELECT *, {_BAND} AS band_label FROM explained)
     SELECT record_id, pair_id, form_ref, round(score, 6) AS score, band_label, explanation,
      {_FLAG_MAT} AS materiality FROM b WHERE band_label IS NOT NULL""",
)
def _(t: Tables):
    return _assess(t.form, None).flags.select(
        "record_id", "pair_id", "form_ref", F.round("score", 6).alias("score"), "band_label",
        "explanation", F.col("materiality.label").alias("materiality"),
    )


@op(
    "Q9_method_registry",
    f"""WITH {FORM_HITS}, lk AS (SELECT term, len(string_split(term, ' ')) AS words FROM (VALUES {_TERMS}) v(term)
       WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), term))),
     least_ AS (SELECT * FROM (VALUES ('rules_as_authored', 99), ('rules_phrase_deleaked', 2), ('rules_vocab_stripped', 1)) v(method, least_words)),
     gone_ AS (SELECT method, coalesce(list(term) FILTER (term IS NOT NULL), []) AS gone
       FROM least_ LEFT JOIN lk ON words >= least_words GROUP BY method),
     kept AS (SELECT method, list_filter(hits, lambda h: h.source = 'regex' OR NOT list_contains(gone, lower(h.term))) AS hits
       FROM fh CROSS JOIN gone_)
     SELECT method, count(*) FILTER (len(list_filter(hits, lambda h: NOT h.negated)) > 0) AS n_scored FROM kept GROUP BY method
     UNION ALL SELECT 'tfidf_logreg', count(*) FROM form_inst""",
)
def _(t: Tables):
    corpus = t.documents.select("text")
    parts = []
    rows = t.form_inst.withColumn("anomaly", F.lit(None).cast("string"))
    for name in ("rules_as_authored", "rules_phrase_deleaked", "rules_vocab_stripped", "tfidf_logreg"):
        m = build_method(name, SPEC, ruleset=demo.FORM_RULES, corpus=corpus, training=t.inst)
        parts.append(
            m.score(rows).agg(
                F.lit(m.name).alias("method"), F.count_if(F.col("score") > 0).alias("n_scored")
            )
        )
    return reduce(DataFrame.unionByName, parts)


@op(
    "Q10_display_order",
    f"""WITH {FORM_HITS}, o AS (SELECT record_id, pair_id, row_number() OVER (PARTITION BY record_id ORDER BY
      CASE test_id WHEN 'market' THEN 1 WHEN 'fulfilment' THEN 2 ELSE 3 END, score DESC, pair_id) AS place
      FROM form_scored) SELECT record_id, pair_id, place FROM o""",
)
def _(t: Tables):
    return review.display_order(_banded(t), CFG.test_order).select("record_id", "pair_id", "place")


@op(
    "Q11_stored_decisions",
    f"""WITH {DECISIONS} SELECT decision_id, CASE WHEN reason IS NOT NULL THEN substr(sha256(reason), 1, 12) END AS hash,
     CASE WHEN reason IS NULL THEN 0 ELSE length(reason) END AS chars, false AS reason_logged FROM decisions""",
)
def _(t: Tables):
    return review.stored_decisions(t.decisions).select(
        "decision_id", F.col("reason_digest.sha256").alias("hash"),
        F.col("reason_digest.chars").alias("chars"), "reason_logged",
    )


_LATEST = """latest AS (SELECT record_id, pair_id, field_id, decision_id, decision FROM decisions
  QUALIFY row_number() OVER (PARTITION BY record_id, pair_id, field_id ORDER BY ts DESC, decision_id DESC) = 1)"""


@op(
    "Q12_latest_decisions",
    f"WITH {DECISIONS}, {_LATEST} SELECT record_id, pair_id, field_id, decision_id, decision FROM latest",
)
def _(t: Tables):
    return review.latest_decisions(t.decisions).select(
        "record_id", "pair_id", "field_id", "decision_id", "decision"
    )


@op(
    "Q12_flags_with_decisions",
    f"""WITH {DECISIONS}, {_LATEST}, f AS (SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR)) AS record_id, props AS pair_id,
      'text' AS field_id FROM events) SELECT f.record_id, f.pair_id, l.decision FROM f LEFT JOIN latest l
      ON l.record_id = f.record_id AND l.pair_id = f.pair_id""",
)
def _(t: Tables):
    flags = t.read("events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("record_id"),
        F.col("props").alias("pair_id"), F.lit("text").alias("field_id"),
    ).distinct()
    latest = review.latest_decisions(t.decisions)
    joined = review.with_decisions(flags, latest, ["record_id", "pair_id", "field_id"])
    return joined.select("record_id", "pair_id", "decision")


_RATES = """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, pair_id, count(*) AS n,
  count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'dismiss') AS dismissed,
  round(count(*) FILTER (decision = 'dismiss') / count(*), 6) AS dismiss_rate,
  count(*) FILTER (decision = 'dismiss') / count(*) > 0.8 AS alert FROM decisions GROUP BY 1, 2"""


def _day(df: DataFrame) -> DataFrame:
    return df.select(
        F.date_format("period_start", "yyyy-MM-dd").alias("day"), "pair_id", "n", "accepted",
        "dismissed", F.round("dismiss_rate", 6).alias("dismiss_rate"), "alert",
    )


@op("Q13_decision_rates", f"WITH {DECISIONS} {_RATES}")
def _(t: Tables):
    return _day(review.decision_rates(t.decisions))


@op(
    "Q14_sample_pool",
    f"""WITH {FORM} SELECT * FROM (SELECT record_id, true AS planted FROM form WHERE k % 37 = 0 ORDER BY record_id LIMIT 6)
     UNION ALL SELECT * FROM (SELECT record_id, false FROM form WHERE k % 37 <> 0 ORDER BY record_id LIMIT 6)""",
)
def _(t: Tables):
    pool = review.sample_pool(t.form, t.truth)
    return pool.select("record_id", (F.col("k") % 37 == 0).alias("planted"))


# --------------------------------------------------------------- R: profiling
_R1 = ("label", "archetype", "register", "contradiction_type", "subtlety", "test_id")


@op(
    "R1_distributions",
    f"WITH {FORM}, {FORM_INST}, {LABELLED}, x AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS level FROM labelled" for a in _R1
    )
    + """) SELECT attribute, level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY attribute), 6) AS share
      FROM x WHERE level IS NOT NULL GROUP BY attribute, level""",
)
def _(t: Tables):
    labelled = instances.build_labelled(t.form, t.truth, t.states, SPEC)
    df = profile.distributions(labelled, _R1)
    return df.withColumn("share", F.round("share", 6))


@op(
    "R2_share_matrix",
    f"""WITH {FORM} SELECT archetype, count(*) AS n, round(count(*) FILTER (k % 5 = 0) / count(*), 6) AS share_inside,
     round(count(*) FILTER (k % 5 > 1) / count(*), 6) AS share_outside,
     round(count(*) FILTER (k % 5 = 1) / count(*), 6) AS share_undetermined FROM form GROUP BY archetype""",
)
def _(t: Tables):
    levels = ("inside", "outside", "undetermined")
    df = profile.share_matrix(t.truth, "archetype", "outcome_label", levels)
    return df.select(
        "archetype", "n", *[F.round(f"share_{v}", 6).alias(f"share_{v}") for v in levels]
    )


@op(
    "R3_text_lengths",
    f"""WITH {FORM}, l AS (SELECT length(text) AS s, row_number() OVER (ORDER BY length(text)) - 1 AS i,
      count(*) OVER () AS n FROM form WHERE text <> '')
     SELECT CAST(floor(median(s)) AS BIGINT) AS median_chars, CAST(max(s) FILTER (i = floor(0.95 * n)) AS BIGINT) AS p95_chars,
      CAST(max(s) AS BIGINT) AS max_chars, count(*) AS n_texts FROM l""",
)
def _(t: Tables):
    return profile.text_lengths(t.form, SPEC)


_TARGETS = {"inside_rate": (0.15, 0.25), "planted_rate": (0.10, 0.20), "blank_rate": (0.0, 0.1)}


@op(
    "R4_acceptance",
    f"""WITH {FORM}, m AS (SELECT avg((k % 5 = 0)::INT) AS inside_rate, avg((k % 37 = 0)::INT) AS planted_rate,
      avg((text = '')::INT) AS blank_rate FROM form), x AS (
      SELECT 'inside_rate' AS measure, 0.15 AS low, 0.25 AS high, inside_rate AS actual FROM m
      UNION ALL SELECT 'planted_rate', 0.10, 0.20, planted_rate FROM m
      UNION ALL SELECT 'blank_rate', 0.0, 0.1, blank_rate FROM m)
     SELECT measure, low::DOUBLE AS low, high::DOUBLE AS high, round(actual, 6) AS actual,
      CASE WHEN actual BETWEEN low AND high THEN 'PASS' ELSE 'OUT OF RANGE' END AS verdict FROM x""",
)
def _(t: Tables):
    rate = lambda c: F.avg(c.cast("int"))
    truth = t.truth.join(t.form.select("record_id", "text"), "record_id")
    measures = truth.agg(
        rate(F.col("outcome_label") == "inside").alias("inside_rate"),
        rate(F.size("contradictions") > 0).alias("planted_rate"),
        rate(F.col("text") == "").alias("blank_rate"),
    )
    return profile.acceptance(measures, _TARGETS).withColumn("actual", F.round("actual", 6))


@op(
    "R5_coverage",
    f"""WITH {FORM} SELECT count(*) AS n_contradictions, count(*) FILTER (q1_status = 'O') AS n_undermining,
     count(DISTINCT 'p_status') AS pairs_hit, 3 AS n_pairs FROM form WHERE k % 37 = 0""",
)
def _(t: Tables):
    rows = instances.flatten_contradictions(t.truth)
    return profile.coverage(rows, len(SPEC.pairs), "undermines_outside_leaning")


@op(
    "R6_pipeline_check",
    f"""WITH {FORM}, {ROUTE}, {FINDINGS}, {ROLLUP} SELECT count(*) AS n_records, count(*) FILTER (is_valid) AS n_valid,
     round(avg(is_valid::INT), 6) AS valid_share, (SELECT count(*) FROM findings WHERE severity = 'warning') AS n_warnings,
     (SELECT 3 * count(*) FROM form WHERE text NOT IN ('', 'n/a')) AS n_entities,
     (SELECT count(*) FROM form WHERE text NOT IN ('', 'n/a')) AS records_with_entities FROM rollup_""",
)
def _(t: Tables):
    df = validate.validate(deid.deidentify(t.form, SPEC, demo.DEID), SPEC, demo.VALIDATION)
    return profile.pipeline_check(df).withColumn("valid_share", F.round("valid_share", 6))


# --------------------------------------------------------------- S: streaming
@op(
    "S1_streaming_assessment",
    f"WITH {_CLEAN_FORM_HITS}, {CROSS}, {_priority_sql()} SELECT record_id, n_items, priority FROM priority",
)
def _(t: Tables):
    src, out = scratch_dir(t.spark, "s1-in"), scratch_dir(t.spark, "s1-out")
    t.form.repartition(4).write.parquet(src)
    stream = (
        t.spark.readStream.schema(t.form.schema).option("maxFilesPerTrigger", 2).parquet(src)
    )
    query = streams.assess_stream(
        stream, _assess, out, scratch_dir(t.spark, "s1-cp"), tables=("priority",)
    )
    query.awaitTermination()
    return t.spark.read.parquet(f"{out}/priority").select("record_id", "n_items", "priority")


def _decision_stream(t: Tables, name: str) -> DataFrame:
    """Decisions as arriving files, with every delivery made twice."""
    src = scratch_dir(t.spark, name)
    once = t.decisions.select("decision_id", "record_id", "pair_id", "ts", "decision")
    once = once.withColumn("ts", F.col("ts").cast("timestamp"))
    once.unionByName(once).repartition(2).write.parquet(src)
    return t.spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(src)


@op(
    "S2_latest_decision_stream",
    f"WITH {DECISIONS}, {_LATEST} SELECT record_id, pair_id, decision_id, decision FROM latest",
)
def _(t: Tables):
    state = scratch_dir(t.spark, "s2-state")
    query = streams.latest_decision_stream(
        _decision_stream(t, "s2-in"), state, scratch_dir(t.spark, "s2-cp")
    )
    query.awaitTermination()
    return streams.read_latest(t.spark, state).select(
        "record_id", "pair_id", "decision_id", "decision"
    )


@op(
    "S3_rate_monitor",
    f"""WITH {DECISIONS}, r AS ({_RATES}) SELECT * FROM r
     WHERE CAST(day AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM decisions) - INTERVAL 1 HOUR""",
)
def _(t: Tables):
    src, out = scratch_dir(t.spark, "s3-in"), scratch_dir(t.spark, "s3-out")
    rows = t.decisions.select("decision_id", "pair_id", F.col("ts").cast("timestamp"), "decision")
    # decisions arrive as files of one period after another, and the watermark moves on with them
    first, last = rows.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    at, periods = F.unix_timestamp("ts"), 8
    edges = [first + (last + 1 - first) * k // periods for k in range(periods + 1)]
    for low, high in zip(edges, edges[1:]):
        rows.where((at >= low) & (at < high)).coalesce(1).write.mode("append").parquet(src)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = (
        streams.rate_stream(stream, delay="1 hour").writeStream.format("parquet")
        .outputMode("append").option("checkpointLocation", scratch_dir(t.spark, "s3-cp"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return _day(t.spark.read.parquet(out))
