"""Queries of families A-D and F: sources, reshaping, validation, instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossfield, form, instances, validate
from ..functions import text as tx
from ..session import scratch_dir
from ..sources import io
from . import demo
from .base import Tables, op
from .sql import CROSS, DECISIONS, FINDINGS, FORM, FORM_INST, LABELLED, LONG, ROLLUP, ROUTE, WS, q

SPEC = demo.FORM
_FIELDS = [f.id for f in SPEC.fields]


def _contract_columns(t: Tables):
    return t.form.select("record_id", "archetype", "register", *_FIELDS)


# ---------------------------------------------------------------- A: sources
@op("A1_read_jsonl", f"WITH {FORM} SELECT record_id, q1_status, q2_priority, q3_segment, text FROM form")
def _(t: Tables):
    path = scratch_dir(t.spark, "a1")
    io.write_jsonl(_contract_columns(t), path)
    df = io.read_jsonl(t.spark, path, io.record_schema(SPEC))
    return df.select("record_id", "q1_status", "q2_priority", "q3_segment", "text")


@op(
    "A2_alignment",
    f"""WITH {FORM} SELECT record_id, 1 AS n_records,
     CASE WHEN k % 1000 = 3 THEN 0 ELSE 1 END AS n_truth,
     CASE WHEN k % 700 = 5 THEN 2 ELSE 1 END AS n_states
     FROM form WHERE k % 1000 = 3 OR k % 700 = 5""",
)
def _(t: Tables):
    # truth loses some records and states repeats some, to have misalignments
    truth = t.form.where("k % 1000 <> 3").select("record_id")
    states = t.form.select(
        "record_id", F.explode(F.sequence(F.lit(1), F.when(F.expr("k % 700 = 5"), 2).otherwise(1)))
    )
    return io.misaligned(t.form, truth, states)


@op(
    "A3_write_jsonl",
    f"""WITH {FORM} SELECT record_id, coalesce(q2_priority, '(absent)') AS q2_priority,
     length(text) AS text_chars, true AS keys_sorted FROM form""",
)
def _(t: Tables):
    path = scratch_dir(t.spark, "a3")
    io.write_jsonl(_contract_columns(t), path)
    lines = t.spark.read.text(path)
    keys = F.json_object_keys("value")
    return lines.select(
        F.get_json_object("value", "$.record_id").alias("record_id"),
        F.coalesce(F.get_json_object("value", "$.q2_priority"), F.lit("(absent)"))
        .alias("q2_priority"),
        F.length(F.get_json_object("value", "$.text")).alias("text_chars"),
        (F.sort_array(keys) == keys).alias("keys_sorted"),
    )


@op(
    "A4_dimensions",
    f"""WITH {FORM}, {LONG} SELECT field_id, type, form_ref, n_options, n_answers FROM (
      SELECT field_id, count(*) AS n_answers FROM long GROUP BY field_id)
     JOIN (VALUES ('q1_status','structured','4.1',3), ('q2_priority','structured','4.2',5),
      ('q3_segment','structured','4.3',5), ('text','free_text','4.1r',0))
      v(field_id, type, form_ref, n_options) USING (field_id)""",
)
def _(t: Tables):
    answers = form.to_long(t.form, [*[f.id for f in SPEC.answer_fields], "text"])
    counts = answers.groupBy("field_id").agg(F.count(F.lit(1)).alias("n_answers"))
    dim = SPEC.fields_dim(t.spark).select(
        "field_id", "type", "form_ref", F.size("value_domain").alias("n_options")
    )
    return counts.join(F.broadcast(dim), "field_id")


_DECISION_LOG = """SELECT CAST(decision_id AS VARCHAR) AS decision_id, record_id, pair_id, decision,
 CASE WHEN reason IS NOT NULL THEN substr(sha256(reason), 1, 12) END AS reason_hash,
 CASE WHEN reason IS NULL THEN 0 ELSE length(reason) END AS reason_chars FROM decisions"""


@op("A5_decision_log", f"WITH {DECISIONS} {_DECISION_LOG}")
def _(t: Tables):
    from ..operators.review import stored_decisions

    path = scratch_dir(t.spark, "a5")
    log = stored_decisions(
        t.decisions.withColumn("timestamp_utc", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    ).drop("ts")
    io.append_decisions(log.where(F.col("decision") == "accept"), path)
    io.append_decisions(log.where(F.col("decision") == "dismiss"), path)
    return io.load_decisions(t.spark, path).select(
        F.col("decision_id").cast("string"), "record_id", "pair_id", "decision",
        F.col("reason_digest.sha256").alias("reason_hash"),
        F.col("reason_digest.chars").alias("reason_chars"),
    )


@op(
    "A6_ingest_submissions",
    f"""WITH {FORM} SELECT
      CASE WHEN k % 50 IN (1, 2) THEN NULL WHEN k % 50 = 3 THEN 'made' ELSE record_id END AS record_id,
      CASE WHEN k % 50 IN (1, 2) THEN NULL ELSE q1_status END AS q1_status,
      k % 50 IN (1, 2) AS is_rejected FROM form""",
)
def _(t: Tables):
    # some lines are cut off, some are arrays, some lack an id
    whole = F.to_json(F.struct("record_id", "q1_status", "text"))
    anonymous = F.to_json(F.struct("q1_status", "text"))
    kind = F.col("k") % 50
    line = (
        F.when(kind == 1, F.substring(whole, 1, 20))
        .when(kind == 2, F.concat(F.lit("["), whole, F.lit("]")))
        .when(kind == 3, anonymous).otherwise(whole)
    )
    parsed = io.parse_submissions(t.form.select(line.alias("value")), SPEC)
    whole_digest = F.concat(F.lit("UPLOAD-"), F.sha2("raw", 256))
    made = F.when(F.col("record_id") == whole_digest, "made").otherwise(F.col("record_id"))
    return parsed.select(
        F.when(~F.col("is_rejected"), made).alias("record_id"),
        F.when(~F.col("is_rejected"), F.col("q1_status")).alias("q1_status"),
        "is_rejected",
    )


@op(
    "A7_export_document",
    f"""WITH {FORM}, c AS (SELECT q1_status, count(*) AS n FROM form GROUP BY q1_status)
     SELECT concat('{{"n_records":', sum(n), ',"by_status":[',
      string_agg(concat('{{"status":"', q1_status, '","n":', n, '}}'), ',' ORDER BY q1_status),
      ']}}') AS value FROM c""",
)
def _(t: Tables):
    counts = t.form.groupBy("q1_status").agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(
        F.sum("n").alias("n_records"),
        F.sort_array(F.collect_list(F.struct(F.col("q1_status").alias("status"), "n")))
        .alias("by_status"),
    )
    path = scratch_dir(t.spark, "a7")
    io.export_document(row, path)
    return t.spark.read.text(path)


@op(
    "A8_first_submissions",
    f"""WITH {FORM}, {FORM_INST}, h AS (SELECT record_id FROM form ORDER BY record_id LIMIT 40)
     SELECT i.record_id, i.pair_id, i.structured_value FROM form_inst i SEMI JOIN h USING (record_id)""",
)
def _(t: Tables):
    _, rows = io.first_submissions(t.form, 40, t.form_inst)
    return rows.select("record_id", "pair_id", "structured_value")


# ------------------------------------------------- B: projections, predicates
@op("B1_drop_outcomes", f"WITH {FORM} SELECT record_id, q1_status, text, i_name FROM form")
def _(t: Tables):
    kept = form.drop_outcomes(_contract_columns(t), SPEC)
    if "x_outcome" in kept.columns:
        raise AssertionError("outcome column survived")
    return kept.select("record_id", "q1_status", "text", "i_name")


@op("B2_select_by_metadata", f"WITH {FORM} SELECT record_id, q1_status, text FROM form")
def _(t: Tables):
    return form.select_fields(t.form, SPEC, test="fulfilment")


@op("B3_wide_to_long", f"WITH {FORM}, {LONG} SELECT record_id, field_id, value FROM long")
def _(t: Tables):
    return form.to_long(t.form, ["q1_status", "q2_priority", "q3_segment", "text"])


@op(
    "B4_blank",
    f"""WITH {FORM} SELECT record_id, q2_priority IS NULL OR q2_priority = '' AS p_blank,
     q3_segment IS NULL OR q3_segment = '' AS s_blank FROM form""",
)
def _(t: Tables):
    return t.form.select(
        "record_id", tx.is_blank(F.col("q2_priority")).alias("p_blank"),
        tx.is_blank(F.col("q3_segment")).alias("s_blank"),
    )


@op(
    "B5_usable_text",
    f"SELECT doc_id, length(trim(text, {WS})) >= 400 AS usable FROM documents",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.usable(F.col("text"), 400).alias("usable"))


@op(
    "B6_polarity",
    f"WITH {FORM}, {FORM_INST} SELECT record_id, pair_id, is_outside_leaning FROM form_inst",
)
def _(t: Tables):
    return t.form_inst.select("record_id", "pair_id", "is_outside_leaning")


@op(
    "B7_normalise_values",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
     CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price, trim(concat('  ', o_orderstatus, ' ')) AS st
     FROM orders""",
)
def _(t: Tables):
    raw = t.read("orders").select(
        "o_orderkey", "o_orderdate", F.floor("o_totalprice").cast("double").alias("price"),
        F.concat(F.lit(" \t"), "o_orderstatus", F.lit(" \n")).alias("st"),
    )
    return tx.normalise_frame(raw)


@op(
    "B8_premise",
    f"""WITH {FORM} SELECT record_id,
     'In answer to ''What is the status of the order?'', the manager stated: ' || q1_status AS premise
     FROM form""",
)
def _(t: Tables):
    label = F.lit(SPEC.by_id["q1_status"].label)
    return t.form.select(
        "record_id", tx.premise(demo.PREMISE, label, F.col("q1_status")).alias("premise")
    )


@op(
    "B9_collapse_blanks",
    r"SELECT doc_id, trim(regexp_replace(text, '[\t\n\v\f\r ]+', ' ', 'g')) AS text FROM documents",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.collapse(F.col("text")).alias("text"))


@op(
    "B10_truncate",
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS cut FROM documents",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.truncate(F.col("text"), 500).alias("cut"))


# ------------------------------------------------------------- C: validation
def _validated(t: Tables):
    return validate.validate(t.form, SPEC, demo.VALIDATION)


def _code(code: str) -> str:
    return (
        f"WITH {FORM}, {ROUTE}, {FINDINGS} SELECT record_id, code, field_id, severity, message "
        f"FROM findings WHERE code = {q(code)}"
    )


def _one_check(column):
    def build(t: Tables):
        df = t.form.withColumn("route", validate.route(t.form, SPEC, "4."))
        return df.select("record_id", F.inline(column(df)))

    return build


op("C1_value_domain", _code("value_not_in_domain"))(
    _one_check(lambda df: validate.domain_findings(df, SPEC))
)
op("C8_outcome_leakage", _code("outcome_leakage"))(
    _one_check(lambda df: validate.outcome_findings(df, SPEC))
)


@op(
    "C2_route_walk",
    f"""WITH RECURSIVE {FORM},
     edge AS (SELECT * FROM (VALUES (0, 'q1_status', 1), (1, 'q2_priority', 2), (2, 'q3_segment', NULL)) v(i, f, nxt)),
     walk(record_id, q1_status, i, path) AS (
      SELECT record_id, q1_status, 0, ['q1_status'] FROM form
      UNION ALL
      SELECT w.record_id, w.q1_status, n.i, list_append(w.path, n.f) FROM walk w
      JOIN edge e ON e.i = w.i
      JOIN edge n ON n.i = CASE WHEN w.i = 0 AND w.q1_status = 'F' THEN 2 ELSE e.nxt END)
     SELECT record_id, array_to_string(arg_max(path, len(path)), '>') AS route
     FROM walk GROUP BY record_id""",
)
def _(t: Tables):
    route = validate.route(t.form, SPEC, "4.")
    return t.form.select("record_id", F.array_join(route, ">").alias("route"))


@op(
    "C3_one_hop",
    f"WITH {FORM} SELECT record_id, 'q1_status,q2_priority,q3_segment' AS reachable FROM form",
)
def _(t: Tables):
    reach = validate.one_hop_reachable(t.form, SPEC)
    return t.form.select("record_id", F.array_join(reach, ",").alias("reachable"))


for _id, _name in (("C4", "answered_off_route"), ("C5", "missing_on_route")):
    op(f"{_id}_{_name}", _code(_name))(
        lambda t, n=_name: _one_check(
            lambda df: validate.routing_findings(df, SPEC, "4.", F.col("route"))
        )(t).where(F.col("code") == n)
    )
for _id, _name in (("C6", "missing_justification"), ("C7", "justification_too_short")):
    op(f"{_id}_{_name}", _code(_name))(
        lambda t, n=_name: _one_check(
            lambda df: validate.justification_findings(df, SPEC, 15, F.col("route"))
        )(t).where(F.col("code") == n)
    )


@op(
    "C9_all_findings",
    f"WITH {FORM}, {ROUTE}, {FINDINGS} SELECT record_id, code, field_id, severity, message FROM findings",
)
def _(t: Tables):
    return validate.findings_table(_validated(t))


@op(
    "C10_record_rollup",
    f"WITH {FORM}, {ROUTE}, {FINDINGS}, {ROLLUP} SELECT record_id, n_findings, is_valid, codes FROM rollup_",
)
def _(t: Tables):
    return _validated(t).select(
        "record_id", "n_findings", "is_valid", F.array_join("codes", ",").alias("codes")
    )


@op(
    "C11_finding_histogram",
    f"WITH {FORM}, {ROUTE}, {FINDINGS} SELECT code, count(*) AS n FROM findings WHERE severity = 'warning' GROUP BY code",
)
def _(t: Tables):
    return validate.finding_histogram(_validated(t), "warning")


@op(
    "C12_quarantine",
    f"WITH {FORM}, {ROUTE}, {FINDINGS}, {ROLLUP} SELECT record_id, codes FROM rollup_ WHERE NOT is_valid",
)
def _(t: Tables):
    _, held = validate.split_valid(_validated(t))
    return held.select("record_id", F.array_join("codes", ",").alias("codes"))


# ------------------------------------------------------- D: cross-field rules
def _clause_query(name: str, spec: dict, sql: str) -> None:
    @op(name, f"WITH {FORM} SELECT record_id, {sql} AS holds FROM form")
    def _(t: Tables):
        return t.form.select(
            "record_id", crossfield.clause(set(t.form.columns), spec).alias("holds")
        )


_clause_query("D1_clause_eq", {"field": "q2_priority", "eq": "5-LOW"},
              "coalesce(q2_priority = '5-LOW', false)")
_clause_query("D2_clause_in", {"field": "q2_priority", "in": ["1-URGENT", "2-HIGH"]},
              "coalesce(q2_priority IN ('1-URGENT', '2-HIGH'), false)")
_clause_query("D3_clause_any_not_empty", {"any_not_empty": ["x_outcome", "q3_segment"]},
              "coalesce(trim(x_outcome), '') <> '' OR coalesce(trim(q3_segment), '') <> ''")


@op(
    "D4_cross_field_findings",
    f"WITH {FORM}, {CROSS} SELECT record_id, check_id, description, severity, fields FROM cross_",
)
def _(t: Tables):
    rows = crossfield.cross_field_table(t.form, SPEC.cross_field_checks)
    return rows.withColumn("fields", F.array_join("fields", ","))


@op(
    "D5_unconditioned_checks",
    f"""WITH {FORM}, {CROSS} SELECT count(*) AS n_fired, count(DISTINCT check_id) AS n_checks,
     count(*) FILTER (check_id = 'x_documented_gap') AS n_gap FROM cross_""",
)
def _(t: Tables):
    rows = crossfield.cross_field_table(t.form, SPEC.cross_field_checks)
    return rows.agg(
        F.count(F.lit(1)).alias("n_fired"), F.countDistinct("check_id").alias("n_checks"),
        F.count_if(F.col("check_id") == "x_documented_gap").alias("n_gap"),
    )


@op(
    "D6_consistency_repair",
    f"""WITH {FORM}, a AS (SELECT *, CASE WHEN q1_status = 'P' THEN '5-LOW' ELSE q2_priority END AS p2 FROM form),
     b AS (SELECT *, CASE WHEN p2 = '5-LOW' AND q3_segment = 'BUILDING' THEN 'HOUSEHOLD' ELSE q3_segment END AS s2 FROM a)
     SELECT record_id, p2 AS q2_priority, s2 AS q3_segment,
      (CASE WHEN p2 IS DISTINCT FROM q2_priority THEN 1 ELSE 0 END
       + CASE WHEN s2 IS DISTINCT FROM q3_segment THEN 1 ELSE 0 END) AS n_repairs FROM b""",
)
def _(t: Tables):
    fixed = crossfield.apply_consistency(t.form, demo.CONSISTENCY_RULES)
    return fixed.select(
        "record_id", "q2_priority", "q3_segment", F.size("repairs").alias("n_repairs")
    )


# ---------------------------------------------------------------- F: instances
_F_COLUMNS = (
    "record_id, pair_id, structured_field, test_id, structured_value, free_text, "
    "is_outside_leaning, label, contradiction_type, subtlety, unit_key, anomaly, archetype, "
    "register, outcome_label"
)


def _labelled(t: Tables):
    return instances.build_labelled(t.form, t.truth, t.states, SPEC)


@op("F1_labelled_instances", f"WITH {FORM}, {FORM_INST}, {LABELLED} SELECT {_F_COLUMNS} FROM labelled")
def _(t: Tables):
    return _labelled(t).select(*_F_COLUMNS.split(", "))


@op(
    "F2_unlabelled_instances",
    f"""WITH {FORM}, {FORM_INST} SELECT record_id, pair_id, structured_field, test_id,
     structured_value, free_text, is_outside_leaning, 0 AS label, '' AS unit_key,
     'unknown' AS outcome_label, archetype, register FROM form_inst""",
)
def _(t: Tables):
    return t.form_inst.select(
        "record_id", "pair_id", "structured_field", "test_id", "structured_value", "free_text",
        "is_outside_leaning", "label", "unit_key", "outcome_label", "archetype", "register",
    )


@op(
    "F3_instance_summary",
    f"""WITH {FORM}, {FORM_INST}, {LABELLED} SELECT count(*) AS n_instances,
     count(DISTINCT record_id) AS n_records, count(DISTINCT pair_id) AS n_pairs,
     CAST(sum(label) AS BIGINT) AS n_positive, round(sum(label) / count(*), 5) AS positive_rate,
     round(count(*) / count(DISTINCT record_id), 1) AS instances_per_record,
     count(anomaly) AS n_anomalous, count(*) FILTER (length(trim(free_text)) < 15) AS n_unusable_text,
     count(DISTINCT CASE WHEN unit_key <> '' THEN unit_key END) AS n_distinct_units FROM labelled""",
)
def _(t: Tables):
    return instances.instance_summary(_labelled(t))


@op(
    "F3_positives_by_type",
    f"""WITH {FORM}, {FORM_INST}, {LABELLED} SELECT contradiction_type AS level, count(*) AS n
     FROM labelled WHERE label = 1 GROUP BY 1""",
)
def _(t: Tables):
    return instances.positives_by(_labelled(t), "contradiction_type")


@op(
    "F4_flatten_truth",
    f"""WITH {FORM} SELECT record_id, 'contradiction' AS what, 'p_status' AS item,
      'type' || CAST(k % 3 AS VARCHAR) AS kind FROM form WHERE k % 37 = 0
     UNION ALL SELECT record_id, 'anomaly', 'text',
      CASE WHEN k % 13 = 0 THEN 'blank' ELSE 'non_responsive' END
     FROM form WHERE k % 13 = 0 OR k % 29 = 0""",
)
def _(t: Tables):
    a = instances.flatten_contradictions(t.truth).select(
        "record_id", F.lit("contradiction").alias("what"), F.col("pair_id").alias("item"),
        F.col("contradiction_type").alias("kind"),
    )
    b = instances.flatten_anomalies(t.truth).select(
        "record_id", F.lit("anomaly").alias("what"), F.col("field_id").alias("item"), "kind"
    )
    return a.unionByName(b)
