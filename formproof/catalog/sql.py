"""SQL fragments shared by the counterparts of the queries."""

from __future__ import annotations

from . import demo


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


FORM = """form AS (
 SELECT concat('ORD-', CAST(o.o_orderkey AS VARCHAR)) AS record_id,
  o.o_orderkey AS k,
  CASE WHEN o.o_orderkey % 101 = 0 THEN 'X' ELSE o.o_orderstatus END AS q1_status,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderpriority END AS q2_priority,
  CASE WHEN o.o_orderkey % 23 = 0 THEN '' ELSE c.c_mktsegment END AS q3_segment,
  c.c_name AS i_name, n.n_name AS i_nation,
  CAST(CAST(floor(c.c_acctbal) AS BIGINT) AS VARCHAR) AS i_balance,
  CASE WHEN o.o_orderkey % 211 = 0 THEN 'approved' END AS x_outcome,
  CASE WHEN o.o_orderkey % 13 = 0 THEN '' WHEN o.o_orderkey % 29 = 0 THEN 'n/a'
   ELSE concat(b.text, ' Agreed with ', c.c_name, ' at £',
     CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR), ' per day; write to buyer',
     CAST(o.o_custkey AS VARCHAR), '@example.com.') END AS text,
  CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR) AS amount,
  o.o_custkey AS custkey,
  n.n_name AS archetype, c.c_mktsegment AS register, o.o_orderdate AS submitted_at
 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
 JOIN nation n ON n.n_nationkey = c.c_nationkey
 JOIN benchmark b ON b.item_id = o.o_orderkey % (SELECT count(*) FROM benchmark))"""

LONG = """long AS (
 SELECT record_id, k, field_id, value FROM (
  SELECT record_id, k, 'q1_status' AS field_id, q1_status AS value FROM form
  UNION ALL SELECT record_id, k, 'q2_priority', q2_priority FROM form
  UNION ALL SELECT record_id, k, 'q3_segment', q3_segment FROM form
  UNION ALL SELECT record_id, k, 'text', text FROM form)
 WHERE value IS NOT NULL AND value <> '')"""

# the route of a record: q1 -> (q3 if final, else q2 -> q3)
ROUTE = """routed AS (
 SELECT *, CASE WHEN q1_status = 'F' THEN ['q1_status', 'q3_segment']
  ELSE ['q1_status', 'q2_priority', 'q3_segment'] END AS route FROM form)"""

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"

FINDINGS = f"""findings AS (
 SELECT record_id, 'value_not_in_domain' AS code, 'q1_status' AS field_id, 'error' AS severity,
  '4.1: ''' || q1_status || ''' is not among the 3 values allowed here.' AS message
 FROM routed WHERE q1_status NOT IN ('O','F','P')
 UNION ALL SELECT record_id, 'answered_off_route', 'q2_priority', 'warning',
  '4.2 holds an answer although earlier ones lead past it.'
 FROM routed WHERE q2_priority IS NOT NULL AND NOT list_contains(route, 'q2_priority')
 UNION ALL SELECT record_id, 'missing_on_route', 'q2_priority', 'warning',
  '4.2 is due on this route and is empty.'
 FROM routed WHERE q2_priority IS NULL AND list_contains(route, 'q2_priority')
 UNION ALL SELECT record_id, 'missing_on_route', 'q3_segment', 'warning',
  '4.3 is due on this route and is empty.'
 FROM routed WHERE q3_segment = ''
 UNION ALL SELECT record_id, 'missing_justification', 'text', 'warning',
  '4.1 has an answer and no explanation.'
 FROM routed WHERE text = ''
 UNION ALL SELECT record_id, 'justification_too_short', 'text', 'warning',
  '4.1: an explanation of ' || length(trim(text, {WS})) ||
  ' characters; 15 are needed.'
 FROM routed WHERE text <> '' AND length(trim(text, {WS})) < 15
 UNION ALL SELECT record_id, 'outcome_leakage', 'x_outcome', 'error',
  'x_outcome gives the outcome away; drop it before scoring.'
 FROM routed WHERE x_outcome IS NOT NULL)"""

ROLLUP = """rollup_ AS (
 SELECT f.record_id, count(g.code) AS n_findings,
  count(*) FILTER (g.severity = 'error') = 0 AS is_valid,
  coalesce(array_to_string(list_sort(list_distinct(list(g.code) FILTER (g.code IS NOT NULL))), ','), '')
   AS codes
 FROM form f LEFT JOIN findings g ON g.record_id = f.record_id GROUP BY f.record_id)"""

CROSS = """cross_ AS (
 SELECT record_id, 'x_final_but_text' AS check_id,
  'status is final but an outcome or a text is present' AS description, 'medium' AS severity,
  'q1_status,x_outcome,text' AS fields
 FROM form WHERE q1_status = 'F' AND (coalesce(trim(x_outcome), '') <> '' OR trim(text) <> '')
 UNION ALL SELECT record_id, 'x_urgent_machinery', 'urgent handling for machinery', 'high',
  'q2_priority,q3_segment'
 FROM form WHERE q2_priority IN ('1-URGENT', '2-HIGH') AND q3_segment = 'MACHINERY')"""

FORM_INST = """form_inst AS (
 SELECT record_id, k, 0 AS pair_ord, 'p_status' AS pair_id, 'q1_status' AS structured_field,
  'fulfilment' AS test_id, q1_status AS structured_value, text AS free_text,
  q1_status = 'O' AS is_outside_leaning, archetype, register FROM form
 UNION ALL SELECT record_id, k, 1, 'p_priority', 'q2_priority', 'urgency', q2_priority, text,
  q2_priority = '1-URGENT', archetype, register FROM form WHERE q2_priority IS NOT NULL
 UNION ALL SELECT record_id, k, 2, 'p_segment', 'q3_segment', 'market', q3_segment, text,
  q3_segment = 'BUILDING', archetype, register FROM form WHERE q3_segment <> '')"""

LABELLED = """labelled AS (
 SELECT i.*,
  CASE WHEN pair_id = 'p_status' AND k % 37 = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN pair_id = 'p_status' AND k % 37 = 0
   THEN 'type' || CAST(k % 3 AS VARCHAR) END AS contradiction_type,
  CASE WHEN pair_id = 'p_status' AND k % 37 = 0 THEN k % 3 + 1 END AS subtlety,
  CASE WHEN pair_id = 'p_status' THEN md5(free_text) ELSE '' END AS unit_key,
  CASE WHEN k % 13 = 0 THEN 'blank' WHEN k % 29 = 0 THEN 'non_responsive' END AS anomaly,
  CASE WHEN k % 5 = 0 THEN 'inside' WHEN k % 5 = 1 THEN 'undetermined' ELSE 'outside' END
   AS outcome_label
 FROM form_inst i)"""

INST = """inst AS (
 SELECT concat('rec-', CAST(d.doc_id // 8 AS VARCHAR)) AS record_id, concat('p-', CAST(d.doc_id % 8 AS VARCHAR)) AS pair_id,
  d.doc_id, d.lang AS test_id,
  CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS structured_value,
  l.quality = 1 AS is_outside_leaning, d.text AS free_text, l.toxic AS label,
  CASE WHEN l.toxic = 1 THEN concat('type', CAST(d.doc_id % 3 AS VARCHAR)) END
   AS contradiction_type,
  CASE WHEN l.toxic = 1 THEN d.doc_id % 3 + 1 END AS subtlety,
  md5(d.text) AS unit_key, d.lang AS archetype,
  CASE WHEN d.n_chars < 1000 THEN 'short' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'long' END
   AS register
 FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

TOKEN = r"[a-z0-9£\[\]''-]+"


def last4(text: str, term: str) -> str:
    return (
        f"regexp_extract_all(substr({text}, 1, instr({text}, {term}) - 1), '{TOKEN}')[-4:]"
    )


def negated(text: str, term: str, markers) -> str:
    return (
        f"len(list_filter({last4(text, term)}, lambda tk: list_contains({lst(markers)}, tk) "
        f"OR suffix(tk, 'n''t'))) > 0"
    )


def weigh(hits: str, boost: str = "0") -> str:
    """Sum of hit weights, left to right."""
    w = (
        "CASE WHEN h.negated THEN -1.4::DOUBLE WHEN h.source = 'pair_cue' THEN 1.3::DOUBLE "
        "WHEN h.source = 'family_lexicon' THEN 0.95::DOUBLE ELSE 1.1::DOUBLE END"
    )
    total = (
        f"list_reduce(list_concat([0.0::DOUBLE], list_transform({hits}, lambda h: {w})), "
        "lambda a, b: a + b)"
    )
    return f"{total} + {boost}" if boost != "0" else total


def squash(raw: str, hits: str) -> str:
    return (
        f"CASE WHEN len(list_filter({hits}, lambda h: NOT h.negated)) = 0 THEN 0.0::DOUBLE "
        f"ELSE least(0.99::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({raw} - 1.55::DOUBLE)))) END"
    )


INSULT_HITS = (
    f"list_transform(list_filter({lst(demo.INSULTS)}, lambda t: contains(lt, t)), "
    "lambda t: {'source': 'family_lexicon', 'term': t, "
    f"'negated': {negated('lt', 't', demo.INSULT_RULES.neg_markers)}, "
    "'detail': 'insult'})"
)

SCORED = f"""{INST},
 hit_ AS (SELECT *, {INSULT_HITS} AS hits FROM (SELECT *, lower(free_text) AS lt FROM inst)),
 raw_ AS (SELECT *, {weigh('hits')} AS raw FROM hit_),
 scored AS (SELECT *, {squash('raw', 'hits')} AS score FROM raw_)"""


def _form_hits() -> str:
    cues = " ".join(
        f"WHEN pair_id = {q(p.id)} THEN {lst(p.cues)}" for p in demo.FORM.pairs
    )
    cue = (
        "CASE WHEN is_outside_leaning THEN list_transform(list_filter("
        f"CASE {cues} END, lambda t: contains(lt, t)), lambda t: "
        "{'source': 'pair_cue', 'term': t, 'negated': "
        + negated("lt", "t", demo.FORM_RULES.neg_markers)
        + ", 'detail': ''}) ELSE [] END"
    )
    fams = []
    for name, fam in demo.FORM_RULES.families.items():
        gate = f"test_id IN ({', '.join(q(t) for t in fam['applies_to_tests'])})"
        if fam["contradicts_polarity"] == "outside":
            gate += " AND is_outside_leaning"
        fams.append(
            f"CASE WHEN {gate} THEN list_transform(list_filter({lst(fam['terms'])}, "
            "lambda t: contains(lt, lower(t))), lambda t: {'source': 'family_lexicon', "
            "'term': t, 'negated': "
            + negated("lt", "lower(t)", demo.FORM_RULES.neg_markers)
            + f", 'detail': {q(name)}}}) ELSE [] END"
        )
    rx = []
    for e in demo.FORM_RULES.regexes:
        gate = f"pair_id IN ({', '.join(q(p) for p in e['applies_to_pairs'])})"
        if e.get("only_when_answer_contains"):
            gate += f" AND contains(lower(structured_value), {q(e['only_when_answer_contains'])})"
        rx.append(
            f"CASE WHEN {gate} AND regexp_matches(free_text, {q('(?i)' + e['pattern'])}) THEN "
            f"[{{'source': 'regex', 'term': {q(e['id'])}, 'negated': false, "
            f"'detail': {q(e['explanation'])}}}] ELSE [] END"
        )
    return "list_concat(" + ", ".join([cue, *fams, *rx]) + ")"


FORM_HITS = f"""{FORM}, {FORM_INST},
 fh AS (SELECT *, CASE WHEN trim(free_text) = '' THEN [] ELSE {_form_hits()} END AS hits
  FROM (SELECT *, lower(free_text) AS lt FROM form_inst)),
 fr AS (SELECT *, CASE WHEN pair_id = 'p_status' THEN {weigh('hits', '0.45::DOUBLE')}
   ELSE {weigh('hits')} END AS raw FROM fh),
 form_scored AS (SELECT *, {squash('raw', 'hits')} AS score FROM fr)"""

DECISIONS = """decisions AS (
 SELECT event_id AS decision_id, concat('u', CAST(user_id AS VARCHAR)) AS record_id,
  props AS pair_id, 'text' AS field_id, ts,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'accept' ELSE 'dismiss' END AS decision,
  CASE WHEN value >= 10 THEN concat('seen ', props) END AS reason, value
 FROM events)"""

TURNS = """turns AS (
 SELECT * FROM (SELECT conv_id, turn, role, text AS premise,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hypothesis FROM conversations) t
 WHERE hypothesis IS NOT NULL)"""
