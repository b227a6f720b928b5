from __future__ import annotations

import itertools
import json

import duckdb
import pytest
from check import compare
from pyspark.sql import functions as F

from formproof.catalog import ORACLES, QUERIES
from formproof.config import FieldSpec, FormSpec, PairSpec, ValidationPolicy, flatten_cues
from formproof.functions import text as tx
from formproof.operators import crossfield, form, instances, validate
from formproof.sources import io

YN = ("Yes", "No")


def question(name, ref, routing=None, domain=YN):
    return FieldSpec(name, "structured", ref, value_domain=domain, routing=routing or {})


# branches forward, and a back edge from q7 to q6
GRAPH = FormSpec(
    fields=(
        question("q0", "3.9"),
        question("q3", "4.3", {"A": "q5", "B": "q4"}, ("A", "B", "C")),
        question("q4", "4.4", {"Yes": "q8"}),
        question("q5", "4.5", {"Yes": "q6", "No": "q7"}),
        question("q6", "4.6", {"Yes": "q8"}),
        question("q7", "4.7", {"Yes": "q8", "No": "q6"}),
        question("q8", "4.8", {"Yes": "q0"}),
    )
)


def walk(answers):
    order = ["q3", "q4", "q5", "q6", "q7", "q8"]
    seen, at = [], 0
    while at < len(order):
        seen.append(order[at])
        target = GRAPH.by_id[order[at]].routing.get(answers.get(order[at]))
        at = order.index(target) if target in order else at + 1
        while at < len(order) and order[at] in seen:
            at += 1
    return seen


def test_route_equals_a_hand_walk_on_every_answer_combination(spark):
    names = ["q3", "q4", "q5", "q6", "q7", "q8"]
    combos = list(itertools.product(["A", "B", "C", None], *[[*YN, None]] * 5))
    rows = [(i, *c) for i, c in enumerate(combos)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    got = dict(df.select("i", validate.route(df, GRAPH, "4.")).collect())
    for i, c in enumerate(combos):
        assert got[i] == walk({n: v for n, v in zip(names, c) if v}), c


SPEC = FormSpec(
    fields=(
        question("reject", "4.1"),
        FieldSpec("why", "free_text", "4.1r", justification_for="reject"),
        FieldSpec("outcome", "metadata", role="outcome"),
    )
)


@pytest.mark.parametrize("record,codes,valid", [
    ({"reject": "Maybe", "why": "a long enough reason"}, ["value_not_in_domain"], False),
    ({"reject": "Yes", "why": ""}, ["missing_justification"], True),
    ({"reject": "Yes", "why": "n/a"}, ["justification_too_short"], True),
    ({"reject": "Yes", "why": "   short one \t\n"}, ["justification_too_short"], True),
    ({"reject": "Yes", "why": "a long enough reason", "outcome": "in"}, ["outcome_leakage"], False),
    ({"reject": "Yes", "why": "a long enough reason"}, [], True),
    ({}, ["missing_on_route"], True),
])
def test_validation_cases(spark, record, codes, valid):
    row = ("r", record.get("reject"), record.get("why"), record.get("outcome"))
    df = spark.createDataFrame([row], "record_id string, reject string, why string, outcome string")
    got = validate.validate(df, SPEC, ValidationPolicy()).first()
    assert (got.codes, got.is_valid) == (codes, valid)


def test_require_valid_raises(spark):
    df = spark.createDataFrame([("r", "Maybe", "x")], "record_id string, reject string, why string")
    with pytest.raises(ValueError, match="value_not_in_domain"):
        validate.require_valid(validate.validate(df, SPEC))


def test_cross_field_clauses():
    with pytest.raises(ValueError):
        crossfield.clause({"a"}, {"field": "a", "like": "x"})


def test_strip_and_blank_follow_python(spark):
    values = ["", " ", "\t x  ", " y\x1f", None, "a b"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(tx.strip(F.col("v")), tx.is_blank(F.col("v"))).collect()
    for v, (s, b) in zip(values, got):
        assert s == (v.strip() if v is not None else None)
        assert b == (v in (None, ""))


def test_digest_and_truncation(spark):
    df = spark.createDataFrame([(None,), ("",), ("abc",)], "v string")
    got = [r.d for r in df.select(tx.digest(F.col("v")).alias("d")).collect()]
    assert [tuple(g) for g in got[:2]] == [(None, 0), (None, 0)] and got[2].chars == 3
    cut = df.select(tx.truncate(F.col("v"), 2).alias("c")).collect()
    assert [r.c for r in cut] == ["", "", "ab…"]


def test_content_policy_equals_its_sql_on_empty_and_missing_texts(spark, tmp_path):
    texts = [None, "", " ", "a" * 80, "b" * 81, "é" * 81]
    documents = spark.createDataFrame([(k, v, "en") for k, v in enumerate(texts)], "doc_id long, text string, lang string")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, con, QUERIES["E24_content_policy"], ORACLES["E24_content_policy"], str(tmp_path)) is None


def test_contract_documents():
    assert flatten_cues({"a": [" Foo ", "", "Bar"], "pattern": "x.*", "b": ["z"]}) == ("foo", "bar", "z")
    spec = FormSpec.from_documents(
        {"fields": [
            {"id": "q", "type": "structured", "value_domain": ["a"], "t": "x", "routing": {"note": "n", "a": "r"}},
            {"id": "o", "type": "metadata", "role": "outcome"},
        ]},
        {"pairs": [{"id": "p", "structured": "q", "free_text": "w", "t": "x", "outside_leaning": "a"}]},
        test_key="t",
    )
    assert spec.by_id["q"].routing == {"a": "r"} and spec.pairs[0].test == "x"
    assert [f.id for f in spec.input_fields] == ["q"] and spec.for_test("x")[0].id == "q"
    with pytest.raises(ValueError):
        FieldSpec("q", "number")


def test_labelled_instances(spark):
    spec = FormSpec(
        fields=SPEC.fields,
        pairs=(PairSpec("p", "reject", "why", "t", "No"),),
    )
    records = spark.createDataFrame(
        [("1", "No", "text"), ("2", "", "text"), ("3", "Yes", None)],
        "record_id string, reject string, why string",
    )
    truth = spark.createDataFrame(
        [
            ("1", "arch", "reg", "in", [("p", "t0", 1), ("p", "t1", 2)], []),
            ("2", "arch", "reg", "in", [], []), ("3", "arch", "reg", "in", [], [("why", "blank")]),
        ],
        "record_id string, archetype string, register string, outcome_label string, "
        "contradictions array<struct<pair_id:string,contradiction_type:string,subtlety:int>>, "
        "anomalies array<struct<field_id:string,kind:string>>",
    )
    states = spark.createDataFrame([("1", {"p": "u"}), ("2", {}), ("3", {})], "record_id string, units map<string,string>")
    rows = {r.record_id: r for r in instances.build_labelled(records, truth, states, spec).collect()}
    assert set(rows) == {"1", "3"}
    assert (rows["1"].label, rows["1"].contradiction_type, rows["1"].unit_key) == (1, "t1", "u")
    assert rows["1"].is_outside_leaning and not rows["3"].is_outside_leaning
    assert (rows["3"].label, rows["3"].free_text, rows["3"].anomaly) == (0, "", "blank")


def test_jsonl_round_trip_and_alignment(spark, tmp_path):
    df = spark.createDataFrame([("1", "Yes", None), ("2", None, "x")], "record_id string, reject string, why string")
    path = str(tmp_path / "r")
    io.write_jsonl(df, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert all(list(line) == sorted(line) for line in lines) and {"record_id": "2", "why": "x"} in lines
    back = io.read_jsonl(spark, path, io.record_schema(SPEC))
    assert back.count() == 2
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "none"), io.record_schema(SPEC)).count()
    with pytest.raises(ValueError):
        io.require_aligned(df, df.where("record_id = '1'"), df)
    io.require_aligned(df, df, df)


def test_submissions_are_objects(spark):
    lines = [('{"record_id": "a", "reject": "Yes"}',), ("[1]",), ("{broken",), ('{"reject": "No"}',), ('"x"',)]
    parsed = io.parse_submissions(spark.createDataFrame(lines, "value string"), SPEC)
    good, bad = io.split_submissions(parsed)
    ids = [r.record_id for r in good.collect()]
    assert "a" in ids and any(i.startswith("UPLOAD-") for i in ids) and len(ids) == 2
    assert bad.count() == 3


def test_unpivot_drops_blanks(spark):
    df = spark.createDataFrame([("1", "x", "", None)], "record_id string, a string, b string, c string")
    assert [tuple(r) for r in form.to_long(df, ["a", "b", "c"]).collect()] == [("1", "a", "x")]
