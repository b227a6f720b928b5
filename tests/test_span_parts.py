"""Patterns that run on a part of a text find what they find in the whole of it."""

import random

from pyspark.sql import functions as F

from formproof.functions import spans as sp
from formproof.functions.text import let

PIECES = (
    "a.b+c@mail.example.org", "@x.yz", "QQ 12 34 56C", "QQ123456C", "xQQ123456C", "BN1 1RH", "bn11rh", "ſw1 1aa", "K1 1aa",
    "born 12/03/1980", "D.O.B. 1 March 1980", "date of bırth: 1.2.99", "DOB\n12-3-1980", "born", "http://a", "https://x.y?q=1",
    "www.example.com/c/1", "io.example.io", "a.gov.uk", "07700 900123", "+44 7700900123", "12345678", "AB123456", "٣٤٥",
    "£ 12,000.50", "1,200 GBP", "3 pounds", "5 POUNDS.", "Dr Anna Berg", "Prof. O'Neil", "é́", "́", "\U0001f600", "word", "ß",
)


def _texts():
    draw = random.Random(5)
    rows = ["", " ", "1", "@", " 1 ", "no digit at all"]
    for _ in range(600):
        parts = [draw.choice(PIECES) + draw.choice((" ", " ", "", "\n", " ", ". ", "́ ", "  ")) for _ in range(draw.randint(1, 9))]
        rows.append("".join(parts))
    return rows


def test_parts_of_texts_give_the_spans_of_whole_texts(spark):
    rows = spark.createDataFrame([(t,) for t in _texts()], "text string")
    text = F.col("text")
    for d in sp.DETECTORS.values():
        whole = sp.pattern_spans(text, d.pattern, d.name, d.priority, d.groups)
        got = rows.select(sp.detector_spans(text, [d.name]).alias("part"), whole.alias("whole"), "text").collect()
        assert any(r.whole for r in got), d.name
        assert [(r.text, r.part) for r in got] == [(r.text, r.whole) for r in got], d.name
    every = rows.select(sp.detector_spans(text, list(sp.DETECTORS)).alias("all"), F.concat(
        *[sp.detector_spans(text, [name]) for name in sp.DETECTORS]).alias("each")).collect()
    assert all(sorted(r["all"]) == sorted(r["each"]) for r in every)


def test_terms_are_found_from_the_first_hit_on(spark):
    rows = spark.createDataFrame([(t,) for t in _texts()], "text string").withColumn("terms", F.array(F.lit("WORD"), F.lit("ſw1"), F.lit("mail.example")))
    text, terms = F.col("text"), F.col("terms")
    whole = F.flatten(F.array(*[
        sp.pattern_spans(text, rf"(?iU)\b\Q{t}\E\b", "person_name", sp.GAZETTEER_PRIORITY) for t in ("WORD", "ſw1", "mail.example")]))
    got = rows.select(sp.gazetteer_spans(text, terms, sp.any_term_pattern(terms)).alias("part"), whole.alias("whole")).collect()
    assert any(r.whole for r in got) and all(r.part == r.whole for r in got)


def test_a_part_begins_with_a_word(spark):
    rows = spark.createDataFrame([("ab cd ef", 4), ("ab cd ef", 0), ("abcdef", 3), ("é\U0001f600 x", 3), ("ab cd", 3)], "text string, at int")
    got = rows.select(sp.from_word(F.col("text"), F.col("at")).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in got] == [(3, "cd ef"), (0, "ab cd ef"), (0, "abcdef"), (3, "x"), (3, "cd")]


def test_a_bound_variable_is_no_element_of_an_array(spark):
    plan = spark.range(1).select(let(F.col("id") + 1, lambda v: v * v).alias("x"))
    assert plan.collect()[0].x == 1
    assert "transform(" not in plan._jdf.queryExecution().analyzed().toString()
