"""P3-P5 on texts whose first letter has no single upper case of its own in full case mapping."""

import pytest

from formproof.catalog import ORACLES, QUERIES

from check import compare

WORDS = ("ähre", "acker", "birke", "damm", "eiche", "feld", "garten", "hafen", "insel", "kanal")


@pytest.fixture(scope="module")
def sharp_s(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sharp")
    rows = [(i, f"ß{WORDS[i % 10]}", "de", "web", 10) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(folder / "documents.parquet")
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas().to_parquet(folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["P3_flag_sets", "P4_record_jaccard", "P5_agreement_summary"])
def test_sharp_s_agrees_with_sql(spark, sharp_s, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sharp_s}/{table}.parquet')")
    assert compare(spark, con, QUERIES[name], ORACLES[name], sharp_s) is None
