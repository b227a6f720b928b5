"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import os

import pytest
from check import compare, connect

from formproof.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# fits ten text models again, without SQL; L8_out_of_fold_text_model covers them
FITTED = {"M10_text_model"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_query(spark, con, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    problem = compare(spark, con, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
