"""Named queries over the shared test tables, each with its SQL counterpart."""

from . import base, contract, deidentify, evaluation, reviewing, scoring  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
