"""Column selection and reshaping of wide records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import FormSpec
from ..functions.text import is_blank


def drop_outcomes(df: DataFrame, spec: FormSpec) -> DataFrame:
    """B1: remove the outcome block before anything may read it."""
    return df.drop(*[f.id for f in spec.outcome_fields])


def select_fields(
    df: DataFrame,
    spec: FormSpec,
    *,
    field_type: str | None = None,
    test: str | None = None,
    ids: Sequence[str] = ("record_id",),
) -> DataFrame:
    """B2: the columns the contract lists under a type and/or a test."""
    wanted = [
        f.id
        for f in spec.fields
        if (field_type is None or f.type == field_type) and (test is None or f.test == test)
    ]
    have = set(df.columns)
    return df.select(*ids, *[c for c in wanted if c in have and c not in ids])


def to_long(
    df: DataFrame, columns: Sequence[str], *, ids: Sequence[str] = ("record_id",)
) -> DataFrame:
    """One row per answered field; blanks (B4) disappear."""
    have = set(df.columns)
    long = df.unpivot(list(ids), [c for c in columns if c in have], "field_id", "value")
    return long.where(~is_blank(F.col("value")))
