"""Expressions that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are not merged into later expressions or filters.

    The optimizer copies an expression into each place that uses its column. For a long one with
    many uses the copies outgrow the code generator's limits. A generator over a single struct is
    never copied.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(packed)))
