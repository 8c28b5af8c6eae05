"""Evaluate a costly expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, **exprs: Column) -> DataFrame:
    """``df`` with the named columns, each computed exactly once.

    A generator is not merged with the projections above it.  Without it the optimizer may copy
    the expression into every use: into filters, and into lambdas, where it would run once per
    array element.
    """
    cols = [e.alias(name) for name, e in exprs.items()]
    return df.select("*", F.inline(F.array(F.struct(*cols))))
