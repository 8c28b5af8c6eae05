"""Canonical result cells: one text form per value, so equality follows value equality.

``null`` stays null, numbers become ``n:<text>``, text ``s:<text>`` and binary ``b:<hex>``.  Whole
numbers of any type have exact digits and ``.0`` (``1`` equals ``1.0``); other decimals have their double's
text where the double is exact, else their own digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_cell(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        col = col.cast("int")
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return F.concat(F.lit("n:"), col.cast("string"), F.lit(".0"))
    if isinstance(dtype, T.DecimalType):
        # digits without closing zeros; comparing decimals of other scales would round
        text = F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        double = col.cast("double")
        fraction = F.when(double.try_cast(dtype) == col, double.cast("string")).otherwise(text)
        digits = F.when(col == 0, "0.0").when(F.contains(text, F.lit(".")), fraction).otherwise(F.concat(text, F.lit(".0")))
        return F.concat(F.lit("n:"), digits)
    if isinstance(dtype, T.NumericType):
        double = col.cast("double")
        whole = (F.abs(double) < 1e18) & (F.floor(double) == double)
        # whole doubles keep integer digits; -0.0 becomes 0
        digits = F.when(whole, F.when(whole, double).otherwise(0.0).cast("bigint").cast("string"))
        return F.concat(F.lit("n:"), F.coalesce(F.concat(digits, F.lit(".0")), double.cast("string")))
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("b:"), F.hex(col))
    return F.concat(F.lit("s:"), col.cast("string"))


def canonical_row(df: DataFrame, cols: list[str] | None = None) -> Column:
    """All (or the named) columns of ``df`` as one ``ArrayType(String)`` of canonical cells."""
    cols = df.columns if cols is None else cols
    return F.array(*[canonical_cell(F.col(f"`{c}`"), df.schema[c].dataType) for c in cols])
