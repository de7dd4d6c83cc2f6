"""Row helpers of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 1 << 16


def numbers(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each number from first to last (both included; none if last is less), in steps, so that no array
    grows with the number of rows."""
    out = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).filter("_first <= _last")
    out = out.withColumn("_from", F.explode(F.expr(f"sequence(_first, _last, {STEP}L)")))
    out = out.withColumn(name, F.explode(F.expr(f"sequence(_from, least(_from + {STEP - 1}, _last))")))
    return out.drop("_first", "_last", "_from")
