"""Column types of relations, and comparisons that never cast between kinds of values.

A column is ``bool``, ``long``, ``ubig`` (integers beyond 2**63 - 1), ``string``, ``mixed`` (a tagged
struct) or, for columns of inserted DataFrames, any other Spark type, kept as it is.

Nulls, which only inserted DataFrames can hold, equal nothing in a rule's body (a constant, a shared variable, a negated
atom), whatever the kind; as rows of a set they are one value, as in SQL's DISTINCT and EXCEPT.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIXED = T.StructType(
    [T.StructField("t", T.ByteType()), T.StructField("s", T.StringType()), T.StructField("i", T.DecimalType(20, 0)), T.StructField("b", T.BooleanType())]
)
SPARK = {"bool": T.BooleanType(), "long": T.LongType(), "ubig": T.DecimalType(20, 0), "string": T.StringType(), "mixed": MIXED}
INTEGERS = ("long", "ubig")


def kind_of_type(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    for kind, spark in SPARK.items():
        if dt == spark:
            return kind
    return dt.simpleString()


def kind_of_value(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return "string"
    return "long" if value < 2**63 else "ubig"


def join_kinds(a: str | None, b: str | None) -> str | None:
    """The narrowest kind that holds both."""
    if a is None or b is None or a == b:
        return b if a is None else a
    if a in INTEGERS and b in INTEGERS:
        return "ubig"
    if {a, b} <= set(SPARK):
        return "mixed"
    raise ValueError(f"a relation's column can't hold both {a} and {b}")


def narrower(a: str, b: str) -> str:
    """Of the kinds of two columns that a join makes equal, the one that its rows fit."""
    rank = {"mixed": 2, "ubig": 1}
    return min(a, b, key=lambda k: (rank.get(k, 0), k))


def literal(value) -> Column:
    return F.lit(value).cast(SPARK[kind_of_value(value)])


def convert(col: Column, have: str, want: str) -> Column:
    if have == want:
        return col
    if want == "ubig":
        return col.cast(SPARK["ubig"])
    if want != "mixed":
        raise ValueError(f"{have} doesn't fit a column of {want}")
    none = {k: F.lit(None).cast(t) for k, t in (("s", SPARK["string"]), ("i", SPARK["ubig"]), ("b", SPARK["bool"]))}
    tag, slot = {"string": (0, "s"), "long": (1, "i"), "ubig": (1, "i"), "bool": (2, "b")}[have]
    parts = none | {slot: col.cast(SPARK["ubig"]) if slot == "i" else col}
    return F.when(col.isNotNull(), F.struct(F.lit(tag).cast("byte").alias("t"), *(parts[k].alias(k) for k in "sib")))


def comparable(a: str, b: str) -> str | None:
    """The kind in which values of a and b are compared; None if they are never equal."""
    if a == b:
        return a
    if a in INTEGERS and b in INTEGERS:
        return "ubig"
    if "mixed" in (a, b) and {a, b} <= set(SPARK):
        return "mixed"
    return None


def equal(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    kind = comparable(a_kind, b_kind)
    return F.lit(False) if kind is None else convert(a, a_kind, kind) == convert(b, b_kind, kind)


def tagged(value):
    """A Python value as a row of MIXED."""
    kind = kind_of_value(value)
    if kind == "string":
        return (0, value, None, None)
    return (2, None, None, value) if kind == "bool" else (1, None, Decimal(value), None)


def plain(value):
    """The Python value of a collected cell."""
    if isinstance(value, tuple) and len(value) == 4:
        return (value[1], None if value[2] is None else int(value[2]), value[3])[value[0]]
    return int(value) if type(value).__name__ == "Decimal" else value
