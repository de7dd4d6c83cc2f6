"""A named set of tuples: a DataFrame with columns c0, c1, … and the kind of each column."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinderlog.functions.scratch import LITERAL_ROWS, few_rows, literal, stored_counted
from cinderlog.functions.values import SPARK, convert, join_kinds, kind_of_type, kind_of_value, tagged

UNIT = "__unit"  #: the hidden column of a relation without columns


def schema_of(kinds: tuple[str, ...]) -> T.StructType:
    if not kinds:
        return T.StructType([T.StructField(UNIT, T.BooleanType())])
    return T.StructType([T.StructField(f"c{i}", SPARK[k] if k in SPARK else T._parse_datatype_string(k)) for i, k in enumerate(kinds)])


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    kinds: tuple[str, ...]
    repeats: bool = False  # rows may repeat: inserted tables, which rules need not make distinct first
    rows: object = None  # its rows in the driver's JVM, where it is a literal
    n: int | None = None  # number of rows, where known
    parts: tuple[Relation, ...] = ()  # what it is made of, where it has grown

    def as_set(self) -> Relation:
        return Relation(self.df.distinct(), self.kinds) if self.repeats else self

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.kinds))] or [UNIT]

    @staticmethod
    def from_df(df: DataFrame) -> Relation:
        """Columns by position; integers become long, others keep their type. Rows may repeat: heads drop repeats."""
        kinds = tuple(kind_of_type(f.dataType) for f in df.schema.fields)
        cols = [
            (F.col(f"`{f.name}`").cast(SPARK[k]) if k == "long" else F.col(f"`{f.name}`")).alias(f"c{i}")
            for i, (f, k) in enumerate(zip(df.schema.fields, kinds))
        ]
        return Relation(df.select(*cols), kinds, True)

    @staticmethod
    def from_rows(spark: SparkSession, rows: list[tuple], arity: int) -> Relation:
        kinds: list[str | None] = [None] * arity
        for row in rows:
            kinds = [join_kinds(k, kind_of_value(v)) for k, v in zip(kinds, row)]
        kinds = tuple(k or "long" for k in kinds)
        cells = {"mixed": tagged, "ubig": Decimal}
        data = [tuple(cells[k](v) if k in cells else v for k, v in zip(kinds, row)) for row in rows] if arity else [(True,)] * bool(rows)
        schema = schema_of(kinds)
        names = [f.name for f in schema.fields]
        cols = [[dict(zip("tsib", v)) if k == "mixed" else v for v in col] for k, col in zip(kinds or ("bool",), zip(*data))] or [[] for _ in names]
        arrow = to_arrow_schema(schema)
        table = pa.table([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)  # a literal of the plan, if not too large
        return Relation(spark.createDataFrame(table, schema), kinds, n=len(data))

    @staticmethod
    def empty(spark: SparkSession, kinds: tuple[str, ...]) -> Relation:
        return Relation(literal(spark, spark._jvm.java.util.ArrayList(), schema_of(kinds)), kinds, n=0)

    def widened(self, kinds: tuple[str, ...]) -> Relation:
        if kinds == self.kinds:
            return self
        return Relation(self.df.select(*(convert(F.col(c), a, b).alias(c) for c, a, b in zip(self.columns, self.kinds, kinds))), kinds, self.repeats, n=self.n)


def from_list(spark: SparkSession, rows, kinds: tuple[str, ...]) -> Relation:
    """A literal. A single task reads a small one, so that what follows needs no shuffle."""
    df, n = literal(spark, rows, schema_of(kinds)), rows.size()
    return Relation(df.coalesce(1) if n <= LITERAL_ROWS // 4 else df, kinds, rows=rows, n=n)


def materialized(rel: Relation, name: str, expected: int = 0) -> Relation:
    """The same rows as a literal where they are few, else as a stored table. expected: a guess at their number."""
    if expected <= LITERAL_ROWS:
        rows = few_rows(rel.df)
        if rows is not None:
            return from_list(rel.df.sparkSession, rows, rel.kinds)
    df, n = stored_counted(rel.df, name)
    return Relation(df, rel.kinds, rel.repeats, n=n)


class Grown:
    """A relation as parts: literals that are merged as long as they stay small, and stored tables. Small tables are merged when there are
    many, a table only with as many rows at least as it has itself, so that each row is rewritten a logarithmic number of times."""

    MOST = 10

    def __init__(self, rel: Relation):
        self.kinds = rel.kinds
        self.parts = list(rel.parts) or [rel]

    def add(self, rel: Relation) -> None:
        if rel.n == 0:
            return
        at = next((i for i, p in enumerate(self.parts) if p.rows is not None), None)
        if rel.rows is not None and at is not None and self.parts[at].kinds == rel.kinds and self.parts[at].n + rel.n <= LITERAL_ROWS:
            rows = rel.df.sparkSession._jvm.java.util.ArrayList(self.parts[at].rows)
            rows.addAll(rel.rows)
            self.parts[at] = from_list(rel.df.sparkSession, rows, rel.kinds)
            return
        self.parts.append(rel)
        if len(self.parts) <= self.MOST:
            return
        sized = sorted((p for p in self.parts if p.n is not None), key=lambda p: p.n)
        few, total = [], 0
        for p in sized:
            if len(few) >= self.MOST // 2 and p.n > total:
                break
            few.append(p)
            total += p.n
        df, n = stored_counted(union(few, self.kinds).df, "parts")
        self.parts = [p for p in self.parts if not any(p is q for q in few)] + [Relation(df, self.kinds, any(p.repeats for p in few), n=n)]

    def relation(self) -> Relation:
        whole = self.parts[0] if len(self.parts) == 1 and self.parts[0].kinds == self.kinds else union(self.parts, self.kinds)
        n = None if any(p.n is None for p in self.parts) else sum(p.n for p in self.parts)
        return Relation(whole.df, self.kinds, any(p.repeats for p in self.parts), n=n, parts=tuple(self.parts))


def common_kinds(relations: list[Relation]) -> tuple[str, ...]:
    kinds = relations[0].kinds
    for r in relations[1:]:
        if len(r.kinds) != len(kinds):
            raise ValueError(f"tuples of {len(kinds)} and {len(r.kinds)} values in one relation")
        kinds = tuple(map(join_kinds, kinds, r.kinds))
    return kinds


def union(relations: list[Relation], kinds: tuple[str, ...] | None = None) -> Relation:
    """All rows, repeats included, in columns wide enough for all."""
    kinds = kinds or common_kinds(relations)
    out = None
    for r in relations:
        df = r.widened(kinds).df
        out = df if out is None else out.union(df)
    return Relation(out, kinds)
