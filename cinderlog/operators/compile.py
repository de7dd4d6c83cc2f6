"""One rule body as one DataFrame: filters, equi-joins, anti-joins, projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.values import comparable, convert, equal, kind_of_value, literal, narrower
from cinderlog.operators.relation import UNIT, Relation
from cinderlog.plans.syntax import Atom, Const, Rule, Var


def select_pattern(rel: Relation, terms) -> DataFrame:
    """Rows whose columns equal the constants among terms (None matches anything)."""
    df = rel.df
    for c, kind, t in zip(rel.columns, rel.kinds, terms):
        if isinstance(t, Const):
            df = df.filter(equal(F.col(c), kind, literal(t.value), kind_of_value(t.value)))
    return df


def scan_atom(rel: Relation, atom: Atom, prefix: str = "v") -> tuple[DataFrame, dict[str, str]]:
    """The atom's rows with one column ``<prefix>_<name>`` for each variable; constants and repeated variables filter."""
    if len(atom.terms) != len(rel.kinds):
        raise ValueError(f"{atom!r} has {len(atom.terms)} terms; the relation has {len(rel.kinds)} columns")
    df, first, kinds = select_pattern(rel, atom.terms), {}, {}
    for c, kind, t in zip(rel.columns, rel.kinds, atom.terms):
        if isinstance(t, Var):
            if t.name in first:
                df = df.filter(equal(F.col(first[t.name]), kinds[t.name], F.col(c), kind))
            else:
                first[t.name], kinds[t.name] = c, kind
    return df.selectExpr(*(_named((c, f"{prefix}_{v}") for v, c in first.items()) or [f"true AS {prefix}_unit"])), kinds


def _named(columns) -> list[str]:
    """Expressions as text: a plan is made in fewer calls to the JVM than with an object for each column."""
    return [f"`{c}` AS `{name}`" for c, name in columns]


def _join(left: DataFrame, lk: dict, right: DataFrame, rk: dict, how: str) -> DataFrame:
    """left has columns v_<name>, right r_<name>; they are joined on the variables that both have."""
    shared = [v for v in rk if v in lk]
    if not shared:
        return left.crossJoin(right)
    if all(lk[v] == rk[v] for v in shared):
        return left.join(right, F.expr(" AND ".join(f"`v_{v}` = `r_{v}`" for v in shared)), how)
    cond = F.lit(True)
    for v in shared:
        cond = cond & equal(F.col(f"v_{v}"), lk[v], F.col(f"r_{v}"), rk[v])
    return left.join(right, cond, how)


def _in_order(atoms: list[tuple[int, Atom]], first: int | None) -> list[tuple[int, Atom]]:
    """Textual order, but the changed atom first and joins before cross products."""
    rest = sorted(atoms, key=lambda x: x[0] != first)
    out, bound = [], set()
    while rest:
        k = next((i for i, (_, a) in enumerate(rest) if out and bound & set(a.variables())), 0)
        out.append(rest.pop(k))
        bound |= set(out[-1][1].variables())
    return out


def rule_kinds(rule: Rule, kinds_of: Callable[[Atom], tuple[str, ...]]) -> tuple[str, ...]:
    """Kinds of the head's columns; a variable has the narrowest kind of its places in the positive body."""
    kinds: dict[str, str] = {}
    for atom in rule.body:
        if atom.sign:
            for t, kind in zip(atom.terms, kinds_of(atom)):
                if isinstance(t, Var):
                    kinds[t.name] = narrower(kinds.get(t.name, kind), kind)
    return tuple(kinds[t.name] if isinstance(t, Var) else kind_of_value(t.value) for t in rule.head.terms)


def compile_rule(spark: SparkSession, rule: Rule, lookup: Callable[[int, Atom], Relation], delta: int | None = None) -> Relation:
    """The head tuples of a rule, repeats included. lookup: the relation to use at a position of the body."""
    positive = [(i, a) for i, a in enumerate(rule.body) if a.sign]
    negative = [(i, a) for i, a in enumerate(rule.body) if not a.sign]
    needed_later = {v for _, a in negative for v in a.variables()} | set(rule.head.variables())
    df, kinds, column = None, {}, {}  # column: where a variable's value is

    def plain_names() -> DataFrame:
        if all(c == f"v_{v}" for v, c in column.items()) and column:
            return df
        return df.selectExpr(*(_named((c, f"v_{v}") for v, c in column.items()) or ["true AS v_unit"]))

    ordered = _in_order(positive, delta)
    for n, (i, atom) in enumerate(ordered):
        right, rk = scan_atom(lookup(i, atom), atom, "r" if n else "v")
        later = needed_later | {v for _, a in ordered[n + 1 :] for v in a.variables()}
        if n:
            df, column = plain_names(), {v: f"v_{v}" for v in column}
            better = {v for v in rk if v not in kinds or narrower(kinds[v], rk[v]) != kinds[v]}
            restricts = set(rk) & set(kinds) and not better & later  # no column of it is used again
            df = _join(df, kinds, right, rk, "left_semi" if restricts else "inner")
            if not restricts:
                kinds, column = kinds | {v: rk[v] for v in better}, column | {v: f"r_{v}" for v in better}
        else:
            df, kinds, column = right, rk, {v: f"v_{v}" for v in rk}
        kinds, column = {v: k for v, k in kinds.items() if v in later}, {v: c for v, c in column.items() if v in later}
        if not column and n + 1 < len(ordered):
            df = plain_names().limit(1)  # only whether there is a row matters
    if df is None:
        df = spark.range(1).select(F.lit(True).alias("v_unit"))
    for i, atom in negative:
        df, column = plain_names() if column else df, {v: f"v_{v}" for v in column}
        right, rk = scan_atom(lookup(i, atom), atom, "r")
        if rk:
            df = _join(df, kinds, right, rk, "left_anti")
        else:  # a ground atom: all rows stay if it has no match, none otherwise
            df = df.join(right.limit(1), F.col("r_unit"), "left_anti")
    if rule.head.terms and all(isinstance(t, Var) for t in rule.head.terms):
        return Relation(df.selectExpr(*_named((column[t.name], f"c{j}") for j, t in enumerate(rule.head.terms))), tuple(kinds[t.name] for t in rule.head.terms))
    head, head_kinds = [], []
    for j, t in enumerate(rule.head.terms):
        head.append((F.col(column[t.name]) if isinstance(t, Var) else literal(t.value)).alias(f"c{j}"))
        head_kinds.append(kinds[t.name] if isinstance(t, Var) else kind_of_value(t.value))
    return Relation(df.select(*(head or [F.lit(True).alias(UNIT)])), tuple(head_kinds))


def without(rel: Relation, known: Relation) -> Relation:
    """Distinct rows of rel that are not in known; both have the same kinds."""
    left, cols = rel.df.distinct(), rel.columns
    if known.n == 0 or any(comparable(a, b) is None for a, b in zip(rel.kinds, known.kinds)):
        return Relation(left, rel.kinds)
    right = known.widened(rel.kinds).df.selectExpr(*_named((c, f"k_{c}") for c in cols))
    return Relation(left.join(right, F.expr(" AND ".join(f"`{c}` <=> `k_{c}`" for c in cols)), "left_anti"), rel.kinds)


__all__ = ["compile_rule", "convert", "rule_kinds", "scan_atom", "select_pattern", "without"]
