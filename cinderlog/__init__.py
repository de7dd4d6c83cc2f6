"""Recursive rule analytics on Spark: rules in, DataFrames out."""

from cinderlog.plans.syntax import (
    Atom, Const, Program, Query, QueryBuilder, Rule, Var, parse_program, parse_query, parse_rule,
)
from cinderlog.runtime import Runtime

__all__ = [
    "Atom", "Const", "Program", "Query", "QueryBuilder", "Rule", "Runtime", "Var",
    "parse_program", "parse_query", "parse_rule",
]
