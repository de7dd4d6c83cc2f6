"""Least fixpoints by semi-naive rounds, one strongly connected group of predicates at a time."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import SparkSession

from cinderlog.functions.scratch import LITERAL_BYTES, LITERAL_ROWS, costly, few_rows, size_estimate, stored
from cinderlog.operators.closure import closed
from cinderlog.operators.compile import compile_rule, rule_kinds, without
from cinderlog.operators.relation import Grown, Relation, common_kinds, from_list, materialized, union
from cinderlog.plans.analysis import components
from cinderlog.plans.syntax import Atom, Program, Rule, Var


@contextmanager
def loop_settings(spark: SparkSession):
    """Constraint propagation costs planning time that grows with the rounds; the user's value comes back after."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class SmallRounds:
    """Settings for rounds over literals alone, which one task does in the time that planning anything finer takes."""

    SETTINGS = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.leafNodeDefaultParallelism": "1",
    }

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, None

    def use(self, on: bool) -> None:
        conf = self.spark.conf
        if on and self.before is None:
            self.before = {k: conf.get(k, None) for k in self.SETTINGS}
            for k, v in self.SETTINGS.items():
                conf.set(k, v)
        elif not on and self.before is not None:
            for k, v in self.before.items():
                conf.unset(k) if v is None else conf.set(k, v)
            self.before = None


def doubled(program: Program, symbol: str) -> Program:
    """Transitive closure written linearly, p <- e and p <- e,p (or p,e), as p <- e and p <- p,p: the same
    least fixpoint in logarithmically many rounds. Any other rules stay as they are."""
    rules = program.rules_for(symbol)
    if len(rules) != 2:
        return program
    base, step = sorted(rules, key=lambda r: len(r.body))
    if len(base.body) != 1 or len(step.body) != 2 or not all(a.sign for r in rules for a in r.body):
        return program
    e = base.body[0].symbol

    def chain(atoms, head) -> bool:
        ts = [*head.terms, *(t for a in atoms for t in a.terms)]
        if not all(isinstance(t, Var) for t in ts) or any(len(a.terms) != 2 for a in (*atoms, head)):
            return False
        names = [t.name for t in atoms[0].terms] + [t.name for a in atoms[1:] for t in a.terms[1:]]
        linked = all(a.terms[1] == b.terms[0] for a, b in zip(atoms, atoms[1:]))
        return linked and len(set(names)) == len(names) and [t.name for t in head.terms] == [names[0], names[-1]]

    for body in (step.body, step.body[::-1]):
        if sorted(a.symbol for a in body) == sorted((e, symbol)) and e != symbol and chain(list(base.body), base.head) and chain(list(body), step.head):
            twice = Rule(step.head, tuple(Atom(symbol, a.terms) for a in body))
            return Program([r for r in program if r != step] + [twice])
    return program


#: Candidate rows of a round beyond which closing by p, p costs more than it saves in rounds.
MANY_CANDIDATES = 30_000_000
#: Members of a component from which a closure of few edges isn't begun by rounds.
MANY_MEMBERS = 1_000
#: Pairs of a new row and a known row up to which a round over literals is one task's.
FEW_PAIRS = 60_000_000


def linear_step(program: Program, symbol: str) -> Rule | None:
    """For p <- e and p <- p, p over chains: the rule p <- p, e, which reaches the same fixpoint from any round on
    (every pair of the rounds before has then been extended by all of p, so by e too). None for other rules."""
    rules = program.rules_for(symbol)
    bases = [r for r in rules if len(r.body) == 1 and r.body[0].symbol != symbol]
    if len(rules) != 2 or len(bases) != 1:
        return None
    (base,), (step,) = bases, [r for r in rules if r is not bases[0]]
    e = base.body[0].symbol
    first = Rule(step.head, (step.body[0], Atom(e, step.body[1].terms))) if len(step.body) == 2 else None
    if first is None or [a.symbol for a in step.body] != [symbol, symbol]:
        return None
    return first if doubled(Program([base, first]), symbol) == Program([base, step]) else None


def goal_directed(program: Program, symbol: str, pattern: str) -> Program:
    """A transitive closure, however it is written, with its recursive rule turned so that a bound end is carried along: from a bound
    first column p <- p, e (else p <- e, p), so that the magic set of a query is its constants alone. The same least fixpoint."""
    closed = doubled(program, symbol)
    step = linear_step(closed, symbol)
    if step is None or len(pattern) != 2 or "b" not in pattern:
        return program
    e, (first, second) = step.body[1].symbol, step.body
    turned = step if pattern[0] == "b" else Rule(step.head, (Atom(e, first.terms), Atom(symbol, second.terms)))
    base = [r for r in closed.rules_for(symbol) if len(r.body) == 1]
    return Program([*(r for r in program if r.head.symbol != symbol), *base, turned])


def infer_kinds(program: Program, group: list[str], model: dict[str, Relation]) -> dict[str, tuple[str, ...]]:
    """Column kinds of the group's predicates: the least that hold their facts and all that their rules derive."""
    kinds: dict[str, tuple[str, ...]] = {p: model[p].kinds for p in group if p in model}
    of = lambda a: kinds[a.symbol] if a.symbol in group else model[a.symbol].kinds
    while True:
        before = dict(kinds)
        for p in group:
            for rule in program.rules_for(p):
                if any(a.sign and a.symbol in group and a.symbol not in kinds for a in rule.body):
                    continue
                got = rule_kinds(rule, of)
                kinds[p] = got if p not in kinds else common_kinds([Relation(None, kinds[p]), Relation(None, got)])
        if kinds == before:
            return kinds


def solve(
    spark: SparkSession,
    program: Program,
    base: dict[str, Relation],
    known: dict[str, Relation] | None = None,
    new: dict[str, Relation] | None = None,
) -> dict[str, Relation]:
    """The least model, stratum by stratum.

    base: all given facts, of any predicate. known and new (for programs without negation): the model before and
    the facts added since; then only derivations that use a new fact are made.
    """
    model = dict(base)
    delta: dict[str, Relation] = {p: r for p, r in (new or {}).items() if r.n != 0}
    for symbol in {a.symbol for r in program for a in r.body} - program.heads() - set(model):
        n = next(len(a.terms) for r in program for a in r.body if a.symbol == symbol)
        model[symbol] = Relation.empty(spark, ("long",) * n)
    if known is not None:
        model |= {p: r for p, r in known.items() if p in program.heads()}

    with loop_settings(spark):
        for group in components(program):
            rules = [r for p in group for r in program.rules_for(p)]
            if not rules:
                continue
            recursive = any(a.symbol in group for r in rules for a in r.body)
            if recursive and known is None and len(group) == 1 and group[0] not in base:
                program = doubled(program, group[0])
            kinds = infer_kinds(program, group, model)
            for p in group:  # no facts and no rule that could ever start
                kinds.setdefault(p, ("long",) * len(program.rules_for(p)[0].head.terms) if program.rules_for(p) else ())
            if known is None:
                _first_solution(spark, program, group, recursive, kinds, model)
            else:
                _update(spark, program, group, kinds, model, delta)
    return model


def _first_solution(spark, program, group, recursive, kinds, model) -> None:
    if not recursive:
        for p in group:
            got = [compile_rule(spark, r, lambda i, a: model[a.symbol]) for r in program.rules_for(p)]
            whole = union(([model[p]] if p in model else []) + got, kinds[p])
            model[p] = Relation(whole.df.distinct(), kinds[p])
        return
    # facts given for p itself are not made of e
    plain = linear_step(program, group[0]) if len(group) == 1 and group[0] not in model else None
    _keep_outside([r for p in group for r in program.rules_for(p) if any(a.symbol in group for a in r.body)], group, model)
    grown, delta = {}, {}
    for p in group:
        exits = [r for r in program.rules_for(p) if not any(a.symbol in group for a in r.body)]
        got = [compile_rule(spark, r, lambda i, a: model[a.symbol]) for r in exits]
        start = ([model[p]] if p in model else []) + got
        delta[p] = materialized(Relation(union(start, kinds[p]).df.distinct(), kinds[p]), "start") if start else Relation.empty(spark, kinds[p])
        grown[p] = Grown(delta[p])
    edges = delta[group[0]] if plain is not None else None
    if edges is not None and edges.n and (edges.rows is None or edges.n >= MANY_MEMBERS):
        whole = _closure(spark, program, group[0], kinds, edges, plain, 1 if edges.rows is None else MANY_MEMBERS)
        if whole is not None:
            model[group[0]] = whole
            return
        edges = None if edges.rows is None else edges
    _rounds(spark, program, group, kinds, model, grown, delta, plain=plain, edges=edges)


def _closure(spark, program, p, kinds, edges: Relation, plain: Rule, least: int = 1) -> Relation | None:
    """p as the closure of its first rule's rows, or None where only rounds will do, or no component has as many members as least."""

    def by_rounds(e: Relation) -> Relation:
        model = {plain.body[1].symbol: e}
        _rounds(spark, program, [p], kinds, model, {p: Grown(e)}, {p: e}, plain=plain)
        return model[p]

    return closed(spark, edges, by_rounds, least)


def _update(spark, program, group, kinds, model, delta) -> None:
    """Adds what follows from the new facts; leaves in delta what is new in this group."""
    uses = [(r, k) for p in group for r in program.rules_for(p) for k, a in enumerate(r.body) if a.symbol in delta and a.symbol not in group]
    if not uses and not any(p in delta for p in group):
        return
    for p in group:  # a closure that is made where it is read is read in every round
        if p in model and model[p].n is None and any(a.symbol in group for r in program.rules_for(p) for a in r.body) and costly(model[p].df):
            model[p] = materialized(model[p], "known", LITERAL_ROWS + 1)
    grown = {p: Grown(model[p].widened(kinds[p]) if p in model else Relation.empty(spark, kinds[p])) for p in group}
    now = lambda a: grown[a.symbol].relation() if a.symbol in grown else model[a.symbol]
    start, added = {}, {p: Grown(Relation.empty(spark, kinds[p])) for p in group}
    for p in group:
        found = [delta[p].widened(kinds[p])] if p in delta else []
        for rule, k in uses:
            if rule.head.symbol == p:
                found.append(compile_rule(spark, rule, lambda i, a, k=k: delta[a.symbol] if i == k else now(a), k))
        if found:
            start[p] = materialized(without(union(found, kinds[p]), grown[p].relation()), "update")
    for p, rel in start.items():
        grown[p].add(rel)
        added[p].add(rel)
    _rounds(spark, program, group, kinds, model, grown, {p: start.get(p, Relation.empty(spark, kinds[p])) for p in group}, added)
    for p, more in added.items():
        rel = more.relation()
        if rel.n:
            delta[p] = rel


def _keep_outside(rules: list[Rule], group, model: dict[str, Relation]) -> None:
    """What the rules read from outside the group in every round becomes a literal, if it is small, or a stored table, if it is more
    than a scan: a view is then made once, not once a round."""
    for symbol in {a.symbol for r in rules for a in r.body} - set(group):
        rel = model[symbol]
        if rel.rows is not None or rel.n == 0:
            continue
        rows = few_rows(rel.df) if size_estimate(rel.df) <= LITERAL_BYTES * LITERAL_ROWS or costly(rel.df) else None
        if rows is not None:
            model[symbol] = replace(from_list(rel.df.sparkSession, rows, rel.kinds), repeats=rel.repeats)
        elif costly(rel.df):
            model[symbol] = Relation(stored(rel.df, "outside"), rel.kinds, rel.repeats)


def literal_only(rel: Relation) -> bool:
    return rel.n == 0 or rel.rows is not None or bool(rel.parts) and all(p.n == 0 or p.rows is not None for p in rel.parts)


def _rounds(spark, program, group, kinds, model, grown, delta, added=None, plain=None, edges=None) -> None:
    """Rounds until nothing new appears. delta: what the last round has found.

    plain: a rule that may take the place of the recursive ones once their rounds would make too many candidates.
    edges: what a closure is of, where it may then be made as a whole instead.
    """
    recursive = [(r, k) for p in group for r in program.rules_for(p) for k, a in enumerate(r.body) if a.sign and a.symbol in group]
    known, width = sum(r.n for r in delta.values()), None
    if added is not None and known:
        _keep_outside([r for r, _ in recursive], group, model)
    small = SmallRounds(spark)
    try:
        while changed := sum(r.n for r in delta.values()):
            if plain is not None and 2 * changed * known > MANY_CANDIDATES and known > changed:
                _keep_outside([plain], group, model)
                width = width or max(1, model[plain.body[1].symbol].df.select("c0").distinct().count())
                if 2 * changed * known / width > MANY_CANDIDATES:
                    small.use(False)
                    whole = None if edges is None else _closure(spark, program, group[0], kinds, edges, plain)
                    if whole is not None:
                        model[group[0]] = whole
                        return
                    recursive, plain = [(plain, 0)], None
            whole = {p: grown[p].relation() for p in group}
            outside = {a.symbol for r, _ in recursive for a in r.body} - set(group)
            small.use(changed * known <= FEW_PAIRS and all(literal_only(r) for r in (*delta.values(), *whole.values(), *(model[q] for q in outside))))
            found: dict[str, list[Relation]] = {}
            for rule, k in recursive:
                if not delta[rule.body[k].symbol].n:
                    continue

                def lookup(i, a, k=k):
                    if i == k:
                        return delta[a.symbol]
                    return whole[a.symbol] if a.symbol in whole else model[a.symbol]

                found.setdefault(rule.head.symbol, []).append(compile_rule(spark, rule, lookup, k))
            empty = lambda p: Relation.empty(spark, kinds[p])
            delta = {p: materialized(without(union(found[p], kinds[p]), whole[p]), "round", 2 * changed) if p in found else empty(p) for p in group}
            known += sum(r.n for r in delta.values())
            for p, rel in delta.items():
                grown[p].add(rel)
                if added is not None:
                    added[p].add(rel)
    finally:
        small.use(False)
    for p in group:
        model[p] = grown[p].relation()
