"""The engine's front: insert facts, poll, query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.scratch import LITERAL_ROWS
from cinderlog.functions.values import equal, plain
from cinderlog.operators.compile import select_pattern, without
from cinderlog.operators.fixpoint import goal_directed, solve
from cinderlog.operators.relation import UNIT, Grown, Relation, common_kinds, materialized, union
from cinderlog.plans.analysis import check_arity, check_safety, check_stratified, reachable
from cinderlog.plans.magic import adorned, magic_transformation, seed_fact, unused_mark
from cinderlog.plans.syntax import Atom, Const, Program, Query, Rule, Var, check_value, parse_program, parse_query
from cinderlog.plans.transforms import make_overdeletion_program, make_rederivation_program

STALE = "poll needed to obtain correct results"


class Runtime:
    """A program with its facts. Facts become visible to queries by poll()."""

    def __init__(self, spark: SparkSession, program: Program | str):
        self.spark = spark
        self.program = parse_program(program) if isinstance(program, str) else program
        check_safety(self.program)
        check_stratified(self.program)
        self.arity = check_arity(self.program)
        self.base: dict[str, Relation] = {}  # given facts that have been polled
        self.model: dict[str, Relation] = {}
        self.rows: dict[str, dict[tuple, None]] = {}  # staged facts
        self.frames: dict[str, list[Relation]] = {}
        self.polled = False

    # -- facts ---------------------------------------------------------------------------------------------
    def _check(self, relation: str, n: int) -> None:
        if self.arity.setdefault(relation, n) != n:
            raise ValueError(f"{relation} has {self.arity[relation]} columns, not {n}")

    def insert(self, relation: str, fact) -> bool:
        """Stages a fact; whether it is new among the staged ones."""
        fact = tuple(check_value(v) for v in (fact if isinstance(fact, (tuple, list)) else (fact,)))
        self._check(relation, len(fact))
        staged = self.rows.setdefault(relation, {})
        key = tuple((type(v), v) for v in fact)
        new = key not in staged
        staged[key] = None
        return new

    def insert_all(self, relation: str, facts) -> None:
        for fact in facts:
            self.insert(relation, fact)

    def insert_df(self, relation: str, df: DataFrame) -> None:
        """Stages all rows of a DataFrame; columns count by position."""
        self._check(relation, len(df.columns))
        self.frames.setdefault(relation, []).append(Relation.from_df(df))

    def delete(self, relation: str, fact) -> None:
        """Takes a given fact back; what only followed from it goes, too. Facts must have been polled."""
        fact = tuple(check_value(v) for v in (fact if isinstance(fact, (tuple, list)) else (fact,)))
        self._check(relation, len(fact))
        self.delete_relation(relation, Relation.from_rows(self.spark, [fact], len(fact)))

    def delete_df(self, relation: str, df: DataFrame) -> None:
        """As delete(), for all rows of a DataFrame."""
        self._check(relation, len(df.columns))
        self.delete_relation(relation, Relation.from_df(df))

    def delete_relation(self, relation: str, facts: Relation) -> None:
        """Deletes everything with a derivation from the facts, then derives again what has another (programs with negation: all anew)."""
        if not self.safe():
            raise RuntimeError(STALE)
        if relation not in self.base:
            return
        held = self.base[relation]
        cond = [equal(F.col(f"d{i}"), k, F.col(c), w) for i, (k, c, w) in enumerate(zip(facts.kinds, held.columns, held.kinds))] or [F.lit(True)]
        drop = facts.df.toDF(*(f"d{i}" for i in range(max(1, len(facts.kinds)))))
        gone = materialized(Relation(held.df.join(drop, cond, "left_semi").distinct(), held.kinds), "gone")
        if not gone.n:
            return
        rest = materialized(Relation(without(held, gone).df, held.kinds), "base", LITERAL_ROWS if held.n is None else held.n)
        self.base = self.base | {relation: rest}
        if any(not a.sign for r in self.program for a in r.body):
            self.model = solve(self.spark, self.program, self.base)
            return
        mark, heads = unused_mark([*self.base, *self.model]), self.program.heads()
        delete, again = f"delete{mark}", f"again{mark}"
        found = solve(self.spark, make_overdeletion_program(self.program, delete), self.model | {delete + relation: gone})
        over = {p: materialized(found[delete + p], "over") for p in {*heads, relation} if delete + p in found}
        left = dict(self.model)
        for p, rel in over.items():  # given facts stay, whatever else they follow from
            kept = [without(left[p], rel)] + ([self.base[p]] if p in self.base else [])
            left[p] = materialized(Relation(union(kept, left[p].kinds).df.distinct(), left[p].kinds), "left", LITERAL_ROWS if left[p].n is None else left[p].n)
        rules = [r for r in make_rederivation_program(self.program, delete, again) if r.head.symbol.removeprefix(again) in over]
        columns = lambda p: tuple(Var(f"x{i}") for i in range(self.arity[p]))
        back = [Rule(Atom(p, columns(p)), (Atom(again + p, columns(p)),)) for p in over if p in heads]
        model = solve(self.spark, Program([*rules, *back]), left | {delete + p: r for p, r in over.items()})
        self.model = {p: model[p] for p in left}

    def safe(self) -> bool:
        return not any(self.rows.values()) and not self.frames

    def _staged(self) -> dict[str, Relation]:
        out: dict[str, list[Relation]] = {p: list(frames) for p, frames in self.frames.items()}
        for p, staged in self.rows.items():
            if staged:
                rows = [tuple(v for _, v in key) for key in staged]
                out.setdefault(p, []).append(Relation.from_rows(self.spark, rows, self.arity[p]))
        return {p: parts[0] if len(parts) == 1 else Relation(union(parts).df, common_kinds(parts), True) for p, parts in out.items()}

    def poll(self) -> None:
        """Takes in the staged facts and derives all that follows.

        What a poll adds to a relation becomes a part of it, a literal if it is small; parts are merged, so plans don't grow with the
        number of polls.
        """
        if self.polled and self.safe():
            return
        staged, base = self._staged(), dict(self.base)
        negated = any(not a.sign for r in self.program for a in r.body)
        kinds = {p: common_kinds([base[p], rel]) if p in base else rel.kinds for p, rel in staged.items()}
        same_kinds = all(p not in self.model or kinds[p] == self.model[p].kinds for p in staged)
        update = self.polled and not negated and same_kinds
        new: dict[str, Relation] = {}
        for p, rel in staged.items():
            if p not in base:
                base[p] = rel
                if update:
                    new[p] = materialized(without(rel, self.model[p]) if p in self.model else rel.as_set(), "new")
                continue
            given = without(rel.widened(kinds[p]), base[p].widened(kinds[p]))
            added = materialized(given, "new")
            grown = Grown(base[p].widened(kinds[p]))
            grown.add(added)
            base[p] = grown.relation()
            if update:
                derived = p in self.program.heads() and p in self.model and added.n
                new[p] = materialized(without(added, self.model[p]), "new") if derived else added
        if update:
            model = solve(self.spark, self.program, base, known=self.model, new=new)
        else:
            model = solve(self.spark, self.program, base)
        self.rows, self.frames = {}, {}
        self.base, self.model, self.polled = base, model, True

    # -- queries -------------------------------------------------------------------------------------------
    def relation(self, name: str) -> Relation:
        if name not in self.model:
            if name in self.arity:
                return Relation.from_rows(self.spark, [], self.arity[name])
            raise KeyError(name)
        return self.model[name]

    def df(self, relation: str) -> DataFrame:
        """A whole relation."""
        if not self.safe():
            raise RuntimeError(STALE)
        return self.relation(relation).as_set().df

    def query(self, query: Query | str) -> DataFrame:
        query = parse_query(query) if isinstance(query, str) else query
        if not self.safe():
            raise RuntimeError(STALE)
        rel = self.relation(query.symbol)
        return Relation(select_pattern(rel, query.matchers), rel.kinds, rel.repeats).as_set().df

    def contains(self, relation: str, fact) -> bool:
        if not self.safe():
            raise RuntimeError(STALE)
        fact = tuple(fact) if isinstance(fact, (tuple, list)) else (fact,)
        if relation not in self.model or len(fact) != len(self.model[relation].kinds):
            return False
        return not select_pattern(self.model[relation], tuple(map(Const, fact))).isEmpty()

    def facts(self, query: Query | str) -> set[tuple]:
        """The answers as Python tuples."""
        return collect(self.query(query))

    def query_program(self, query: Query | str, program: Program | str | None = None, strategy: str = "Bottom-up") -> DataFrame:
        """Answers a query over the facts inserted so far, staged ones included, deriving only what it needs.

        Neither the caller's model nor its staged facts change; strategy has no effect. Names of rewritten predicates hold a mark that
        no given name has, so facts of any other relation can't enter.
        """
        query = parse_query(query) if isinstance(query, str) else query
        program = self.program if program is None else parse_program(program) if isinstance(program, str) else program
        check_safety(program)
        check_stratified(program)
        facts = dict(self.base)
        for p, rel in self._staged().items():
            facts[p] = Relation(union([facts[p], rel]).df, common_kinds([facts[p], rel]), True) if p in facts else rel
        if query.symbol not in program.heads():
            if query.symbol not in facts:
                raise KeyError(query.symbol)
            return select_pattern(facts[query.symbol].as_set(), query.matchers)
        n = len(program.rules_for(query.symbol)[0].head.terms)
        query = Query(query.symbol, (query.matchers + (None,) * n)[:n])
        if "b" not in query.pattern():  # nothing to restrict by
            needed = reachable(program, {query.symbol})
            model = solve(self.spark, Program(r for r in program if r.head.symbol in needed), facts)
            return model[query.symbol].df
        given = [p for p in program.heads() if p in facts]
        if query.symbol not in given:
            program = goal_directed(program, query.symbol, query.pattern())
        mark = unused_mark([*facts, *(a.symbol for r in program for a in (r.head, *r.body))])
        if given:  # facts of derived predicates enter by a rule
            extra = [Rule(Atom(p, vs), (Atom(f"{p}{mark}facts", vs),)) for p in given for vs in [tuple(Var(f"x{i}") for i in range(len(facts[p].kinds)))]]
            program = Program([*program, *extra])
            facts = {f"{p}{mark}facts" if p in given else p: r for p, r in facts.items()}
        rewritten = magic_transformation(program, query, mark)
        name, values = seed_fact(query, mark)
        facts[name] = Relation.from_rows(self.spark, [values], len(values))
        answer = adorned(query.symbol, query.pattern(), mark)
        needed = reachable(rewritten, {answer})
        model = solve(self.spark, Program(r for r in rewritten if r.head.symbol in needed), {p: r for p, r in facts.items() if p in needed})
        return select_pattern(model[answer], query.matchers)


def collect(df: DataFrame) -> set[tuple]:
    if df.columns == [UNIT]:
        return {()} if df.head(1) else set()
    return {tuple(plain(v) for v in row) for row in df.collect()}


__all__ = ["Runtime", "STALE", "collect"]
