"""Program-to-program rewrites for incremental maintenance."""

from __future__ import annotations

from dataclasses import replace

from cinderlog.plans.syntax import Atom, Program, Rule

DELTA, DELETE, REDERIVE = "Δ", "delete_", "rederive_"


def prefixed(atom: Atom, prefix: str) -> Atom:
    return replace(atom, symbol=prefix + atom.symbol)


def _one_at_a_time(rule: Rule, prefix: str, chosen) -> list[Rule]:
    """A copy of the rule for each chosen body atom, with that atom and the head prefixed."""
    head = prefixed(rule.head, prefix)
    return [
        Rule(head, tuple(prefixed(b, prefix) if i == k else b for i, b in enumerate(rule.body)))
        for k, atom in enumerate(rule.body)
        if chosen(atom)
    ]


def make_delta_program(program: Program, update: bool) -> Program:
    """Rules that derive new facts from new facts. With update, base relations change too."""
    heads, out = program.heads(), []
    for rule in program:
        variants = _one_at_a_time(rule, DELTA, lambda a: a.sign and (update or a.symbol in heads))
        out += variants or ([] if update else [Rule(prefixed(rule.head, DELTA), rule.body)])
    return Program(out)


def make_overdeletion_program(program: Program, delete: str = DELETE) -> Program:
    """Everything that has some derivation through a deleted fact."""
    return Program(v for rule in program for v in _one_at_a_time(rule, delete, lambda a: a.sign))


def make_rederivation_program(program: Program, delete: str = DELETE, rederive: str = REDERIVE) -> Program:
    """Overdeleted facts that still have another derivation."""
    return Program(
        Rule(prefixed(r.head, rederive), (prefixed(r.head, delete), *r.body)) for r in program
    )
