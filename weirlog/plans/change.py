"""What changes in derived relations when the ones below them change; only that is computed and written.

Without recursion: the heads that a changed row could touch are collected first (each rule once for each place that
reads a changed relation). They are few if the change is small; the rules are then evaluated for these heads
alone, and what is true of them now is compared with what was.

With recursion rows are deleted and derived again: whatever rested on a row that went, step by step, goes; of it
comes back what the rest still derives; semi-naive rounds then add what new rows bring. Insertions alone delete
nothing, so they only continue the rounds.

A relation that an operator makes is computed anew and compared as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from weirlog.plans.check import Program
from weirlog.plans.compile import derived, empty
from weirlog.plans.fixpoint import evaluate, rounds, union
from weirlog.plans.parser import Atom, Clause, Comparison
from weirlog.sources.layers import without
from weirlog.sources.shared import materialise, written


@dataclass(frozen=True)
class Change:
    """Rows that came to a relation and rows that went, as tables with their paths; None where there is none."""

    come: DataFrame | None = None
    gone: DataFrame | None = None
    paths: tuple[str | None, str | None] = (None, None)

    @classmethod
    def of(cls, come: DataFrame, gone: DataFrame) -> Change:
        """Both written; empty ones told apart."""
        kept = [written(df, label) for df, label in ((come, "come"), (gone, "gone"))]
        kept = [(None, None) if df.isEmpty() else (df, path) for df, path in kept]
        return cls(kept[0][0], kept[1][0], (kept[0][1], kept[1][1]))

    def __bool__(self) -> bool:
        return self.come is not None or self.gone is not None

    @property
    def either(self) -> DataFrame:
        return union([x for x in (self.come, self.gone) if x is not None])


def touched(clause: Clause, at: int) -> Clause:
    """What may follow from rows of the atom at a place: that atom first, as a positive one, then the rest without its negated atoms."""
    first = replace(clause.body[at], negated=False)
    rest = [x for i, x in enumerate(clause.body) if i != at and not (isinstance(x, Atom) and x.negated)]
    bound = {v for x in (first, *rest) if isinstance(x, Atom) for v in x.variables}
    return replace(clause, body=(first, *(x for x in rest if not isinstance(x, Comparison) or bound.issuperset(x.variables))))


def places(clause: Clause, names) -> list[int]:
    return [i for i, x in enumerate(clause.body) if isinstance(x, Atom) and x.predicate in names]


def also(clause: Clause, atom: Atom) -> tuple[Clause, int]:
    """The clause with one more positive atom, and its place."""
    return replace(clause, body=(*clause.body, replace(atom, negated=False))), len(clause.body)


class Strata:
    """The changes of derived relations in the order of the program's strata. old and new: the rows of all relations before and, as far as known, after."""

    def __init__(self, spark: SparkSession, program: Program, old: Mapping[str, DataFrame], new: dict[str, DataFrame], changes: dict[str, Change]) -> None:
        self.spark, self.program, self.old, self.new, self.changes = spark, program, old, new, changes

    def _rows(self, clause: Clause, head: str, read, first: int | None = None) -> DataFrame:
        return derived(self.spark, clause, self.program.schemas[head], read, first)

    def _now(self, relation: str, few: DataFrame, read) -> list[DataFrame]:
        """What the rules derive of the given heads."""
        found = []
        for c in self.program.rules_of(relation):
            one, at = also(c, c.head)
            found.append(self._rows(one, relation, lambda i, a, at=at: few if i == at else read(a), at))
        return found

    def of(self, stratum: tuple[str, ...]) -> dict[str, Change]:
        if any(o.output in stratum for o in self.program.operators):
            return self._whole(stratum)
        return self._recursive(stratum) if self.program.recursive(stratum) else {stratum[0]: self._plain(stratum[0])}

    def _whole(self, stratum: tuple[str, ...]) -> dict[str, Change]:
        inputs = {r: self.new[r] for r in self.program.inputs}
        known = {r: df for r, df in self.new.items() if r not in inputs and r not in stratum}
        fresh = evaluate(self.spark, self.program, inputs, stratum, known, {*inputs, *known})
        found = {}
        for r in stratum:
            now = materialise(fresh[r], "fresh")
            found[r] = Change.of(without(now, self.old[r]), without(self.old[r], now))
        return found

    def _plain(self, relation: str) -> Change:
        def superset(a: Atom) -> DataFrame:
            come = self.changes[a.predicate].come if a.predicate in self.changes else None
            return self.old[a.predicate].union(come) if come is not None else self.old[a.predicate]

        parts = []
        for c in self.program.rules_of(relation):
            for at in places(c, self.changes):
                change = self.changes[c.body[at].predicate]
                parts.append(self._rows(touched(c, at), relation, lambda i, a, change=change: change.either if i == 0 else superset(a), 0))
        none = empty(self.spark, self.program.schemas[relation])
        if not parts:
            return Change()
        few = materialise(union(parts).distinct(), "touched")
        if few.isEmpty():
            return Change()
        now = materialise(union(self._now(relation, few, lambda a: self.new[a.predicate]) or [none]).distinct(), "now")
        was = materialise(self.old[relation].join(few, few.columns, "left_semi"), "was")
        return Change.of(without(now, was), without(was, now))

    def _recursive(self, stratum: tuple[str, ...]) -> dict[str, Change]:
        rules = [(r, c) for r in stratum for c in self.program.rules_of(r)]
        below = {r: x for r, x in self.changes.items() if r not in stratum}
        gone = self._resting(stratum, rules, below)
        rest = {r: without(self.old[r], gone[r]) if r in gone else self.old[r] for r in stratum}
        first: dict[str, list[DataFrame]] = {r: [] for r in stratum}

        def read(a: Atom) -> DataFrame:
            return rest[a.predicate] if a.predicate in stratum else self.new[a.predicate]

        for r, few in gone.items():
            first[r] += self._now(r, few, read)
        for r, c in rules:
            for at in places(c, below):
                atom = c.body[at]
                new = below[atom.predicate].gone if atom.negated else below[atom.predicate].come
                if new is not None:
                    one, place = also(c, atom)
                    first[r].append(self._rows(one, r, lambda i, a, place=place, new=new: new if i == place else read(a), place))
        relations = {r: df for r, df in self.new.items() if r not in stratum}
        added = rounds(self.spark, self.program, stratum, relations, rest, first)
        found = {}
        for r in stratum:
            none = empty(self.spark, self.program.schemas[r])
            come, went = union(added[r]) if added[r] else none, gone.get(r, none)
            found[r] = Change.of(without(come, went), without(went, come))
        return found

    def _resting(self, stratum: tuple[str, ...], rules: list[tuple[str, Clause]], below: Mapping[str, Change]) -> dict[str, DataFrame]:
        """The stratum's rows that some derivation lets rest on a row that went, or on the absence of one that came."""
        found: dict[str, list[DataFrame]] = {}
        parts: dict[str, list[DataFrame]] = {}
        for r, c in rules:
            for at in places(c, below):
                lost = below[c.body[at].predicate].come if c.body[at].negated else below[c.body[at].predicate].gone
                if lost is not None:
                    parts.setdefault(r, []).append(self._rows(touched(c, at), r, lambda i, a, lost=lost: lost if i == 0 else self.old[a.predicate], 0))
        while parts:
            frontier = {}
            for r, some in parts.items():
                rows = union(some).distinct()
                rows = rows.join(self.old[r].toDF(*rows.columns), rows.columns, "left_semi")
                if r in found:
                    rows = without(rows, union(found[r]))
                rows = materialise(rows, "resting")
                if not rows.isEmpty():
                    frontier[r] = rows
            parts = {}
            for r, rows in frontier.items():
                found.setdefault(r, []).append(rows)
            for r, c in rules:
                for at in places(c, frontier):
                    lost = frontier[c.body[at].predicate]
                    parts.setdefault(r, []).append(self._rows(touched(c, at), r, lambda i, a, lost=lost: lost if i == 0 else self.old[a.predicate], 0))
        return {r: materialise(union(some), "resting") for r, some in found.items()}
