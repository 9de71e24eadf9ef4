"""From a checked clause to a DataFrame.

Relations have columns f0, f1, ...; inside a body every variable X is a column v_X. Atoms become filtered
selections, bodies become inner joins in an order that always shares a variable if one can be shared,
atoms that export nothing become semi-joins, negated atoms anti-joins. Catalyst does the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.plans.parser import Atom, Clause, Comparison, Constant, Term, Variable
from weirlog.types import SPARK_TYPES, Schema

#: The relation that the atom at a place of the body reads.
Reader = Callable[[int, Atom], DataFrame]
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "\\=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "=<": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def empty(spark: SparkSession, schema: Schema) -> DataFrame:
    return spark.createDataFrame([], schema.struct)


def literal(constant: Constant) -> Column:
    return F.lit(constant.value).cast(SPARK_TYPES[constant.kind])


def term_column(term: Term) -> Column:
    return literal(term) if isinstance(term, Constant) else F.col(f"v_{term.name}")


def selected(relation: DataFrame, atom: Atom) -> DataFrame:
    """The atom's bindings: constants and repeated variables are filters, wildcards are dropped."""
    fresh = relation.toDF(*(f"c{i}" for i in range(len(atom.terms))))
    first: dict[str, str] = {}
    for i, term in enumerate(atom.terms):
        if isinstance(term, Constant):
            fresh = fresh.where(F.col(f"c{i}") == literal(term))
        elif isinstance(term, Variable):
            if term.name in first:
                fresh = fresh.where(F.col(f"c{i}") == F.col(first[term.name]))
            first.setdefault(term.name, f"c{i}")
    return fresh.select(*(F.col(c).alias(f"v_{v}") for v, c in first.items()))


def _is_true_if_any(df: DataFrame) -> DataFrame:
    return df.select(F.lit(True).alias("any")).limit(1)


class Body:
    """The growing join of a clause's body."""

    def __init__(self, spark: SparkSession, clause: Clause, kept: Iterable[str]) -> None:
        self.df: DataFrame | None = None
        self.bound: set[str] = set()
        self.waiting = [x for x in clause.body if isinstance(x, Comparison)]
        self.kept, self.spark = set(kept), spark

    def compare(self) -> None:
        """Applies the comparisons whose variables are bound."""
        for c in [c for c in self.waiting if self.bound.issuperset(c.variables)]:
            self.df = self.df.where(COMPARE[c.operator](term_column(c.left), term_column(c.right)))
            self.waiting.remove(c)

    def add(self, atom: Atom, relation: DataFrame, later: set[str]) -> None:
        """Joins an atom; later holds the variables that are still needed after it."""
        side, own = selected(relation, atom), set(atom.variables)
        if self.df is None:
            self.df = side
        else:
            shared = [f"v_{v}" for v in atom.variables if v in self.bound]
            exports = (own - self.bound) & later
            if not exports:
                if shared:
                    self.df = self.df.join(side.select(*shared), shared, "left_semi")
                else:
                    self.df = self.df.crossJoin(_is_true_if_any(side)).drop("any")
                own = own & self.bound
            elif shared:
                self.df = self.df.join(side.select(*shared, *(f"v_{v}" for v in sorted(exports))), shared)
                own = exports
            else:
                self.df = self.df.crossJoin(side.select(*(f"v_{v}" for v in sorted(exports))))
                own = exports
        self.bound |= own
        self.compare()

    def exclude(self, atom: Atom, relation: DataFrame) -> None:
        """Keeps the bindings for which the negated atom has no row."""
        side, on = selected(relation, atom), [f"v_{v}" for v in atom.variables]
        if on:
            self.df = self.df.join(side.select(*on), on, "left_anti")
        else:
            self.df = self.df.withColumn("any", F.lit(True)).join(_is_true_if_any(side), "any", "left_anti").drop("any")


def join_order(atoms: list[tuple[int, Atom]], first: int | None = None) -> list[tuple[int, Atom]]:
    """Atoms so that each shares a variable with those before it, if any can; constants first, else as written."""
    left, bound, order = list(atoms), set(), []
    while left:

        def worth(x: tuple[int, Atom]) -> tuple:
            own = set(x[1].variables)
            constants = sum(isinstance(t, Constant) for t in x[1].terms)
            return (x[0] != first if not order else False, not own & bound if order else False, -len(own & bound), -constants, x[0])

        best = min(left, key=worth)
        left.remove(best)
        order.append(best)
        bound |= set(best[1].variables)
    return order


def bindings(spark: SparkSession, clause: Clause, read: Reader, kept: Iterable[str], first: int | None = None) -> DataFrame:
    """The kept variables' bindings that satisfy the body, columns in the order given; not made distinct."""
    kept = list(kept)
    body = Body(spark, clause, kept)
    negated = [(i, a) for i, a in enumerate(clause.body) if isinstance(a, Atom) and a.negated]
    order = join_order([(i, a) for i, a in enumerate(clause.body) if isinstance(a, Atom) and not a.negated], first)
    for at, (i, atom) in enumerate(order):
        later = set(kept).union(*(set(a.variables) for _, a in order[at + 1 :]), *(set(a.variables) for _, a in negated), *(set(c.variables) for c in body.waiting))
        body.add(atom, read(i, atom), later)
    for i, atom in negated:
        body.exclude(atom, read(i, atom))
    return body.df.select(*(f"v_{v}" for v in kept))


def head(clause: Clause, schema: Schema, found: DataFrame) -> DataFrame:
    return found.select(*(term_column(t).cast(SPARK_TYPES[k]).alias(c) for t, k, c in zip(clause.head.terms, schema.fields, schema.columns, strict=True)))


def derived(spark: SparkSession, clause: Clause, schema: Schema, read: Reader, first: int | None = None) -> DataFrame:
    """The clause's head rows, with repetitions."""
    return head(clause, schema, bindings(spark, clause, read, clause.head.variables, first))


def evidence(spark: SparkSession, clause: Clause, read: Reader) -> DataFrame:
    """The distinct bindings of all variables of the clause's positive atoms, columns by variable name, sorted."""
    names = sorted({v for a in clause.body if isinstance(a, Atom) and not a.negated for v in a.variables})
    return bindings(spark, clause, read, names).toDF(*names).distinct()
