"""A relation as a table and the few rows that differ from it, so that a small change writes a small table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from weirlog.sources.shared import written

#: The share of the base, and the least number of rows, beyond which what differs is written into a new base.
SHARE, LEAST = 4, 1000


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.toDF(*rows.columns), rows.columns, "left_anti")


@dataclass(frozen=True)
class Layers:
    """The rows of base but those of minus, and those of plus. Plus holds no row of base, minus only rows of it."""

    base: DataFrame
    plus: DataFrame | None = None
    minus: DataFrame | None = None
    n_base: int = 0
    n_other: int = 0
    paths: tuple[str, ...] = ()  # base, and then what else was written

    @classmethod
    def of(cls, base: DataFrame, path: str | None = None) -> Layers:
        return cls(base, n_base=base.count(), paths=(path,) if path else ())

    @property
    def rows(self) -> DataFrame:
        found = without(self.base, self.minus) if self.minus is not None else self.base
        return found.union(self.plus) if self.plus is not None else found

    def changed(self, come: DataFrame | None, gone: DataFrame | None, paths: tuple[str | None, str | None], label: str) -> Layers:
        """come holds no row that is there, gone only rows that are; both are tables (of these paths) or None."""
        n = self.n_other + sum(df.count() for df in (come, gone) if df is not None)
        if not self.n_base and not self.n_other:
            return Layers(come, n_base=n, paths=paths[:1])
        plus, minus = come, gone
        if self.minus is not None or self.plus is not None:
            none = self.base.limit(0)
            old_plus, old_minus, plus, minus = (none if x is None else x for x in (self.plus, self.minus, come, gone))
            plus, minus = without(old_plus, minus).union(without(plus, old_minus)), without(minus, old_plus).union(without(old_minus, plus))
            plus, minus = (self._small(x, label) for x in (plus, minus))
            plus, minus, paths = plus[0], minus[0], (plus[1], minus[1])
        made = Layers(self.base, plus, minus, self.n_base, n, (*self.paths[:1], *(p for p in paths if p)))
        return Layers.of(*written(made.rows, label)) if n > max(LEAST, self.n_base // SHARE) else made

    def _small(self, df: DataFrame, label: str) -> tuple[DataFrame | None, str | None]:
        table, path = written(df, label)
        return (None, None) if table.isEmpty() else (table, path)
