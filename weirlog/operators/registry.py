"""Built-in operators that a program may name. Callers choose from these; they never bring code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.operators.components import connected_components
from weirlog.types import RuleError, Schema


@dataclass(frozen=True)
class LargeSmallStar:
    """Minimum-label connected components: vertices(int) and edges(int, int) give output(int, int)."""

    vertices: str
    edges: str
    output: str
    type: str = "large_small_star"

    @property
    def reads(self) -> tuple[str, ...]:
        return self.vertices, self.edges

    def check(self, schemas: Mapping[str, Schema]) -> None:
        for role, kinds in (("vertices", ("int",)), ("edges", ("int", "int")), ("output", ("int", "int"))):
            name = getattr(self, role)
            if name not in schemas or schemas[name].fields != kinds:
                raise RuleError(f"LargeSmallStar role {role} needs a declared relation of {list(kinds)}, got {name}")
        if schemas[self.output].input:
            raise RuleError(f"LargeSmallStar role output must be a derived relation, got {self.output}")

    def renamed(self, names) -> LargeSmallStar:
        return LargeSmallStar(names(self.vertices), names(self.edges), names(self.output))

    def run(self, relations: Mapping[str, DataFrame]) -> DataFrame:
        found = connected_components(relations[self.edges], relations[self.vertices])
        return found.select(F.col("vertex").alias("f0"), F.col("label").alias("f1"))

    def to_json(self) -> dict:
        return asdict(self)


Operator = LargeSmallStar
BUILT_IN = {"large_small_star": LargeSmallStar}


def operators_of(given: Iterable) -> tuple[Operator, ...]:
    """Operators from values or from {type, role: relation} objects."""
    found = []
    for one in given:
        if isinstance(one, Mapping):
            if one.get("type") not in BUILT_IN:
                raise RuleError(f"Unknown operator type {one.get('type')!r}")
            try:
                one = BUILT_IN[one["type"]](**{k: v for k, v in one.items() if k != "type"})
            except TypeError:
                raise RuleError(f"Operator {dict(one)} does not name exactly its roles") from None
        found.append(one)
    return tuple(found)
