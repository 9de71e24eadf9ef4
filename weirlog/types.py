"""Field types, relation schemas and exact cell checks. Relations are finite sets of typed, non-null rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T


class RuleError(ValueError):
    """A program, transaction or request that is refused; nothing has changed."""


#: The four field types and their columns.
SPARK_TYPES: dict[str, T.DataType] = {"int": T.LongType(), "string": T.StringType(), "bool": T.BooleanType(), "double": T.DoubleType()}
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
#: Control characters that texts may hold; the others below space are refused.
PLAIN_CONTROLS = "\b\t\n\f\r"


@dataclass(frozen=True)
class Schema:
    """Who may write a relation (transactions if it is an input) and its field types in order."""

    input: bool
    fields: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.fields))]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, SPARK_TYPES[k], False) for c, k in zip(self.columns, self.fields, strict=True)])

    def to_json(self) -> dict:
        return {"input": self.input, "fields": list(self.fields)}


def schemas_of(given: Mapping[str, Any]) -> dict[str, Schema]:
    """Schemas from {name: {input, fields}} or from Schema values, checked, in order of names."""
    found = {}
    for name in sorted(given):
        one = given[name]
        if not isinstance(one, Schema):
            if not isinstance(one, Mapping) or set(one) != {"input", "fields"} or not isinstance(one["input"], bool) or not isinstance(one["fields"], list | tuple):
                raise RuleError(f"Schema of {name} must be an object of input and fields")
            one = Schema(one["input"], tuple(one["fields"]))
        if not NAME.fullmatch(name) or not one.fields:
            raise RuleError(f"Invalid relation name or zero arity: {name!r}")
        for kind in one.fields:
            if kind not in SPARK_TYPES:
                raise RuleError(f"Only int, string, bool and finite double fields are supported; {name} has {kind!r}")
        found[name] = one
    return found


def cell(value: Any, kind: str) -> Any:
    """The value as identity has it (zero has one sign), or RuleError; nothing is coerced."""
    if kind == "int":
        if type(value) is not int or not -(1 << 63) <= value < 1 << 63:
            raise RuleError(f"Expected signed 64-bit integer, got {value!r}")
    elif kind == "string":
        if type(value) is not str:
            raise RuleError(f"Expected string, got {value!r}")
        text_cell(value)
    elif kind == "bool":
        if type(value) is not bool:
            raise RuleError(f"Expected exact Bool, got {value!r}")
    elif kind == "double":
        if type(value) is not float or not math.isfinite(value):
            raise RuleError(f"Expected finite Float64, got {value!r}")
        return value + 0.0
    else:
        raise RuleError(f"Unsupported type {kind!r}")
    return value


def text_cell(value: str) -> str:
    if any(c < " " and c not in PLAIN_CONTROLS for c in value):
        raise RuleError(f"Unsupported control character in {value!r}")
    return value


def row(values: Iterable[Any], schema: Schema, relation: str) -> tuple:
    """A checked row."""
    values = list(values)
    if len(values) != len(schema.fields):
        raise RuleError(f"Arity mismatch for {relation}: expected {len(schema.fields)} fields {list(schema.fields)}, got {len(values)}")
    return tuple(cell(v, k) for v, k in zip(values, schema.fields, strict=True))
