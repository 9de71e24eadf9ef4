"""Tables as typed relations, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.types import SPARK_TYPES, RuleError, Schema


def relation_of(table: DataFrame, columns: Sequence, schema: Schema) -> DataFrame:
    """A table's columns (names or Column values) as a set relation.

    Integers of any width are int, 0/1 columns may be declared bool, timestamps and dates are int (micro-
    seconds and days since 1970). Rows with a null, NaN or infinity are no rows of a relation and refused
    at evaluation; -0.0 is 0.0. Only the named columns are read.
    """
    if len(columns) != len(schema.fields):
        raise RuleError(f"Expected {len(schema.fields)} columns, got {len(columns)}")
    picked = table.select(*((F.col(c) if isinstance(c, str) else c).alias(f) for c, f in zip(columns, schema.columns, strict=True)))
    out = []
    for f, kind in zip(schema.columns, schema.fields, strict=True):
        have, col = picked.schema[f].dataType, F.col(f)
        if kind == "int" and isinstance(have, T.TimestampType):
            col = F.unix_micros(col)
        elif kind == "int" and isinstance(have, T.DateType):
            col = F.unix_date(col)
        elif kind == "bool" and isinstance(have, T.IntegralType):
            col = F.when(col.isin(0, 1), col == 1)
        elif not (kind == "int" and isinstance(have, T.IntegralType) or have == SPARK_TYPES[kind] or kind == "double" and isinstance(have, T.FloatType)):
            raise RuleError(f"Column {f} is {have.simpleString()}, not {kind}")
        col = col.cast(SPARK_TYPES[kind])
        if kind == "double":
            col = F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col + F.lit(0.0))
        if picked.schema[f].nullable or kind in ("double", "bool"):
            col = F.coalesce(col, F.raise_error(F.lit(f"A {kind} field of a relation holds no value")).cast(SPARK_TYPES[kind]))
        out.append(col.alias(f))
    return picked.select(*out).distinct()


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any source Spark reads (parquet, orc, csv, json, jdbc, ...)."""
    return spark.read.format(format).options(**options).load(path) if path else spark.read.format(format).options(**options).load()


def write_relation(relation: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    relation.write.format(format).mode(mode).save(path)
