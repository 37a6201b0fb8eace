"""Statements to DataFrame plans: only column expressions, so Catalyst prunes and pushes down."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import TableSchema
from palimpsest.plans.statements import Comparison, Literal, Update

_OPERATORS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def literal(value: Literal) -> Column:
    return F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)


def condition(where: list[Comparison]) -> Column | None:
    """The conjunction of all comparisons."""
    parts = [_OPERATORS[p.op](F.col(f"`{p.column}`"), literal(p.literal)) for p in where]
    return reduce(operator.and_, parts) if parts else None


def filtered(rows: DataFrame, where: list[Comparison]) -> DataFrame:
    found = condition(where)
    return rows if found is None else rows.filter(found)


def select(rows: DataFrame, schema: TableSchema, columns: list[str], where: list[Comparison], ordered: bool = True) -> DataFrame:
    """Matching rows; in key order when the result is shown, not when it feeds another plan."""
    found = filtered(rows, where)
    if ordered:
        found = found.orderBy(schema.key.name)
    return found.select(*[F.col(f"`{c}`") for c in columns])


def updated(rows: DataFrame, schema: TableSchema, sets: dict[str, Literal], statement: Update) -> DataFrame:
    found = filtered(rows, statement.where)
    return found.select(*[literal(sets[c]).alias(c) if c in sets else F.col(f"`{c}`") for c in schema.names])
