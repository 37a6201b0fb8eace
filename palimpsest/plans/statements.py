"""Statements of the SQL subset."""

from __future__ import annotations

from dataclasses import dataclass, field

from palimpsest.catalog import Column

Literal = int | str


def type_of(value: Literal) -> str:
    return "INT" if isinstance(value, int) else "TEXT"


@dataclass(frozen=True)
class Comparison:
    column: str
    op: str
    literal: Literal


@dataclass
class CreateTable:
    table: str
    columns: list[Column]


@dataclass
class DropTable:
    table: str


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Literal]]


@dataclass
class Select:
    table: str
    columns: list[str]  # empty: all
    where: list[Comparison] = field(default_factory=list)


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Literal]]
    where: list[Comparison] = field(default_factory=list)


@dataclass
class Delete:
    table: str
    where: list[Comparison] = field(default_factory=list)


Statement = CreateTable | DropTable | Insert | Select | Update | Delete
