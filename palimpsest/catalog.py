"""Table schemas: 64-bit INT and TEXT columns, no nulls, one primary key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {"INT": T.LongType(), "TEXT": T.StringType()}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    primary_key: bool = False


@dataclass(frozen=True)
class TableSchema:
    id: int
    name: str
    columns: tuple[Column, ...]

    @property
    def key(self) -> Column:
        return next(c for c in self.columns if c.primary_key)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def find(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type], False, {"primary_key": c.primary_key}) for c in self.columns])

    def to_json(self) -> dict:
        return {"id": self.id, "name": self.name, "columns": [[c.name, c.type, c.primary_key] for c in self.columns]}

    @classmethod
    def from_json(cls, data: dict) -> TableSchema:
        return cls(data["id"], data["name"], tuple(Column(*c) for c in data["columns"]))

    @classmethod
    def from_struct(cls, table_id: int, name: str, struct: T.StructType, key: str) -> TableSchema:
        kinds = {"bigint": "INT", "string": "TEXT"}
        return cls(table_id, name, tuple(Column(f.name, kinds[f.dataType.simpleString()], f.name == key) for f in struct))
