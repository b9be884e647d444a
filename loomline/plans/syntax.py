"""Statements and expressions as frozen records."""

from __future__ import annotations

from dataclasses import dataclass

from loomline.functions.types import SqlType


@dataclass(frozen=True)
class ColumnRef:
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Call:
    """An aggregate; ``arg`` None stands for ``*``."""

    func: str
    arg: ColumnRef | None

    def default_name(self) -> str:
        return self.func.lower() if self.arg is None else f"{self.func.lower()}_{self.arg.name}"


@dataclass(frozen=True)
class Compare:
    left: ColumnRef | Call
    op: str
    right: ColumnRef | Literal


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Negated:
    inner: object


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: SqlType
    nullable: bool = True
    unique: bool = False
    primary_key: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, object], ...]
    where: object | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None


@dataclass(frozen=True)
class Transaction:
    """BEGIN, COMMIT or ROLLBACK."""

    word: str


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None

    @property
    def source(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class JoinClause:
    kind: str
    right: TableRef
    on: object | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Item:
    value: ColumnRef | Call
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    """``items`` is empty for ``*``."""

    items: tuple[Item, ...]
    source: TableRef
    joins: tuple[JoinClause, ...] = ()
    where: object | None = None
    group_by: tuple[ColumnRef, ...] = ()
    having: object | None = None
    order_by: tuple[tuple[ColumnRef, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None
