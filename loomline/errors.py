"""The error hierarchy.  Type mismatches raise the built-in ``TypeError``."""

from __future__ import annotations

from collections.abc import Sequence


class LoomlineError(Exception):
    """Base of all errors of this library."""


class PositionedError(LoomlineError):
    def __init__(self, line: int, col: int, msg: str):
        super().__init__(f"line {line}, col {col}: {msg}")
        self.line, self.col, self.msg = line, col, msg


class TokenError(PositionedError):
    """A text that is no sequence of tokens."""


class ParseError(PositionedError):
    """Tokens that are no statement."""


class ExecutionError(LoomlineError):
    """A statement that cannot be carried out."""


class CodecError(TypeError, ValueError, OverflowError):
    """A value outside its column's type."""


class ConstraintViolation(ExecutionError):
    """``kind`` is 'null' (with ``column``), 'unique' or 'duplicate_pk' (with ``columns``)."""

    def __init__(self, kind: str, column: str | None = None, columns: Sequence[str] | None = None, value: object = None):
        self.kind, self.column, self.columns, self.value = kind, column, columns, value
        where = f"column={column!r}" if columns is None else f"columns={list(columns)!r}"
        super().__init__(f"ConstraintViolation(kind={kind!r}, {where}, value={value!r})")


class ResolutionError(ExecutionError):
    """A name that does not lead to one table or column."""


class UnknownSource(ResolutionError):
    def __init__(self, name: str):
        super().__init__(f"unknown table or alias: {name!r}")


class UnknownQualifiedColumn(ResolutionError):
    def __init__(self, qualifier: str, column: str):
        super().__init__(f"unknown column {column!r} in source {qualifier!r}")


class AmbiguousColumn(ResolutionError):
    def __init__(self, column: str, sources: Sequence[str]):
        super().__init__(f"ambiguous column {column!r} in sources {tuple(sources)!r}")


class DuplicateAlias(ResolutionError):
    def __init__(self, alias: str, first: str, second: str):
        super().__init__(f"duplicate alias {alias!r}: {first!r} vs {second!r}")


class MissingUsingKey(ResolutionError):
    def __init__(self, column: str, side: str):
        super().__init__(f"USING column {column!r} missing from {side!r} source")


class IncompatibleKeyTypes(ResolutionError):
    def __init__(self, left: str, right: str):
        super().__init__(f"incompatible USING/NATURAL key types: {left!r} vs {right!r}")


class DatabaseLocked(ExecutionError):
    def __init__(self, path: str):
        super().__init__(f"database {path!r} is locked by another process")
        self.path = path


class CatalogCorrupt(LoomlineError):
    """A manifest that cannot be read."""


class SchemaMismatch(LoomlineError):
    """A manifest of another format version."""
