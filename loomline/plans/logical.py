"""The plan tree: seven nodes, built left-deep in the written order of joins, and its text."""

from __future__ import annotations

from dataclasses import dataclass

from loomline.functions.types import SqlType


@dataclass(frozen=True)
class Field:
    """A column with an identity of its own, so that equal names never meet in a DataFrame.

    ``source`` is None for a merged join key and for an aggregate; hidden fields are reached by
    qualified names only.
    """

    id: str
    name: str
    source: str | None
    type: SqlType
    hidden: bool = False


@dataclass(frozen=True)
class Scan:
    table: str
    alias: str | None
    source: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Join:
    """``keys`` are (left, right, merged) fields of USING or NATURAL; ``condition`` is that of ON."""

    kind: str
    left: object
    right: Scan
    keys: tuple[tuple[Field, Field, Field], ...]
    condition: object | None
    natural: bool


@dataclass(frozen=True)
class Filter:
    source: object
    predicate: object


@dataclass(frozen=True)
class Aggregate:
    """``calls`` are (function, argument or None, result)."""

    source: object
    groups: tuple[Field, ...]
    calls: tuple[tuple[str, Field | None, Field], ...]
    having: object | None


@dataclass(frozen=True)
class Sort:
    """``keys`` are (field, descending); ``places`` says the same by position."""

    source: object
    keys: tuple[tuple[Field, bool], ...]
    places: tuple[tuple[int, bool], ...]


@dataclass(frozen=True)
class Limit:
    source: object
    limit: int | None
    offset: int | None


@dataclass(frozen=True)
class Project:
    """``items`` are (label, field)."""

    source: object
    items: tuple[tuple[str, Field], ...]
    star: bool


LogicalPlan = Scan | Join | Filter | Aggregate | Sort | Limit | Project


def _headline(node: LogicalPlan) -> str:
    match node:
        case Scan(table, alias, _, fields):
            return f"Scan({table}{f' AS {alias}' if alias else ''}, schema={tuple(f.name for f in fields)})"
        case Join(kind, _, _, keys, _, natural):
            return f"Join({kind}, keys={len(keys)}{', natural' if natural else ''})"
        case Aggregate(_, groups, calls, _):
            return f"Aggregate(groups={len(groups)}, funcs={len(calls)})"
        case Sort(_, _, places):
            return f"Sort(keys={places})"
        case Limit(_, limit, offset):
            return f"Limit(limit={limit}, offset={offset})"
        case Project(_, items, star):
            return f"Project(items={1 if star else len(items)}{', star' if star else ''})"
        case _:
            return type(node).__name__


def inputs(node: LogicalPlan) -> tuple:
    if isinstance(node, Join):
        return node.left, node.right
    return () if isinstance(node, Scan) else (node.source,)


def format_plan(plan: LogicalPlan) -> str:
    """The plan as text, a node a line, each below its consumer and indented by three spaces more."""
    lines, todo = [], [(plan, 0)]
    while todo:
        node, depth = todo.pop()
        lines.append("   " * depth + _headline(node))
        todo += [(child, depth + 1) for child in reversed(inputs(node))]
    return "\n".join(lines)
