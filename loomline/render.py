"""Result rows as text: table, CSV or JSON."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence

from loomline.engine import ResultRow

#: Characters of a table cell before it is cut short.
WIDEST = 30
FORMATS = ("table", "csv", "json")
EMPTY = "(no rows)"


def _table(columns: Sequence[str], rows: list[list[str]]) -> str:
    def short(text: str) -> str:
        return text if len(text) <= WIDEST else text[: WIDEST - 1] + "…"

    grid = [[short(cell) for cell in row] for row in ([*columns], *rows)]
    widths = [max(map(len, column)) for column in zip(*grid)]
    lines = [" | ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip() for row in grid]
    lines.insert(1, " | ".join("---" for _ in columns))
    return "\n".join(lines)


def format_rows(rows: Sequence[ResultRow], fmt: str) -> str:
    """The rows in one of ``FORMATS``; no rows are ``(no rows)`` in each."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}; expected one of {FORMATS}")
    if not rows:
        return EMPTY
    columns = rows[0].columns
    if fmt == "table":
        return _table(columns, [[str(v) for v in row] for row in rows])
    if fmt == "json":
        return json.dumps([dict(zip(columns, row)) for row in rows], ensure_ascii=False, default=str)
    out = io.StringIO()
    csv.writer(out).writerows([columns, *(tuple(row) for row in rows)])
    return out.getvalue().rstrip("\n")
