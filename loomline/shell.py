"""A small SQL shell: ``python -m loomline.shell [--database PATH]``."""

from __future__ import annotations

import os
import re
import sys
import time
from collections.abc import Callable, Iterator
from typing import TextIO

from pyspark.sql import SparkSession

from loomline.engine import Engine
from loomline.errors import ConstraintViolation
from loomline.plans import syntax as S
from loomline.plans.logical import format_plan
from loomline.plans.parser import parse
from loomline.render import EMPTY, FORMATS, format_rows

USAGE = "usage: loomline [--database PATH]"
#: Bytes of a script that .read takes.
SCRIPT_BYTES = 16 * 1024 * 1024

# What can hold a semicolon that ends no statement; an open construct runs to the end.
_PIECES = re.compile(r"""'(?:[^']|'')*(?P<q>'?)|"(?:[^"]|"")*(?P<d>"?)|--[^\n]*(?P<l>\n?)|/\*.*?(?P<b>\*/|\Z)|[();]""", re.DOTALL)


# Empty statements, and a statement that holds nothing in which a semicolon could hide.
_EMPTY = re.compile(r"(?:\s*+;)+")
_PLAIN = re.compile(r"""[^'"();/-]++;""")


def statements(text: str) -> Iterator[tuple[str, bool]]:
    """(statement, whether it is complete), cut at semicolons outside quotes, comments and parentheses; empty ones are left out."""
    start = 0
    while True:
        if m := _EMPTY.match(text, start):
            start = m.end()
        if m := _PLAIN.match(text, start):
            yield m[0], True
            start = m.end()
        elif (found := _next(text, start)) is not None:
            yield text[start : found[0]], found[1]
            start = found[0]
        else:
            return


def _next(text: str, start: int) -> tuple[int, bool] | None:
    """(end, whether it is complete) of the statement at ``start``, or None if there is none."""
    depth, complete = 0, True
    for m in _PIECES.finditer(text, start):
        piece = m[0]
        if piece == ";" and depth <= 0:
            return m.end(), True
        if piece in "()" and piece:
            depth += 1 if piece == "(" else -1
        elif piece != ";":
            closed = next((v for v in m.groupdict().values() if v is not None), "")
            complete = bool(closed)
    return (len(text), complete and depth <= 0) if text[start:].strip() else None


class _Leave(Exception):
    """.exit or .quit."""


class Shell:
    """Runs lines against an engine; results go to ``out`` and errors, a line each, to ``err``."""

    def __init__(self, engine: Engine, out: TextIO | None = None, err: TextIO | None = None):
        self.engine, self.out, self.err = engine, out or sys.stdout, err or sys.stderr
        self.timer, self.format, self.color = False, "table", False
        # name: (action, takes arguments, help)
        self.commands: dict[str, tuple[Callable[[list[str]], None], str]] = {
            "exit": (self._exit, "leave the shell"),
            "quit": (self._exit, "leave the shell"),
            "help": (self._help, "show this help"),
            "tables": (self._tables, "list tables"),
            "schema": (self._schema, "show CREATE TABLE <name>"),
            "read": (self._read, "execute a SQL file <path>"),
            "explain": (self._explain, "show query plan for <sql>"),
            "indexes": (self._indexes, "list unique keys [table]"),
            "stats": (self._stats, "show database statistics"),
            "timer": (self._timer, "toggle execution timing: .timer on|off"),
            "format": (self._format, "switch output format: .format table|csv|json"),
            "color": (self._color, "toggle color output: .color on|off"),
        }

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def complain(self, text: str) -> None:
        print(f"ERROR: {text}", file=self.err)

    def error(self, exc: Exception) -> None:
        detail = " ".join(str(exc).splitlines())
        self.complain(detail if isinstance(exc, ConstraintViolation) else f"{type(exc).__name__}: {detail}")

    def loop(self, source: TextIO) -> int:
        """Read statements until the end or .exit; a statement ends with a line that leaves nothing open."""
        held = ""
        for line in source:
            if not held and line.lstrip().startswith("."):
                try:
                    self.meta(line.strip())
                except _Leave:
                    return 0
                continue
            held += line
            if held.strip() and all(done for _, done in statements(held)):
                self.sql(held)
                held = ""
        if held.strip():
            self.sql(held)
        return 0

    def sql(self, text: str) -> None:
        """Run statements and show the last one's result."""
        began = time.perf_counter()
        try:
            rows = self.engine.execute(text)
            last = parse(text)[-1:]
            self.say((format_rows(rows, self.format) if rows else EMPTY) if last and isinstance(last[0], S.Select) else "OK")
        except Exception as exc:
            self.error(exc)
            return
        if self.timer:
            self.say(f"Time: {(time.perf_counter() - began) * 1000:.3f} ms")

    def meta(self, line: str) -> None:
        name, _, rest = line[1:].partition(" ")
        if name not in self.commands:
            self.complain(f"unknown command: .{name}")
            return
        self.commands[name][0](rest.split())

    def _argument(self, args: list[str], command: str) -> bool:
        if not args:
            self.complain(f"missing argument for .{command}")
        return bool(args)

    def _exit(self, args: list[str]) -> None:
        raise _Leave

    def _help(self, args: list[str]) -> None:
        self.say("Meta commands:")
        for name, (_, text) in self.commands.items():
            if name not in ("exit", "quit"):
                self.say(f"  .{name:<10} {text}")
        self.say("  .exit | .quit    leave the shell")

    def _tables(self, args: list[str]) -> None:
        for name in self.engine.tables:
            self.say(name)

    def _schema(self, args: list[str]) -> None:
        if self._argument(args, "schema"):
            columns = self.engine.columns(args[0])
            if columns is None:
                self.complain(f"no such table: {args[0]}")
            else:
                self.say(f"CREATE TABLE {args[0]}({', '.join(f'{c.name} {c.type.name}' for c in columns)});")

    def _read(self, args: list[str]) -> None:
        if not self._argument(args, "read"):
            return
        try:
            with open(args[0], "rb") as file:
                raw = file.read(SCRIPT_BYTES + 1)
            text = raw.decode("utf-8")
        except (OSError, UnicodeError):
            self.complain(f"cannot read file: {args[0]}")
            return
        if len(raw) > SCRIPT_BYTES:
            self.complain(f"file too large: {args[0]}")
            return
        for statement, _ in statements(text):
            if not statement.rstrip().endswith(";"):
                self.complain(f"unterminated statement at EOF in {args[0]}")
            elif statement.strip() != ";":
                self.sql(statement.strip())

    def _explain(self, args: list[str]) -> None:
        if self._argument(args, "explain"):
            try:
                plan = format_plan(self.engine.explain_plan(" ".join(args)))
            except Exception as exc:
                self.error(exc)
            else:
                self.say(f"Plan:\n{plan}")

    def _indexes(self, args: list[str]) -> None:
        for table in args[:1] or self.engine.tables:
            for c in self.engine.columns(table) or ():
                if c.primary_key or c.unique:
                    self.say(f"{table}.{c.name:<24} {'PRIMARY KEY' if c.primary_key else 'UNIQUE'}")

    def _stats(self, args: list[str]) -> None:
        names = self.engine.tables
        rows = sum(self.engine.execute(f"SELECT COUNT(*) FROM {name}")[0][0] for name in names)
        for label, value in (("Tables", len(names)), ("Rows", rows), ("Parts", self.engine.parts())):
            self.say(f"{label + ':':<11} {value}")

    def _switch(self, args: list[str], name: str) -> bool | None:
        if args[:1] not in (["on"], ["off"]):
            self.complain(f".{name} on|off")
            return None
        self.say(f"{name.capitalize()}: {args[0]}")
        return args[0] == "on"

    def _timer(self, args: list[str]) -> None:
        state = self._switch(args, "timer")
        self.timer = self.timer if state is None else state

    def _color(self, args: list[str]) -> None:
        state = self._switch(args, "color")
        self.color = self.color if state is None else state

    def _format(self, args: list[str]) -> None:
        if args[:1] and args[0] in FORMATS:
            self.format = args[0]
            self.say(f"Format: {self.format}")
        else:
            self.complain(f".format {'|'.join(FORMATS)}")


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    if args in (["--help"], ["-h"]):
        print(USAGE)
        return 0
    if args and (len(args) != 2 or args[0] != "--database"):
        print(f"ERROR: invalid argument: {args[0]}\n{USAGE}", file=sys.stderr)
        return 2
    warehouse = os.path.expanduser(args[1]) if args and args[1] != ":memory:" else None
    with Engine(SparkSession.builder.getOrCreate(), warehouse) as engine:
        print(".help for commands, .timer on for timing")
        return Shell(engine).loop(sys.stdin)


if __name__ == "__main__":
    sys.exit(main())
