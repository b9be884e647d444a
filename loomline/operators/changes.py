"""INSERT, UPDATE and DELETE as new snapshots, with the constraints checked before they are published."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline import errors
from loomline.functions.types import literal_type
from loomline.operators.lowering import predicate
from loomline.plans import logical as L
from loomline.plans import syntax as S
from loomline.plans.resolver import Scope, over
from loomline.sources.store import SMALL, Store, Table

#: Keys of a statement that are looked for by a filter; more go by a join.
FEW = 50


def unique_groups(table: Table) -> list[tuple[str, tuple[int, ...]]]:
    """(kind, columns): the primary key, all its columns together, then each UNIQUE column."""
    key = tuple(i for i, c in enumerate(table.columns) if c.primary_key)
    return [("duplicate_pk", key)] * bool(key) + [("unique", (i,)) for i, c in enumerate(table.columns) if c.unique]


def _violation(table: Table, kind: str, group: tuple[int, ...], key: tuple) -> errors.ConstraintViolation:
    shown = tuple(table.columns[i].type.shown(v) for i, v in zip(group, key))
    return errors.ConstraintViolation(kind, columns=[table.columns[i].name for i in group], value=shown)


def _writable(table: Table) -> None:
    if table.external is not None:
        raise errors.ExecutionError(f"table {table.name!r} is external and cannot be changed")


def _taken(store: Store, table: Table, group: tuple[int, ...], keys: set[tuple]) -> set[tuple]:
    """Which of the new keys the table already has.

    Keys of the tail and of small parts are looked up on the driver, which keeps a bounded number of
    them.  In large parts the statement's own keys are the small side, as its text is: few of them are a
    filter that prunes row groups by statistics and Bloom filters, many are a semi-join.
    """
    found = {tuple(row[i] for i in group) for row in table.tail} & keys
    large = []
    for part in table.parts if keys else ():
        if part.rows <= SMALL:
            found |= store.keys(part, group) & keys
        else:
            large.append(part.path)
    if large:
        names = [f"c{i}" for i in group]
        stored = store.spark.read.schema(table.schema).parquet(*large).select(*names)
        if len(keys) <= FEW:
            kinds = [table.schema[i].dataType for i in group]
            same = [reduce(and_, (F.col(n) == F.lit(v).cast(t) for n, v, t in zip(names, key, kinds))) for key in keys]
            hits = stored.where(reduce(or_, same))
        else:
            asked = store.spark.createDataFrame([*keys], T.StructType([table.schema[i] for i in group]), verifySchema=False)
            hits = stored.join(F.broadcast(asked), names, "left_semi")
        found |= {tuple(row) for row in hits.distinct().collect()}
    return found


def insert(store: Store, table: Table, statement: S.Insert) -> Table:
    """The table with all rows of the statement, or the first row's error and no row."""
    _writable(table)
    places = [table.column(name) for name in statement.columns]
    if len({*places}) < len(places):
        raise errors.ExecutionError("INSERT names a column twice")
    rows: list[tuple] = []
    failed: Exception | None = None
    for given in statement.rows:
        row = [None] * len(table.columns)
        for place, value in zip(places, given):
            row[place] = value
        try:
            for i, column in enumerate(table.columns):
                if row[i] is None and not column.nullable:
                    raise errors.ConstraintViolation("null", column=column.name)
                row[i] = column.type.stored(row[i])
        except (errors.ConstraintViolation, errors.CodecError) as error:
            failed = error  # an earlier row may still violate a constraint
            break
        rows.append(tuple(row))
    groups = unique_groups(table)
    keys = [[tuple(row[i] for i in group) for row in rows] for _, group in groups]
    taken = [_taken(store, table, group, {k for k in own if None not in k}) for (_, group), own in zip(groups, keys)]
    for r in range(len(rows)):
        for (kind, group), own, used in zip(groups, keys, taken):
            if None in own[r]:
                continue
            if own[r] in used:
                raise _violation(table, kind, group, own[r])
            used.add(own[r])
    if failed is not None:
        raise failed
    return store.appended(table, rows)


def _condition(table: Table, where, negated: bool = False):
    """WHERE of UPDATE and DELETE over numbered columns, or its opposite."""
    scope = Scope(tuple(L.Field(f"c{i}", c.name, table.name, c.type) for i, c in enumerate(table.columns)), (table.name,))
    return predicate(over(where, lambda e: S.Compare(scope.find(e.left), e.op, e.right)), negated=negated)


def update(store: Store, table: Table, statement: S.Update) -> Table:
    """The table with literals set where the condition holds; uniqueness is checked on the result."""
    _writable(table)
    changes = {}
    for name, value in statement.changes:
        i = table.column(name)
        kind = table.columns[i].type
        try:
            changes[i] = kind.stored(value)
        except errors.CodecError as error:
            raise TypeError(f"{kind} vs {literal_type(value)}: {error}") from error
    frame = store.frame(table)
    hit = F.lit(True) if statement.where is None else _condition(table, statement.where)
    columns = []
    for i, column in enumerate(table.columns):
        old = F.col(f"c{i}")
        if i in changes:
            stored = changes[i]
            new = F.lit(stored.isoformat(sep=" ")).cast("timestamp_ntz") if column.type.family == "timestamp" else F.lit(stored).cast(column.type.spark())
            old = F.when(hit, new).otherwise(old).alias(f"c{i}")
        columns.append(old)
    out = store.rewritten(table, frame.select(*columns))
    for kind, group in unique_groups(table):
        if changes.keys() & {*group}:
            names = [f"c{i}" for i in group]
            some = store.frame(out).where(" AND ".join(f"{n} IS NOT NULL" for n in names)).groupBy(*names).count().where("count > 1").first()
            if some is not None:
                raise _violation(table, kind, group, tuple(some[n] for n in names))
    return out


def delete(store: Store, table: Table, statement: S.Delete) -> Table:
    _writable(table)
    if statement.where is None:
        return Table(table.name, table.columns)
    return store.rewritten(table, store.frame(table).where(_condition(table, statement.where, negated=True)))
