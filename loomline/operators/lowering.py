"""Plan nodes to DataFrame operations; physical strategies are left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans import logical as L
from loomline.plans import syntax as S

HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}
NUMERIC = ("int", "float", "decimal")

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _boolean(expression, leaf: Callable[[S.Compare], Column]) -> Column:
    match expression:
        case S.Both(a, b):
            return _boolean(a, leaf) & _boolean(b, leaf)
        case S.Either(a, b):
            return _boolean(a, leaf) | _boolean(b, leaf)
        case S.Negated(a):
            return ~_boolean(a, leaf)
        case _:
            return leaf(expression)


#: What holds of two values that are not null where the comparison does not.
_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def predicate(expression, strict: bool = False, negated: bool = False) -> Column:
    """WHERE, or its opposite: two-valued, a comparison with NULL is false and so NOT of it true.

    Negations are carried down to the comparisons, which then stand plain, so that a scan can take them
    as filters.  A null result stands for false, as filters and WHEN have it.
    """
    match expression:
        case S.Both(a, b) | S.Either(a, b):
            left, right = predicate(a, strict, negated), predicate(b, strict, negated)
            return left & right if isinstance(expression, S.Both) != negated else left | right
        case S.Negated(a):
            return predicate(a, strict, not negated)
        case _:
            field, literal = F.col(expression.left.id), expression.left.type.literal(expression.right.value, strict)
            if negated:
                return field.isNull() | _COMPARE[_OPPOSITE[expression.op]](field, literal)
            return _COMPARE[expression.op](field, literal)


def _having(expression) -> Column:
    """As WHERE, but any two numbers compare."""

    def leaf(e: S.Compare) -> Column:
        field, value = e.left, e.right.value
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        literal = F.lit(value) if number and field.type.family in NUMERIC else field.type.literal(value)
        return F.coalesce(_COMPARE[e.op](F.col(field.id), literal), F.lit(False))

    return _boolean(expression, leaf)


def _on(expression) -> Column:
    """ON: three-valued, as in SQL."""

    def leaf(e: S.Compare) -> Column:
        if isinstance(e.right, S.Literal):
            return _COMPARE[e.op](F.col(e.left.id), e.left.type.literal(e.right.value))
        a, b = e.left.type, e.right.type
        if a.family != b.family and not (a.family in NUMERIC and b.family in NUMERIC):
            raise TypeError(f"type mismatch: {a} vs {b}")
        return _COMPARE[e.op](F.col(e.left.id), F.col(e.right.id))

    return _boolean(expression, leaf)


def _join(node: L.Join, left: DataFrame, right: DataFrame) -> DataFrame:
    if node.keys:
        condition = reduce(and_, (F.col(a.id) == F.col(b.id) for a, b, _ in node.keys))
    elif node.condition is not None:
        condition = _on(node.condition)
    else:
        condition = None
    if condition is None and node.kind in ("INNER", "CROSS"):
        joined = left.crossJoin(right)
    else:
        joined = left.join(right, F.lit(True) if condition is None else condition, HOW[node.kind])
    return joined.withColumns({m.id: F.coalesce(a.id, b.id) for a, b, m in node.keys}) if node.keys else joined


def _call(func: str, arg: L.Field | None, result: L.Field) -> Column:
    if arg is None:
        value = F.count(F.lit(1))
    elif func == "AVG" and arg.type.family == "decimal":
        value = F.avg(F.col(arg.id).cast("double"))
    else:
        value = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[func](F.col(arg.id))
    return value.alias(result.id)


def _keys(keys: tuple[tuple[L.Field, bool], ...]) -> list[Column]:
    """NULLs come last in ascending and first in descending order, as the greatest value would."""
    return [F.col(f.id).desc_nulls_first() if d else F.col(f.id).asc_nulls_last() for f, d in keys]


def lower(node: L.LogicalPlan, scan: Callable[[L.Scan], DataFrame], strict: bool = False) -> DataFrame:
    """The DataFrame of a plan.  Columns carry field ids up to the projection, which sets the labels."""
    match node:
        case L.Scan():
            return scan(node)
        case L.Join(left=left, right=right):
            return _join(node, lower(left, scan, strict), lower(right, scan, strict))
        case L.Filter(source, expression):
            return lower(source, scan, strict).where(predicate(expression, strict))
        case L.Aggregate(source, groups, calls, having):
            frame = lower(source, scan, strict)
            results = [_call(*call) for call in calls]
            keys = [g.id for g in groups]
            out = frame.groupBy(*keys).agg(*results) if results else frame.select(*keys).distinct()
            return out.where(_having(having)) if having is not None else out
        case L.Sort(source, keys, _):
            return lower(source, scan, strict).orderBy(*_keys(keys))
        case L.Limit(source, limit, offset):
            out = lower(source, scan, strict)
            out = out.offset(offset) if offset else out
            return out.limit(limit) if limit is not None else out
        case L.Project(source, items, _):
            out = lower(source, scan, strict).select(*[F.col(f.id) for _, f in items])
            return out.toDF(*[label for label, _ in items])
    raise ValueError(f"unknown plan node: {type(node).__name__}")
