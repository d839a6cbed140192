"""Two-valued comparison and logic over columns: null is the lowest value, nothing is unknown.

Every function returns a boolean column that is never null.  Where the right side is a Python value
the forms keep their comparisons visible to the Parquet reader (``PushedFilters``); ``gt`` and
``ge`` include the null test, so that ``not_`` of them is right and is pushed down too.  A text and a
number are never equal, and neither is less than the other; their types are known when the query is
planned, so the test of the types leaves no trace in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes (fixed value).
SPACES = " \t\n\x0b\f\r\x85\xa0                　"


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _is_text(x: Any) -> Column:
    return F.typeof(x).isin("string") if isinstance(x, Column) else F.lit(isinstance(x, str))


def _is_number(x: Any) -> Column:
    if isinstance(x, Column):
        return F.typeof(x).isin(*_NUMBERS) | F.startswith(F.typeof(x), F.lit("decimal"))
    return F.lit(isinstance(x, (int, float, Decimal)) and not isinstance(x, bool))


def _alike(left: Any, right: Any, result: Column, otherwise: bool = False) -> Column:
    """``result``, or ``otherwise`` where one side is a text and the other a number."""
    unlike = (_is_text(left) & _is_number(right)) | (_is_number(left) & _is_text(right))
    return F.when(unlike, F.lit(otherwise)).otherwise(result)


def eq(left: Any, right: Any) -> Column:
    l, r = _col(left), _col(right)  # noqa: E741
    same = l.eqNullSafe(r)
    if right is None:
        return same
    both = _alike(left, right, same)
    return both | (l.isNull() & r.isNull()) if isinstance(right, Column) else both


def ne(left: Any, right: Any) -> Column:
    return ~eq(left, right)


def lt(left: Any, right: Any) -> Column:
    l, r = _col(left), _col(right)  # noqa: E741
    if right is None:
        return F.lit(False)
    if not isinstance(right, Column):
        return l.isNull() | _alike(left, right, l < r)
    return (l.isNull() & r.isNotNull()) | F.coalesce(_alike(left, right, l < r), F.lit(False))


def le(left: Any, right: Any) -> Column:
    l, r = _col(left), _col(right)  # noqa: E741
    if right is None:
        return l.isNull()
    if not isinstance(right, Column):
        return l.isNull() | _alike(left, right, l <= r)
    return l.isNull() | F.coalesce(_alike(left, right, l <= r), F.lit(False))


def gt(left: Any, right: Any) -> Column:
    l, r = _col(left), _col(right)  # noqa: E741
    if right is None:
        return l.isNotNull()
    if not isinstance(right, Column):
        return l.isNotNull() & _alike(left, right, l > r)
    return (l.isNotNull() & r.isNull()) | F.coalesce(_alike(left, right, l > r), F.lit(False))


def ge(left: Any, right: Any) -> Column:
    l, r = _col(left), _col(right)  # noqa: E741
    if right is None:
        return F.lit(True)
    if not isinstance(right, Column):
        return l.isNotNull() & _alike(left, right, l >= r)
    return r.isNull() | F.coalesce(_alike(left, right, l >= r), F.lit(False))


def true(x: Column) -> Column:
    """A boolean column as a condition: null counts as false."""
    return F.coalesce(x, F.lit(False))


def and_(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def or_(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def not_(condition: Column) -> Column:
    return ~condition


def is_null(x: Column) -> Column:
    return x.isNull()


def is_not_null(x: Column) -> Column:
    return x.isNotNull()


def holds(x: Column, kind: str) -> Column:
    """A bare field as a condition: its value if boolean, else whether it is there."""
    return true(x) if kind == "boolean" else x.isNotNull()


def is_in(x: Column, values: Iterable[Any]) -> Column:
    """Membership; a null among the values matches null."""
    values = list(values)
    rest = [v for v in values if v is not None]
    found = true(x.isin(rest)) if rest else F.lit(False)
    return found | x.isNull() if len(rest) < len(values) else found


def contains(x: Column, part: Any, ignore_case: bool = False) -> Column:
    return _string(F.contains, x, part, ignore_case)


def starts_with(x: Column, part: Any, ignore_case: bool = False) -> Column:
    return _string(F.startswith, x, part, ignore_case)


def ends_with(x: Column, part: Any, ignore_case: bool = False) -> Column:
    return _string(F.endswith, x, part, ignore_case)


def _string(test: Any, x: Column, part: Any, ignore_case: bool) -> Column:
    a, b = (F.lower(x), F.lower(_col(part))) if ignore_case else (x, _col(part))
    return F.coalesce(test(a, b), F.lit(False)) if isinstance(part, Column) or ignore_case else x.isNotNull() & test(a, b)


def like(x: Column, pattern: str) -> Column:
    """``abc%``, ``%abc``, ``%abc%`` or an exact string; ``%`` alone is true; other wildcards are refused."""
    if set(pattern) == {"%"}:
        return F.lit(True)
    core = pattern.removeprefix("%").removesuffix("%")
    if "%" in core or "_" in core:
        raise ValueError(f"unsupported pattern {pattern!r}")
    first, last = pattern.startswith("%"), pattern.endswith("%")
    return contains(x, core) if first and last else ends_with(x, core) if first else starts_with(x, core) if last else eq(x, core)


def null_or_empty(x: Column) -> Column:
    return x.isNull() | (x == "")


def null_or_blank(x: Column) -> Column:
    return x.isNull() | (F.btrim(x, F.lit(SPACES)) == "")


def if_else(test: Column, yes: Any, no: Any) -> Column:
    """A null test gives null."""
    return F.when(test.isNull(), F.lit(None)).when(test, _col(yes)).otherwise(_col(no))
