"""The closed catalogs: predicates, column operations and aggregates, each as a Column builder."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PlanError(ValueError):
    """A declaration that can't be planned."""


def known(kind: str, name: str, table: dict) -> str:
    if name in table:
        return name
    near = difflib.get_close_matches(name, table, 3)
    raise PlanError(f"unknown {kind} {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


def literal(value, kind: T.DataType | None = None) -> Column:
    """A literal for the column it meets, or else typed by its own look.

    A number meets a column of numbers as a number, whole or decimal as it is written, so that the comparison runs in
    the wider type. Text that is no value of the column's type is refused, as it would silently match nothing.
    """
    if value is None:
        return F.lit(None)
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    if isinstance(kind, T.NumericType):
        text = str(value).strip()
        if isinstance(value, bool) or not NUMBER.fullmatch(text):
            raise PlanError(f"{value!r} is no number, but the column is {kind.simpleString()}")
        if re.fullmatch(r"[+-]?\d+", text):
            return F.lit(int(text)) if abs(int(text)) < 1 << 63 else F.lit(Decimal(text))
        exact = not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType)
        return F.lit(Decimal(text)) if exact and "e" not in text.lower() else F.lit(float(text))
    if isinstance(kind, T.BooleanType):
        if str(value).strip().lower() not in ("true", "false"):
            raise PlanError(f"{value!r} is not true or false")
        return F.lit(str(value).strip().lower() == "true")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
        try:
            datetime.fromisoformat(value.strip())
        except ValueError:
            raise PlanError(f"{value!r} is no date or time") from None
        # a time meets a date as a time; a date meets a time as its midnight
        return F.lit(value.strip()).cast(T.TimestampNTZType() if isinstance(kind, T.DateType) and len(value.strip()) > 10 else kind)
    if kind is not None:
        return F.lit(value).cast(kind) if not isinstance(value, str) else F.lit(value).try_cast(kind)
    if isinstance(value, str):
        for cast in (int, float):
            try:
                return F.lit(cast(value))
            except ValueError:
                pass
    return F.lit(value)


NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")


def items(value) -> list:
    return [x.strip() if isinstance(x, str) else x for x in (re.split("[,;]", value) if isinstance(value, str) else value)]


def _bounds(value) -> list:
    found = items(value)
    if len(found) != 2:
        raise PlanError(f"between needs two values, got {value!r}")
    return found


_in = lambda c, v, t: c.isin(*[literal(x, t) for x in items(v)])
_between = lambda c, v, t: c.between(*[literal(x, t) for x in _bounds(v)])
Builder = Callable[[Column, object, "T.DataType | None"], Column]
#: The names of the grammar. name: (takes a value, builder)
PREDICATES: dict[str, tuple[bool, Builder]] = {
    "is_null": (False, lambda c, v, t: c.isNull()),
    "is_not_null": (False, lambda c, v, t: c.isNotNull()),
    "equals": (True, lambda c, v, t: c == literal(v, t)),
    "not_equals": (True, lambda c, v, t: c != literal(v, t)),
    "greater_than": (True, lambda c, v, t: c > literal(v, t)),
    "less_than": (True, lambda c, v, t: c < literal(v, t)),
    "greater_than_equal": (True, lambda c, v, t: c >= literal(v, t)),
    "less_than_equal": (True, lambda c, v, t: c <= literal(v, t)),
    "in": (True, _in),
    "not_in": (True, lambda c, v, t: ~_in(c, v, t)),
    "between": (True, _between),
    "not_between": (True, lambda c, v, t: ~_between(c, v, t)),
    "contains": (True, lambda c, v, t: c.contains(F.lit(str(v)))),
    "not_contains": (True, lambda c, v, t: ~c.contains(F.lit(str(v)))),
    "starts_with": (True, lambda c, v, t: c.startswith(F.lit(str(v)))),
    "ends_with": (True, lambda c, v, t: c.endswith(F.lit(str(v)))),
    "like": (True, lambda c, v, t: c.like(str(v))),
    "not_like": (True, lambda c, v, t: ~c.like(str(v))),
}
#: Other names that the grammar allows.
ALIASES = {
    "eq": "equals", "=": "equals", "ne": "not_equals", "!=": "not_equals", "gt": "greater_than", ">": "greater_than", "lt": "less_than", "<": "less_than",
    "gte": "greater_than_equal", ">=": "greater_than_equal", "lte": "less_than_equal", "<=": "less_than_equal", "notcontains": "not_contains", "notlike": "not_like",
    "mean": "avg", "average": "avg", "countdistinct": "count_distinct", "distinct_count": "count_distinct", "sumdistinct": "sum_distinct",
    "approx_distinct_count": "approx_count_distinct", "std": "stddev", "var": "variance", "coalesce": "nvl",
}


def predicate(c: Column, name: str, value=None, kind: T.DataType | None = None) -> Column:
    name = known("predicate", ALIASES.get(name, name), PREDICATES)
    takes, build = PREDICATES[name]
    if takes and value is None:
        raise PlanError(f"predicate {name} needs a value")
    return build(c, value, kind)


def _cast(c: Column, *args: str) -> Column:
    kind = ",".join(args)
    return c.try_cast("timestamp" if kind in ("datetime", "timestamp") else kind)


#: name: (least number of arguments, builder); failures of a value give null, not an error.
OPS: dict[str, tuple[int, Callable[..., Column]]] = {
    "cast": (1, _cast),
    "upper": (0, lambda c: F.upper(c)),
    "lower": (0, lambda c: F.lower(c)),
    "trim": (0, lambda c: F.trim(c)),
    "length": (0, lambda c: F.length(c)),
    "split": (2, lambda c, *a: F.get(F.split(c, ",".join(a[:-1])), F.lit(int(a[-1])))),
    "substring": (2, lambda c, start, n: F.substring(c, int(start), int(n))),
    "round": (0, lambda c, n="0": F.round(c, int(n))),
    "abs": (0, lambda c: F.abs(c)),
    "ceil": (0, lambda c: F.ceil(c)),
    "to_date": (0, lambda c, *fmt: F.try_to_date(c, ",".join(fmt)) if fmt else c.try_cast("date")),
    "nvl": (1, lambda c, *a: F.coalesce(c, F.lit(",".join(a)))),
    "lit": (1, lambda c, *a: literal(",".join(a))),
    "literal": (1, lambda c, *a: literal(",".join(a))),
    "col": (0, lambda c, name=None: F.col(name) if name else c),
    "expr": (1, lambda c, *a: F.expr(",".join(a))),
}


def apply_op(c: Column, spec: str, kind: T.DataType | None = None, raw_sql: bool = True) -> Column:
    """One operation `name:arg,arg` on a column."""
    name, _, rest = str(spec).partition(":")
    name = known("operation", ALIASES.get(name, name), OPS)
    least, build = OPS[name]
    args = rest.split(",") if rest else []
    if len(args) < least:
        raise PlanError(f"operation {name} needs {least} argument(s)")
    if name == "expr" and not raw_sql:
        raise PlanError("raw SQL is not allowed here")
    if name == "nvl":
        return F.coalesce(c, literal(rest, kind).cast(kind) if kind is not None else literal(rest))
    return build(c, *args)


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "sum_distinct": F.sum_distinct,
    "approx_count_distinct": F.approx_count_distinct, "stddev": F.stddev, "variance": F.variance, "first": F.first, "last": F.last,
}


def aggregate(name: str, source: str) -> Column:
    name = known("aggregate", ALIASES.get(name, name), AGGREGATES)
    if source == "*":
        if name != "count":
            raise PlanError(f"{name} can't take *")
        return F.count(F.lit(1))
    return AGGREGATES[name](F.col(source))
