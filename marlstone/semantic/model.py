"""Semantic models: names-only queries over metrics and dimensions, planned along declared relationships.

Refused: unknown names, no or several join paths, paths that repeat rows of a metric's model, metrics that don't
add up across what is asked, date filters without a date dimension, and row policies without the attribute.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import PlanError, items, known, predicate
from ..plans.pipeline import limited

#: Metric types, filter operators, the directions of a path that repeat rows, and the limits of what is read.
METRICS = {"sum": F.sum, "count_distinct": F.count_distinct, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
OPS = {"eq": "equals", "neq": "not_equals", "gt": "greater_than", "lt": "less_than", "gte": "greater_than_equal", "lte": "less_than_equal", "like": "like", "in": "in", "is_null": "is_null", "is_not_null": "is_not_null"}
MAX_ROWS, MAX_FILTERS, MAX_FILTER_TEXT, MAX_MODELS = 1_000, 50, 1_024, 32
REPEATS = {(True, "one_to_many"), (True, "many_to_many"), (False, "many_to_one"), (False, "many_to_many")}


@dataclass(frozen=True)
class Dimension:
    name: str
    sql: str
    type: str = "string"


@dataclass(frozen=True)
class Metric:
    name: str
    sql: str
    type: str
    filters: tuple[str, ...] = ()
    additivity: str = "additive"
    non_additive_dimensions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    to: str
    keys: tuple[tuple[str, str], ...]
    cardinality: str = "many_to_one"
    how: str = "inner"


@dataclass
class Model:
    name: str
    table: str
    dimensions: dict[str, Dimension]
    metrics: dict[str, Metric] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)
    base_filter: str | None = None
    row_policy: tuple[str, str] | None = None  # consumer attribute, column
    calendar: dict[str, tuple[str, str]] = field(default_factory=dict)  # inclusive named periods


@dataclass
class Query:
    model: str
    metrics: list[str]
    group_by: list[str] = field(default_factory=list)
    filters: list[tuple] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    period: str | None = None


class Catalog:
    """access, where given, is asked for each query which of its models the consumer may read (governance.Access)."""

    def __init__(self, models: list[Model], access: object | None = None):
        self.models, self.access = {m.name: m for m in models}, access

    def path(self, root: str, to: str, depth: int = 4) -> list[tuple[str, Relationship, bool]]:
        """The only shortest path; an edge backwards only where it is one to one."""
        found, queue, best = [], deque([(root, [])]), None
        while queue:
            at, steps = queue.popleft()
            if best is not None and len(steps) > best:
                break
            if at == to:
                best, found = len(steps), [*found, steps]
                continue
            if len(steps) < depth:
                seen = {root, *(s[0] for s in steps)}
                out = [(r.to, r, True) for r in self.models[at].relationships] + [(m.name, r, False) for m in self.models.values() for r in m.relationships if r.to == at and r.cardinality == "one_to_one"]
                queue.extend((s[0], [*steps, s]) for s in out if s[0] not in seen)
        if len(found) != 1:
            raise PlanError(f"{len(found) or 'no'} join paths from {root} to {to}")
        return found[0]

    def resolve(self, root: str, name: str) -> tuple[str, Dimension]:
        """`model.name`, or a name of the root first and then of exactly one other model."""
        if "." in name:
            model, name = name.split(".", 1)
            return model, self.models[known("model", model, self.models)].dimensions[known("dimension", name, self.models[model].dimensions)]
        owners = [root] if name in self.models[root].dimensions else [m.name for m in self.models.values() if name in m.dimensions]
        if len(owners) != 1:
            known("dimension", name, {d: 0 for m in self.models.values() for d in m.dimensions})
            raise PlanError(f"dimension {name} is in {', '.join(owners)}; say which")
        return owners[0], self.models[owners[0]].dimensions[name]

    def read(self, q: Query, tables: dict[str, DataFrame], consumer: dict | None = None, limit: int = MAX_ROWS) -> tuple[list, bool]:
        """At most `limit` rows, never more than MAX_ROWS, and whether there were more."""
        if limit < 1:
            raise PlanError("a limit is one row or more")
        return limited(self.query(q, tables, consumer), min(limit, MAX_ROWS))

    def view(self, name: str, q: Query, tables: dict[str, DataFrame], consumer: dict | None = None) -> DataFrame:
        """A temporary view of what a query gives."""
        df = self.query(q, tables, consumer)
        df.createOrReplaceTempView(name)
        return df

    def query(self, q: Query, tables: dict[str, DataFrame], consumer: dict | None = None) -> DataFrame:
        """The query's rows; allowed and refused queries both leave their evidence with `access`."""
        if self.access is None:
            return self._planned(q, tables, consumer)[0]
        return self.access.asked(q, consumer, lambda check: self._planned(q, tables, consumer, check))

    def _planned(self, q: Query, tables: dict[str, DataFrame], consumer: dict | None = None, check=None) -> tuple[DataFrame, list[str]]:
        """The frame and the models it reads; check is called with the models before anything is built."""
        if len(q.filters) > MAX_FILTERS:
            raise PlanError(f"more than {MAX_FILTERS} filters")
        if any(isinstance(v, str) and len(v) > MAX_FILTER_TEXT for f in q.filters for x in f[2:] for v in (x if isinstance(x, (list, tuple)) else [x])):
            raise PlanError(f"a filter's text is longer than {MAX_FILTER_TEXT}")
        root = self.models[known("model", q.model, self.models)]
        metrics = [root.metrics[known("metric", m, root.metrics)] for m in q.metrics]
        dims = [(n, *self.resolve(root.name, n)) for n in q.group_by]
        tests = [(self.resolve(root.name, f[0]), *f[1:]) for f in q.filters]
        others = [m for m in dict.fromkeys([d[1] for d in dims] + [t[0][0] for t in tests]) if m != root.name]
        steps = {s[0]: (prev, s) for o in others for path in [self.path(root.name, o)] for prev, s in zip([root.name, *(x[0] for x in path)], path, strict=False)}
        if len(steps) + 1 > MAX_MODELS:
            raise PlanError(f"more than {MAX_MODELS} models")
        if check:
            check([root.name, *steps])
        for name, (_, (_, r, forward)) in steps.items():
            if metrics and (r.cardinality in ("unknown", "many_to_many") or (forward, r.cardinality) in REPEATS):
                raise PlanError(f"the path to {name} repeats rows ({r.cardinality})")
        pinned = {d[2].name for d in dims} | {t[0][1].name for t in tests if t[1] == "eq"}
        for m in metrics:
            if m.additivity == "non_additive" and steps:
                raise PlanError(f"{m.name} doesn't add up across a join")
            if m.additivity == "semi_additive" and not {*m.non_additive_dimensions} <= pinned:
                raise PlanError(f"{m.name} needs {', '.join(sorted({*m.non_additive_dimensions} - pinned))} grouped or fixed")
        df = self._source(root.name, tables, consumer)
        for name, (prev, (_, r, forward)) in steps.items():
            right = self._source(name, tables, consumer)
            pairs = [(f"{prev}.{a}", f"{name}.{b}") if forward else (f"{prev}.{b}", f"{name}.{a}") for a, b in r.keys]
            on = [F.col(f"{a.split('.')[0]}.{a.split('.')[1]}") == F.col(b) for a, b in pairs]
            df = df.join(right, on, r.how)
        at = lambda model, sql: F.expr(sql) if model == root.name and not steps else F.expr(self._qualified(model, sql, tables))
        for (model, d), op, *value in tests:
            df = df.filter(predicate(at(model, d.sql), OPS[known("filter", op, OPS)], value[0] if value else None))
        if q.period and (q.date_from or q.date_to):
            raise PlanError("a named period excludes date_from and date_to")
        lo, hi = root.calendar[known("period", q.period, root.calendar)] if q.period else (q.date_from, q.date_to)
        if lo or hi:
            date = next((d for d in root.dimensions.values() if d.type in ("date", "timestamp")), None)
            if date is None:
                raise PlanError(f"{root.name} has no date dimension")
            c = at(root.name, date.sql)
            df = df.filter(c >= F.lit(lo).cast("date")) if lo else df
            df = df.filter(c < F.date_add(F.lit(hi).cast("date"), 1)) if hi else df
        aggs = []
        for m in metrics:
            value = at(root.name, m.sql) if m.sql != "*" else F.lit(1)
            for f in m.filters:
                value = F.when(at(root.name, f), value)
            aggs.append(METRICS[known("metric type", m.type, METRICS)](value).alias(m.name))
        keys = [at(model, d.sql).alias(n.split(".")[-1]) for n, model, d in dims]
        return (df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()), [root.name, *steps]

    def sql(self, q: Query) -> str:
        """The query over one model as ANSI SQL text, without consumer: what has joins, periods or a row policy is refused."""
        root = self.models[known("model", q.model, self.models)]
        if root.row_policy or q.period or any(self.resolve(root.name, n)[0] != root.name for n in [*q.group_by, *(f[0] for f in q.filters)]):
            raise PlanError("joins, named periods and row policies have no text here")
        quote = lambda v: "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
        sign = {"eq": "=", "neq": "<>", "gt": ">", "lt": "<", "gte": ">=", "lte": "<=", "like": "LIKE"}
        keys = [(self.resolve(root.name, n)[1].sql, n.split(".")[-1]) for n in q.group_by]
        picked = [f"{k} AS {n}" for k, n in keys]
        for name in q.metrics:
            m = root.metrics[known("metric", name, root.metrics)]
            inner = f"CASE WHEN {' AND '.join(f'({f})' for f in m.filters)} THEN {'1' if m.sql == '*' else m.sql} END" if m.filters else m.sql
            picked.append((f"count(DISTINCT {inner})" if m.type == "count_distinct" else f"{m.type}({inner})") + f" AS {name}")
        tests = [f"({root.base_filter})"] if root.base_filter else []
        for f, op, *value in q.filters:
            c = self.resolve(root.name, f)[1].sql
            known("filter", op, OPS)
            tests.append(f"{c} IS {'NOT ' if op == 'is_not_null' else ''}NULL" if op in ("is_null", "is_not_null") else f"{c} IN ({', '.join(map(quote, items(value[0])))})" if op == "in" else f"{c} {sign[op]} {quote(value[0])}")
        date = next((d for d in root.dimensions.values() if d.type in ("date", "timestamp")), None)
        if (q.date_from or q.date_to) and date is None:
            raise PlanError(f"{root.name} has no date dimension")
        tests += [f"{date.sql} >= DATE {quote(q.date_from)}"] if q.date_from else []
        tests += [f"{date.sql} < DATE {quote(q.date_to)} + INTERVAL '1' DAY"] if q.date_to else []
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        group = f" GROUP BY {', '.join(k for k, _ in keys)}" if keys else ""
        return f"SELECT {'' if q.metrics else 'DISTINCT '}{', '.join(picked)} FROM {root.table}{where}{group if q.metrics else ''}"

    def _source(self, name: str, tables: dict[str, DataFrame], consumer: dict | None) -> DataFrame:
        m = self.models[name]
        df = tables[m.table]
        df = df.filter(m.base_filter) if m.base_filter else df
        if m.row_policy:
            attribute, column = m.row_policy
            if attribute not in (consumer or {}):
                raise PlanError(f"{name} needs the consumer's {attribute}")
            df = df.filter(F.col(column) == F.lit(consumer[attribute]))
        return df.alias(name)

    def _qualified(self, model: str, sql: str, tables: dict[str, DataFrame]) -> str:
        import re

        names = {*tables[self.models[model].table].columns}
        return re.sub(r"(?<![\w.'])([A-Za-z_]\w*)(?!\s*\()", lambda m: f"{model}.{m[1]}" if m[1] in names else m[1], sql)
