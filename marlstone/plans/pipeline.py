"""Declared pipelines: a mapping (or YAML text) becomes one DataFrame plan.

Order for a table: filter, qualify, null drop, duplicates, filter groups, limit, fields. Order of the whole:
partials, tables, joins, where, where_groups, rules, add_columns, select or aggregate, having.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog import ALIASES, OPS, PREDICATES, PlanError, aggregate, apply_op, known, predicate
from ..sources.readers import read_source

#: Join types of the grammar, written with blanks, underscores, hyphens or joined.
JOINS = {
    "inner": "inner", "left": "left", "leftouter": "left", "right": "right", "rightouter": "right", "full": "full", "outer": "full", "fullouter": "full",
    "leftsemi": "left_semi", "semi": "left_semi", "leftanti": "left_anti", "anti": "left_anti", "cross": "cross",
}
#: Keys of a declaration.
TOP = {
    "tables", "partials", "join", "joins", "where", "where_groups", "business_rules", "add_columns", "select_final", "keep_all_columns", "aggregate", "sink",
    "allow_raw_sql", "dev_limit", "materialization", "data_product", "semantic",
}


def inject(text: str, params: dict) -> str:
    """{{ key }} by its value; what stays unresolved is an error that names it."""
    missing = sorted({k for k in re.findall(r"\{\{\s*(\w+)\s*\}\}", text) if k not in params})
    if missing:
        raise PlanError(f"unresolved parameters: {', '.join(missing)}")
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: "" if params[m[1]] is None else str(params[m[1]]), text)


def load(text: str, **params) -> dict:
    import yaml

    return yaml.safe_load(inject(text, params)) or {}


def parse_filter(spec) -> tuple[str, str, object]:
    """(column, predicate, value) from `col:op[:value]` or a mapping."""
    if isinstance(spec, str):
        if spec.startswith("sql:"):
            return "", "sql", spec[4:]
        column, _, rest = spec.partition(":")
        op, colon, value = rest.partition(":")
        return column, op, value if colon else None
    ((column, value),) = spec.items()
    if isinstance(value, dict):
        ((op, value),) = value.items()
        return column, op, value
    if value is None:
        return column, "is_null", None
    bare = isinstance(value, str) and value in PREDICATES and not PREDICATES[value][0]
    return (column, value, None) if bare else (column, "equals", value)


class Pipeline:
    """run() gives the declared DataFrame; rules and loaders are registered callables."""

    def __init__(self, spark: SparkSession, spec: dict, frames: dict[str, DataFrame] | None = None, rules: dict[str, tuple] | None = None, loaders: dict[str, Callable] | None = None, dev: bool = False):
        for k in spec:
            known("key", k, dict.fromkeys(TOP))
        if spec.get("select_final") and (spec.get("keep_all_columns") or spec.get("aggregate")):
            raise PlanError("select_final excludes keep_all_columns and aggregate")
        self.spark, self.spec, self.frames, self.rules, self.loaders, self.dev = spark, spec, frames or {}, rules or {}, loaders or {}, dev
        self.raw_sql = spec.get("allow_raw_sql", True)
        check_ops(spec)

    def _condition(self, df: DataFrame, spec) -> Column:
        column, op, value = parse_filter(spec)
        if op == "sql" or column == "sql":
            if not self.raw_sql:
                raise PlanError("raw SQL is not allowed here")
            return F.expr(str(value))
        kind = df.select(column).schema[0].dataType
        return predicate(F.col(column), op, value, kind)

    def _every(self, df: DataFrame, specs) -> DataFrame:
        return df.filter(reduce(lambda a, b: a & b, [self._condition(df, s) for s in specs])) if specs else df

    def _any(self, df: DataFrame, groups) -> DataFrame:
        built = [reduce(lambda a, b: a & b, [self._condition(df, s) for s in g]) for g in groups or [] if g]
        return df.filter(reduce(lambda a, b: a | b, built)) if built else df

    def _column(self, df: DataFrame, entry) -> Column:
        """[source, target, ops] or {from, as, ops}; ops may be a CASE: [when, then, else] or a chain of mappings."""
        if isinstance(entry, str):
            return F.col(entry)
        source, target, ops = (entry.get("from"), entry.get("as") or entry.get("from"), entry.get("ops") or []) if isinstance(entry, dict) else (entry[0], entry[1] if len(entry) > 1 else entry[0], entry[2] if len(entry) > 2 else [])
        ops = [ops] if isinstance(ops, str) else ops
        if isinstance(source, str) and source.startswith("literal:"):
            return apply_op(F.lit(None), "lit:" + source[8:]).alias(target)
        bare = source is None or source == ""
        c, kind = (F.lit(None), None) if bare else (F.col(source), df.select(source).schema[0].dataType)
        if ops and isinstance(ops[0], dict):
            chain, otherwise = None, None
            for step in ops:
                if "when" in step:
                    test, then = self._when(df, c, kind, step["when"]), self._value(c, step.get("then"), kind)
                    chain = F.when(test, then) if chain is None else chain.when(test, then)
                if "else" in step:
                    otherwise = self._value(c, step["else"], kind)
            return (chain if otherwise is None else chain.otherwise(otherwise)).alias(target)
        if ops and str(ops[0]).startswith("when:"):
            if len(ops) != 3:
                raise PlanError("a compact CASE is when, then, else")
            return F.when(self._when(df, c, kind, ops[0][5:]), self._value(c, ops[1].removeprefix("then:"), kind)).otherwise(self._value(c, ops[2].removeprefix("else:"), kind)).alias(target)
        for op in ops:
            c = apply_op(c, op, kind, self.raw_sql)
            kind = df.select(c.alias(target)).schema[0].dataType  # of the chain so far
        return c.alias(target)

    def _when(self, df: DataFrame, c: Column, kind, test: str) -> Column:
        op, _, value = str(test).partition(":")
        if op == "sql":
            raise PlanError("when:sql is not a predicate on the current column")
        return predicate(c, op, value or None, kind)

    def _value(self, c: Column, then, kind) -> Column:
        text = str(then)
        return apply_op(c, text, kind, self.raw_sql) if re.match(r"(cast|upper|lower|trim|length|split|substring|round|abs|ceil|to_date|nvl|coalesce|lit|literal|col|expr)(:|$)", text) else apply_op(c, "lit:" + text)

    def _table(self, t: dict) -> DataFrame:
        name = t.get("alias") or t["name"]
        select = lambda df: df.select([self._column(df, f) for f in t["fields"]]) if t.get("fields") else df
        if name in self.frames or t.get("name") in self.frames:
            return select(self.frames.get(name, self.frames.get(t.get("name"))))
        if t.get("source_type") == "loader":
            df = self.loaders[known("loader", t["function_name"], self.loaders)](self.spark, **t.get("arguments", {}))
        elif t.get("source"):
            df = read_source(self.spark, t["source"], t.get("streaming", False))
        else:
            fqn = ".".join(x for x in (t.get("catalog"), t.get("schema"), t["name"]) if x)
            df = self.spark.readStream.table(fqn) if t.get("streaming") else self.spark.table(fqn)
        df = self._every(df, t.get("filter"))
        q, qc = (t.get("preprocess") or {}).get("qualify"), t.get("quality_checks") or {}
        if df.isStreaming and (q or qc.get("drop_duplicates_on") or t.get("dev_limit")):
            raise PlanError("qualify, drop_duplicates_on and dev_limit need state without bound on a stream")
        df = latest(df, q["partition_by"], q["order_by"], q.get("descending", False)) if q else df
        df = df.dropna(subset=qc["drop_nulls_in"]) if qc.get("drop_nulls_in") else df
        df = df.dropDuplicates(qc["drop_duplicates_on"]) if qc.get("drop_duplicates_on") else df
        df = self._any(df, t.get("filter_groups"))
        limit = t.get("dev_limit", self.spec.get("dev_limit"))
        return select(df.limit(limit) if self.dev and limit else df)

    def _partial(self, p: dict, inside: tuple[str, ...]) -> DataFrame:
        """A child pipeline: inline, as a view of its alias, or as a table of its alias that later runs replace."""
        alias, mode = p["alias"], p.get("mode", "inline")
        known("partial mode", mode, dict.fromkeys(("inline", "temp_view", "table")))
        path = os.path.realpath(p["path"]) if "spec" not in p else None
        if path in inside:
            raise PlanError(f"partials contain themselves: {' > '.join([*inside, path])}")
        if path:
            with open(path, encoding="utf-8") as f:
                child = load(f.read())
        else:
            child = p["spec"]
        df = Pipeline(self.spark, child, self.frames, self.rules, self.loaders, self.dev).run((*inside, path) if path else inside)
        if mode == "temp_view":
            df.createOrReplaceTempView(alias)
        elif mode == "table":
            if df.isStreaming:
                raise PlanError("a stream can't be a partial of mode table")
            df.write.mode("overwrite").saveAsTable(alias)
            df = self.spark.table(alias)
        return df

    def run(self, inside: tuple[str, ...] = ()) -> DataFrame:
        spec, dfs = self.spec, {}
        for p in spec.get("partials") or []:
            if p["alias"] in dfs:
                raise PlanError(f"alias {p['alias']} is taken")
            dfs[p["alias"]] = self._partial(p, inside)
        for t in spec.get("tables") or []:
            alias = t.get("alias") or t["name"]
            if alias in dfs:
                raise PlanError(f"alias {alias} is taken")
            dfs[alias] = self._table(t)
        joins = spec.get("join") or spec.get("joins") or []
        base = joins[0]["table_from"][0] if joins else next(iter(dfs))
        df, hidden, sides = dfs[base], {}, {base}
        for j in joins:
            source, to = (known("alias", j[k][0], dfs) for k in ("table_from", "table_to"))
            if source not in sides or to in sides:
                raise PlanError(f"a join goes from a table that is there to one that isn't; not from {source} to {to}")
            df, hidden = join(df, dfs[to], j, hidden)
            sides.add(to)
        df = df.drop(*hidden.values())
        df = self._any(self._every(df, spec.get("where")), spec.get("where_groups"))
        df = run_rules(df, [(n, *self.rules[known("rule", n, self.rules)]) for n in spec.get("business_rules") or []])
        for entry in spec.get("add_columns") or []:
            c = self._column(df, entry)
            df = df.withColumn(entry["as"] if isinstance(entry, dict) else entry[1], c)
        if spec.get("select_final"):
            return df.select([self._column(df, e) for e in spec["select_final"]])
        if a := spec.get("aggregate"):
            if df.isStreaming:
                raise PlanError("an aggregate block needs a batch input")
            if not a.get("group_by"):
                raise PlanError("group_by must name columns")
            parts = [(m["source"], m["target"], m["function"]) if isinstance(m, dict) else m for m in a["measures"]]
            targets = [m[1] for m in parts]
            if len({*targets, *a["group_by"]}) < len(targets) + len(a["group_by"]):
                raise PlanError("measure targets and group keys must differ")
            df = self._every(df.groupBy(*a["group_by"]).agg(*[aggregate(f, s).alias(t) for s, t, f in parts]), a.get("having"))
        return df


def latest(df: DataFrame, by: list[str], order, descending: bool = False) -> DataFrame:
    """The first row of each key in the given order."""
    specs = [{"field": o, "order": "desc" if descending else "asc"} if isinstance(o, str) else o for o in ([order] if isinstance(order, str) else order)]
    cols = [F.col(o["field"]).desc() if str(o.get("order", "asc")).lower() == "desc" else F.col(o["field"]).asc() for o in specs]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*cols))).filter("_rn = 1").drop("_rn")


def join(left: DataFrame, right: DataFrame, j: dict, hidden: dict[tuple[str, str], str] | None = None):
    """Equal names give one key column; others are compared and the right ones dropped, after filling the left's in right and full joins.

    With `hidden`, which maps (alias, key) of dropped keys to columns that hold them, the result is the frame with these
    columns still there, so that a later join can start from them, and the new mapping.
    """
    how = JOINS[known("join type", re.sub("[ _-]", "", str(j.get("type", "left")).lower()), JOINS)]
    if left.isStreaming and (right.isStreaming or how not in ("inner", "left")) or right.isStreaming and not left.isStreaming:
        raise PlanError("a stream is joined as the left side, inner or left, with a table")
    kept = dict(hidden or {})
    visible = {*left.columns} - {*kept.values()}
    if how == "cross":
        lk = rk = []
    else:
        lk, rk = (([k] if isinstance(k, str) else list(k)) for k in (j["table_from"][1], j["table_to"][1]))
    if len(lk) != len(rk):
        raise PlanError("join keys differ in number")
    clash = (visible & {*right.columns}) - ({*lk} if lk == rk else set())
    if clash and how not in ("left_semi", "left_anti"):
        raise PlanError(f"both sides have {', '.join(sorted(clash))}; name them apart with fields")
    at = [k if k in visible else kept.get((j["table_from"][0], k), k) for k in lk]
    if how == "cross":
        df = left.crossJoin(right)
    elif at == rk:
        df = left.join(right, rk, how)
    else:
        df = left.join(right, reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in zip(at, rk, strict=True)]), how)
        if how not in ("left_semi", "left_anti"):
            to = j["table_to"][0]
            names = {k: f"_{to}_{k}_{len(kept)}" for k in rk}
            if how in ("right", "full"):
                df = df.withColumns({a: F.coalesce(left[a], right[b]) for a, b in zip(at, rk, strict=True)})
            df = df.withColumnsRenamed(names)
            kept |= {(to, k): n for k, n in names.items()}
    return (df, kept) if hidden is not None else df.drop(*kept.values())


def check_ops(spec: dict) -> None:
    """Operations and their arguments, before anything is read."""

    def chain(ops) -> None:
        for op in [ops] if isinstance(ops, str) else ops or []:
            if isinstance(op, str) and not op.startswith(("when:", "then:", "else:")):
                name, _, rest = op.partition(":")
                least = OPS[known("operation", ALIASES.get(name, name), OPS)][0]
                if (len(rest.split(",")) if rest else 0) < least:
                    raise PlanError(f"operation {name} needs {least} argument(s)")

    for e in [f for t in spec.get("tables") or [] for f in t.get("fields") or []] + [*(spec.get("select_final") or []), *(spec.get("add_columns") or [])]:
        chain(e.get("ops") if isinstance(e, dict) else e[2] if not isinstance(e, str) and len(e) > 2 else None)


def limited(df: DataFrame, n: int) -> tuple[list, bool]:
    """At most n rows, and whether there were more."""
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n


def _reads(df: DataFrame, rule: tuple) -> set[str]:
    """Columns a rule reads; where its source can't be had, any: it then runs by itself."""
    from .describe import profile

    found = profile(*rule).reads
    return found if found is not None else _All()


class _All(set):
    def __and__(self, other):
        return {*other}


def run_rules(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """(name, kind, function[, agg_keys]): each after those it needs; neighbouring projections become one select, aggregations of equal keys one groupBy."""
    from .describe import ordered

    rules, k = ordered(rules), 0
    while k < len(rules):
        kind = rules[k][1]
        if kind == "transform":
            df, k = rules[k][2](df), k + 1
        elif kind == "projection":
            new: dict[str, Column] = {}
            while k < len(rules) and rules[k][1] == "projection":
                made = rules[k][2](df)
                if new and ({*made} & {*df.columns} or {*made} & {*new}):
                    break
                new |= made
                k += 1
                if {*made} & {*df.columns}:
                    break
                if k < len(rules) and rules[k][1] == "projection" and _reads(df, rules[k]) & {*new}:
                    break
            df = df.withColumns(new)
        elif kind == "aggregation":
            keys, aggs = sorted(rules[k][3]), {}
            while k < len(rules) and rules[k][1] == "aggregation" and sorted(rules[k][3]) == keys:
                aggs |= rules[k][2](df)
                k += 1
            df = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
        else:
            raise PlanError(f"unknown rule kind {kind}")
    return df
