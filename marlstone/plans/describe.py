"""What a declaration says, without running it: summary, output schema, rule dependencies and warnings, and the catalog's names."""

from __future__ import annotations

import ast
import difflib
import inspect
import textwrap
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..functions.catalog import PlanError
from .pipeline import Pipeline, parse_filter

LONG_RULE, MANY_COLUMNS = 30, 5


def describe_schema(spec: dict) -> dict:
    """Sources, joins, steps and outputs of a declaration. Reads nothing."""
    final, a = spec.get("select_final"), spec.get("aggregate")
    name = lambda e: e if isinstance(e, str) else (e.get("as") or e.get("from")) if isinstance(e, dict) else e[1] if len(e) > 1 else e[0]
    outputs = [name(e) for e in final] if final else [*a["group_by"], *(m["target"] if isinstance(m, dict) else m[1] for m in a["measures"])] if a else None
    return {
        "tables": [{"alias": t.get("alias") or t["name"], "kind": t.get("source_type") or ("file" if t.get("source") else "table"), "streaming": bool(t.get("streaming")), "filters": [parse_filter(f)[:2] for f in t.get("filter") or []]} for t in spec.get("tables") or []],
        "partials": [{"alias": p["alias"], "mode": p.get("mode", "inline")} for p in spec.get("partials") or []],
        "joins": [(j["table_from"][0], str(j.get("type", "left")), j["table_to"][0]) for j in spec.get("join") or spec.get("joins") or []],
        "rules": list(spec.get("business_rules") or []),
        "steps": [k for k in ("where", "where_groups", "business_rules", "add_columns", "select_final", "aggregate", "sink") if spec.get(k)],
        "outputs": outputs,
    }


def infer_output_schema(pipeline: Pipeline) -> T.StructType:
    """The schema of the analysed plan; no row is read."""
    return pipeline.run().schema


@dataclass
class Profile:
    """What a rule's source tells. reads is None where the source can't be had."""

    name: str
    kind: str
    reads: set[str] | None
    writes: set[str]
    warnings: list[str] = field(default_factory=list)
    forms: dict[str, str] = field(default_factory=dict)


def _source(f: Callable) -> ast.AST | None:
    """The syntax tree of a function; a lambda is found among those of its line by the names and values it uses."""
    try:
        text = textwrap.dedent(inspect.getsource(f))
    except (OSError, TypeError):
        return None
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return None
    if f.__name__ != "<lambda>":
        return tree
    found = [n for n in ast.walk(tree) if isinstance(n, ast.Lambda)]
    told = lambda c: (c.co_consts, c.co_names, c.co_varnames)
    same = [n for n in found if told(compile(ast.fix_missing_locations(ast.Expression(n)), "rule", "eval").co_consts[0]) == told(f.__code__)]
    return same[0] if same and len({ast.dump(n) for n in same}) == 1 else None


def profile(name: str, kind: str, f: Callable, *_) -> Profile:
    """Columns that a rule reads and writes, and warnings about it."""
    tree = _source(f)
    if tree is None:
        return Profile(name, kind, None, set())
    first = next((a.arg for n in ast.walk(tree) if isinstance(n, (ast.Lambda, ast.FunctionDef)) for a in n.args.args[:1]), None)
    reads, writes, columns, out = set(), set(), 0, Profile(name, kind, set(), set())
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            called = n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", "")
            texts = [a.value for a in n.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            reads |= {*texts[:1]} if called == "col" else {*texts} if called in ("max", "min", "sum", "avg", "count", "upper", "lower", "coalesce", "select") else set()
            if called == "withColumn":
                columns += 1
                writes |= {*texts[:1]}
            if called in ("udf", "pandas_udf") and "PYTHON_UDF" not in out.warnings:
                out.warnings.append("PYTHON_UDF")
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == first and not callable(getattr(__import__("pyspark.sql", fromlist=["DataFrame"]).DataFrame, n.attr, None)):
            reads.add(n.attr)
        elif isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == first and isinstance(n.slice, ast.Constant):
            reads.add(n.slice.value)
        elif isinstance(n, ast.Dict) and kind != "transform":
            named = {k.value: v for k, v in zip(n.keys, n.values, strict=True) if isinstance(k, ast.Constant) and isinstance(k.value, str)}
            writes |= {*named}
            out.forms |= {k: ast.dump(v) for k, v in named.items()}
    lines = max((getattr(n, "end_lineno", 0) for n in ast.walk(tree)), default=0)
    if lines > LONG_RULE or columns > MANY_COLUMNS:
        out.warnings.append("COMPLEXITY_HIGH")
    out.reads, out.writes = reads, writes
    return out


def dependency_graph(rules: list[tuple]) -> dict[str, set[str]]:
    """For each rule the rules it needs: the last writer of each column it reads. A rule without source needs all before it, and all after need it."""
    needs: dict[str, set[str]] = {}
    profiles = [profile(*r) for r in rules]
    last: dict[str, str] = {}
    for p in profiles:
        if p.reads is not None and p.kind == "projection":
            for q in profiles:
                for c in q.writes & p.reads - p.writes:
                    if q.name != p.name:
                        last.setdefault(c, q.name)
    for k, p in enumerate(profiles):
        if p.reads is None or p.kind != "projection":
            needs[p.name] = {q.name for q in profiles[:k]}
            continue
        found = set()
        for c in p.reads:
            before = [q.name for q in profiles[:k] if c in q.writes]
            found |= {before[-1]} if before else {last[c]} if c in last and c not in p.writes and last[c] != p.name else set()
        needs[p.name] = found | {q.name for q in profiles[:k] if q.reads is None or q.kind != "projection"}
    return needs


def ordered(rules: list[tuple]) -> list[tuple]:
    """Rules with each after those it needs, and otherwise in the given order. A cycle is an error that names it."""
    needs, done, out = dependency_graph(rules), set(), []
    while len(out) < len(rules):
        ready = next((r for r in rules if r[0] not in done and needs[r[0]] <= done), None)
        if ready is None:
            raise PlanError(f"rules need each other: {', '.join(r[0] for r in rules if r[0] not in done)}")
        out.append(ready)
        done.add(ready[0])
    return out


def explain_rules(rules: list[tuple]) -> dict:
    """Profiles, dependencies, stages of neighbouring rules of a kind, and warnings of several rules together."""
    profiles = [profile(*r) for r in rules]
    warnings = [(w, p.name) for p in profiles for w in p.warnings]
    for k, p in enumerate(profiles):
        warnings += [("OVERWRITE", f"{p.name}.{c}") for c in sorted(p.writes) if any(c in q.writes for q in profiles[:k])]
        warnings += [("DUPLICATE_EXPR", f"{p.name}.{c}") for c, form in sorted(p.forms.items()) if any(form in q.forms.values() for q in profiles[:k])]
    read = [c for p in profiles for c in p.reads or ()]
    warnings += [("SHARED_READ", c) for c in sorted({c for c in read if read.count(c) > 1})]
    stages: list[tuple[str, list[str]]] = []
    for r in ordered(rules):
        if stages and stages[-1][0] == r[1] != "transform":
            stages[-1][1].append(r[0])
        else:
            stages.append((r[1], [r[0]]))
    return {"profiles": profiles, "needs": dependency_graph(rules), "stages": stages, "warnings": warnings}


class CatalogInspector:
    """Names in the session's catalog, with near ones for those that aren't there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def schemas(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def tables(self, schema: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(schema))

    def columns(self, table: str) -> dict[str, str]:
        return dict(self.spark.table(table).dtypes)

    def _check(self, kind: str, name: str, there: list[str]) -> str:
        same = [x for x in there if x.lower() == name.lower()]
        if same:
            return same[0]
        near = difflib.get_close_matches(name.lower(), [x.lower() for x in there], 3, 0.5)
        raise PlanError(f"no {kind} {name}" + (f"; did you mean {', '.join(near)}?" if near else ""))

    def validate(self, schema: str, table: str | None = None, columns: list[str] = ()) -> list[str]:
        """The names as the catalog writes them; upper and lower case don't count."""
        found = [self._check("schema", schema, self.schemas())]
        if table:
            found.append(self._check("table", table, self.tables(found[0])))
            there = list(self.columns(".".join(found)))
            found += [self._check("column", c, there) for c in columns]
        return found
