"""Column lineage of declared pipelines: edges, closures, and classes that travel along them."""

from __future__ import annotations

import re
from collections import deque

#: Words of SQL expressions that name no column.
KEYWORDS = set("AND OR NOT NULL IS IN LIKE RLIKE BETWEEN CASE WHEN THEN ELSE END AS CAST DISTINCT TRUE FALSE DIV INTERVAL DATE TIMESTAMP INT INTEGER BIGINT LONG DOUBLE FLOAT STRING BOOLEAN DECIMAL OVER PARTITION BY ORDER ASC DESC ROWS RANGE".split())
CLASSES = ("public", "internal", "confidential", "restricted", "pii")


def columns_of(expression: str) -> list[str]:
    """Names in an SQL expression that can be columns: no functions, key words or text."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", expression)
    found = re.findall(r"`([^`]+)`|(?<![\w.$])(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)(?!\w*\s*\()(?!\w|\.)", bare)
    return list(dict.fromkeys(n for pair in found for n in pair if n and n.upper() not in KEYWORDS))


class Lineage:
    """Edges from (table, column) to (table, column)."""

    def __init__(self) -> None:
        self.down: dict[tuple, set[tuple]] = {}
        self.up: dict[tuple, set[tuple]] = {}
        self.joins: list[tuple[tuple, tuple]] = []  # columns that meet as keys
        self.lowered: list[tuple[tuple, str, str]] = []  # columns whose given class is below their sources'

    def add(self, source: tuple[str, str], target: tuple[str, str]) -> None:
        self.down.setdefault(source, set()).add(target)
        self.up.setdefault(target, set()).add(source)

    @classmethod
    def of(cls, spec: dict, name: str) -> Lineage:
        """From select_final, fields, add_columns and aggregates of a pipeline; a column belongs to the table that declares it."""
        out, owner = cls(), {}
        for t in spec.get("tables") or []:
            alias = t.get("alias") or t["name"]
            for f in t.get("fields") or []:
                source, target = (f, f) if isinstance(f, str) else (f[0], f[1])
                out.add((t["name"], source), (alias, target))
                owner[target] = alias
        first = next((t.get("alias") or t["name"] for t in spec.get("tables") or []), name)
        for e in [*(spec.get("add_columns") or []), *(spec.get("select_final") or []), *((spec.get("aggregate") or {}).get("measures") or [])]:
            source, target = (e.get("from") or e.get("source"), e.get("as") or e.get("target")) if isinstance(e, dict) else (e[0], e[1])
            ops = (e.get("ops") if isinstance(e, dict) else e[2] if len(e) > 2 else None) or []
            ops = [ops] if isinstance(ops, str) else ops if isinstance(ops, list) else []
            replaced = any(str(o).startswith("expr:") for o in ops)  # an expression takes the place of the source
            if source and source != "*" and not str(source).startswith("literal:") and not replaced:
                out.add((owner.get(source, first), source), (name, target))
            for op in ops:
                if isinstance(op, str) and op.startswith(("expr:", "col:")):
                    for column in columns_of(op.partition(":")[2]):
                        if column != target or owner.get(column, first) != name:
                            out.add((owner.get(column, first), column), (name, target))
        for k in (spec.get("aggregate") or {}).get("group_by") or []:
            out.add((owner.get(k, first), k), (name, k))
        for j in spec.get("join") or spec.get("joins") or []:
            sides = [([j[s][1]] if isinstance(j[s][1], str) else j[s][1] or []) for s in ("table_from", "table_to")]
            for a, b in zip(*sides, strict=True):
                out.joins.append(((j["table_from"][0], a), (j["table_to"][0], b)))
        return out

    def metrics(self, model) -> Lineage:
        """Adds the edges of a semantic model's dimensions and metrics."""
        for d in [*model.dimensions.values(), *model.metrics.values()]:
            for column in columns_of(" , ".join([d.sql, *getattr(d, "filters", ())])):
                self.add((model.table, column), (model.name, d.name))
        return self

    def cycle(self) -> list[tuple] | None:
        """Columns that depend on each other, in order, or none."""
        done: set[tuple] = set()
        for start in self.down:
            trail, stack = [], [(start, iter(sorted(self.down.get(start, ()))))]
            if start in done:
                continue
            trail.append(start)
            while stack:
                node, rest = stack[-1]
                following = next(rest, None)
                if following is None:
                    done.add(node)
                    trail.pop()
                    stack.pop()
                elif following in trail:
                    return [*trail[trail.index(following) :], following]
                elif following not in done:
                    trail.append(following)
                    stack.append((following, iter(sorted(self.down.get(following, ())))))
        return None

    def dictionary(self, described: dict[tuple, str] | None = None, given: dict[tuple, str] | None = None) -> list[dict]:
        """One entry for each column: table, column, description (its own, or that of its only source), class, and what it comes from."""
        classes, described = self.classify(given or {}), described or {}
        out = []
        for node in sorted({*self.up, *self.down, *described}):
            sources = sorted(self.up.get(node, ()))
            text = described.get(node) or (described.get(sources[0]) if len(sources) == 1 else None)
            out.append({"table": node[0], "column": node[1], "description": text, "inherited": node not in described and text is not None, "class": classes.get(node, CLASSES[0]), "sources": [".".join(s) for s in sources]})
        return out

    def render(self, form: str = "text") -> str:
        """Edges as text, Mermaid or DOT."""
        edges = sorted((".".join(a), ".".join(b)) for a, found in self.down.items() for b in found)
        if form == "text":
            return "\n".join(f"{a} -> {b}" for a, b in edges)
        names = {n: f"n{k}" for k, n in enumerate(sorted({x for e in edges for x in e}))}
        if form == "mermaid":
            return "\n".join(["graph LR", *(f'  {names[n]}["{n}"]' for n in names), *(f"  {names[a]} --> {names[b]}" for a, b in edges)])
        if form == "dot":
            return "\n".join(["digraph {", *(f'  "{a}" -> "{b}";' for a, b in edges), "}"])
        raise ValueError(f"unknown form {form!r}")

    def closure(self, start: tuple, upstream: bool = False, depth: int = 20) -> dict[tuple, int]:
        """Reachable columns with their least distance."""
        edges, found, queue = self.up if upstream else self.down, {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            if found[at] < depth:
                for n in edges.get(at, ()):
                    if n not in found:
                        found[n] = found[at] + 1
                        queue.append(n)
        found.pop(start)
        return found

    def classify(self, given: dict[tuple, str], strict: bool = False) -> dict[tuple, str]:
        """A column's class is the highest upstream; a given one wins, and strictly mustn't be lower."""
        out = {}
        for node in {*self.up, *self.down}:
            above = max([CLASSES.index(given[n]) for n in self.closure(node, True) if n in given], default=0)
            if node in given and strict and CLASSES.index(given[node]) < above:
                raise ValueError(f"{node} is declared {given[node]}, below {CLASSES[above]}")
            if node in given and CLASSES.index(given[node]) < above:
                self.lowered.append((node, CLASSES[above], given[node]))
            out[node] = given.get(node, CLASSES[above])
        return out
