"""Contracts and runs in public formats: Open Data Contract Standard, OpenLineage run events, and alerts."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from .checks import Result

#: Logical types of the Open Data Contract Standard and the physical ones they stand for.
LOGICAL = {"string": "string", "date": "date", "timestamp": "timestamp", "boolean": "boolean", "int": "integer", "integer": "integer", "bigint": "integer", "long": "integer", "double": "number", "float": "number", "decimal": "number"}
#: OpenLineage event types of the states of a run.
EVENTS = {"STARTED": "START", "STAGING": "RUNNING", "STAGED": "RUNNING", "PROMOTING": "RUNNING", "PROMOTED": "COMPLETE", "QUARANTINED": "FAIL", "CHECK_ERROR": "FAIL"}


def to_odcs(contract: dict) -> dict:
    """A contract (id, version, status, output, sla, owner) as a document of the standard."""
    fields = [
        {"name": n, "logicalType": LOGICAL.get(str(f.get("type", "")).partition("(")[0], "object"), "physicalType": f.get("type"), "required": bool(f.get("required")), "unique": bool(f.get("unique"))} | ({"classification": f["classification"]} if f.get("classification") else {})
        for n, f in contract.get("output", {}).items()
    ]
    out = {"apiVersion": "v3.0.2", "kind": "DataContract", "id": contract["id"], "version": contract.get("version", "1.0.0"), "status": contract.get("status", "draft"), "schema": [{"name": contract["id"], "logicalType": "object", "properties": fields}]}
    out |= {"slaProperties": [{"property": k, "value": v} for k, v in contract["sla"].items()]} if contract.get("sla") else {}
    return out | ({"team": [{"username": contract["owner"], "role": "owner"}]} if contract.get("owner") else {})


def from_odcs(document: dict) -> dict:
    """The reverse; several tables in one document are refused."""
    if document.get("kind") != "DataContract" or len(document.get("schema") or []) != 1:
        raise ValueError("a data contract of one table is needed")
    output = {}
    for p in document["schema"][0].get("properties") or []:
        kept = {"type": p.get("physicalType") or p.get("logicalType"), "required": p.get("required"), "unique": p.get("unique"), "classification": p.get("classification")}
        output[p["name"]] = {k: v for k, v in kept.items() if v}
    out = {"id": document["id"], "version": document["version"], "status": document.get("status"), "output": output}
    out |= {"sla": {p["property"]: p["value"] for p in document["slaProperties"]}} if document.get("slaProperties") else {}
    return out | ({"owner": document["team"][0]["username"]} if document.get("team") else {})


def lineage_event(state: str, run_id: str, job: str, at: datetime, inputs: list[str], outputs: dict[str, list[tuple[str, str, str]]], namespace: str = "default") -> dict:
    """An OpenLineage run event; outputs: table to (column, source table, source column)."""
    sets = []
    for table, edges in outputs.items():
        fields: dict[str, dict] = {}
        for column, source, source_column in edges:
            fields.setdefault(column, {"inputFields": []})["inputFields"].append({"namespace": namespace, "name": source, "field": source_column})
        sets.append({"namespace": namespace, "name": table, "facets": {"columnLineage": {"fields": fields}} if fields else {}})
    return {"eventType": EVENTS[state], "eventTime": at.isoformat(), "run": {"runId": run_id}, "job": {"namespace": namespace, "name": job}, "inputs": [{"namespace": namespace, "name": n} for n in sorted(inputs)], "outputs": sets}


def alert(product: str, run_id: str, results: list[Result], send: Callable[[str], None]) -> int:
    """Sends one message for each critical check that failed or broke; one that can't be sent doesn't stop the others. Returns how many went out."""
    sent = 0
    for r in results:
        if r.critical and r.status in ("FAIL", "ERROR"):
            try:
                send(json.dumps({"product": product, "run_id": run_id, "check": r.name, "status": r.status, "value": r.value}, default=str))
                sent += 1
            except OSError:
                continue
    return sent
