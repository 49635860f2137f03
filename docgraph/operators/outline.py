"""A second way to cut specifications: a short outline of every endpoint and schema, linked by natural names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from docgraph.runtime import visible
from docgraph.sources.files import load_spec

from .openapi import references

PARAMETERS, RESPONSES, PROPERTIES, DESCRIPTION = 3, 3, 10, 200


def endpoint_outline(path: str, method: str, op: dict) -> str:
    """Method and path, operation, what it is, and the first parameters and responses."""
    lines = [f"{method.upper()} {path}", f"Operation: {op.get('operationId') or f'{method}_{path}'}", ""]
    if op.get("summary"):
        lines.append(f"Summary: {op['summary']}")
    if op.get("description"):
        lines.append(f"Description: {op['description'][:DESCRIPTION]}...")
    lines.append("")
    given, answers = op.get("parameters") or [], op.get("responses") or {}
    own = [p for p in given[:PARAMETERS] if isinstance(p, dict) and "$ref" not in p]
    flag = {True: "[required]", False: "[optional]"}
    lines += ["Parameters:"] * bool(given) + [f"  - {p.get('name', 'unknown')} ({p.get('in', 'unknown')}) {flag[bool(p.get('required'))]}" for p in own]
    told = [(c, r) for c, r in list(answers.items())[:RESPONSES] if isinstance(r, dict)]
    lines += ["Responses:"] * bool(answers) + [f"  - {c}: {r.get('description', '')}" for c, r in told]
    return "\n".join(lines)


def schema_outline(name: str, body: dict) -> str:
    """Name, what it is, type, and the first properties."""
    lines = [f"Schema: {name}", ""]
    if body.get("description"):
        lines += [f"Description: {body['description']}", ""]
    lines.append(f"Type: {body.get('type', 'unknown')}")
    fields = body.get("properties") or {}
    kind = lambda p: p.get("type", "unknown") if isinstance(p, dict) else "unknown"
    must = body.get("required") or []
    lines += ["Properties:"] * bool(fields) + [f"  - {n}: {kind(p)}{' [required]' if n in must else ''}" for n, p in list(fields.items())[:PROPERTIES]]
    return "\n".join(lines)


def _parts(spec: dict):
    for path, item in (spec.get("paths") or {}).items():
        for method, op in item.items() if isinstance(item, dict) else ():
            if isinstance(op, dict):
                yield "endpoint", op.get("operationId") or f"{method}_{path}", op, endpoint_outline(path, method, op)
    for name, body in ((spec.get("components") or {}).get("schemas") or {}).items():
        if isinstance(body, dict):
            yield "schema", name, body, schema_outline(name, body)


def _outlines(frames):
    for frame in frames:
        out = []
        for file, raw in zip(frame.file, frame.content):
            spec, error = load_spec(file, bytes(raw))
            if error or not isinstance(spec, dict):
                continue
            stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            parts = list(_parts(spec))
            known = {name for _, name, _, _ in parts}
            for kind, name, body, text in parts:
                refs = [r.rsplit("/", 1)[-1] for r in references(body) if "/schemas/" in r]
                out.append((f"{stem}:{name}", text, kind, file, [f"{stem}:{r}" for r in refs if r in known]))
        yield pd.DataFrame(out, columns=["id", "document", "type", "source_file", "refs"])


def outlines(files: DataFrame) -> DataFrame:
    """(id, document, type, source_file, refs) of every endpoint and schema; files that do not parse give none."""
    visible(files.sparkSession)
    return files.select("file", "content").mapInPandas(_outlines, "id string, document string, type string, source_file string, refs array<string>")
