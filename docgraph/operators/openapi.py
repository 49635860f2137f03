"""API specifications as chunks: validation, elements, references, splitting, rendering."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.runtime import visible
from docgraph.sources.config import Config
from docgraph.sources.files import load_spec, yaml

from . import graph

# The verbs and component sections of the specification format.
VERBS = ("get", "post", "put", "delete", "options", "head", "patch", "trace")
SECTIONS = ("schemas", "responses", "parameters", "examples", "requestBodies", "headers", "securitySchemes", "links", "callbacks")
MOST_CHARS = 8000


def version_supported(version: str, least: str) -> bool:
    try:
        have, want = ([int(x) for x in v.split(".")] for v in (version, least))
    except ValueError:
        return False
    size = max(len(have), len(want))
    return have + [0] * (size - len(have)) >= want + [0] * (size - len(want))


# The messages below.
def spec_errors(spec, config: Config = Config()) -> list[str]:
    """What is wrong with a specification, in order; nothing if it is valid."""
    if spec is None:
        return ["Specification data is None"]
    if not isinstance(spec, dict):
        return ["Specification data must be a dictionary"]
    checks = []
    version = spec.get("openapi", ...)
    if version is ...:
        checks.append("Missing required 'openapi' field")
    elif not isinstance(version, str):
        checks.append("OpenAPI version must be a string")
    elif not version_supported(version, config.min_openapi_version):
        checks.append(f"OpenAPI version {version} is below minimum required version {config.min_openapi_version}")
    if config.require_info_section:
        info = spec.get("info", ...)
        missing = [n for n in ("title", "version") if isinstance(info, dict) and n not in info]
        if info is ...:
            checks.append("Missing required 'info' section")
        elif not isinstance(info, dict):
            checks.append("Info section must be an object")
        elif missing:
            checks.append(f"Info section missing required '{missing[0]}' field")
    if config.require_paths_or_components and not {"paths", "components"} & spec.keys():
        checks.append("Specification must have either 'paths' or 'components' section")
    if "paths" in spec:
        checks += _path_errors(spec["paths"])
    if "components" in spec:
        parts = spec["components"]
        checks += [f"Component type '{k}' must be an object" for k, v in parts.items() if k in SECTIONS and not isinstance(v, dict)] if isinstance(parts, dict) else ["Components section must be an object"]
    return checks


def _path_errors(paths) -> list[str]:
    if not isinstance(paths, dict):
        return ["Paths section must be an object"]
    out = []
    for name, item in paths.items():
        if not isinstance(name, str):
            out.append(f"Path key must be a string, got {type(name).__name__}")
            continue
        out += [f"Path '{name}' must start with '/'"] * (not name.startswith("/"))
        out += [f"Path item for '{name}' must be an object"] * (not isinstance(item, dict))
    return out


def walk(content) -> tuple[list[str], int]:
    """Sorted distinct ``$ref`` strings anywhere in the content, and its depth."""
    found, level, depth = set(), [content], 0
    while level:
        below, depth = [], depth + 1
        for x in level:
            if isinstance(x, list):
                below += x
            elif isinstance(x, dict):
                ref = x.get("$ref")
                if isinstance(ref, str):
                    found.add(ref)
                below += [v for k, v in x.items() if not (k == "$ref" and isinstance(v, str))]
        level = below
    return sorted(found), depth


def references(content) -> list[str]:
    return walk(content)[0]


def render(content) -> str:
    try:
        return yaml.dump(content, default_flow_style=False, sort_keys=False, allow_unicode=True).strip()
    except Exception:  # what YAML cannot say is said as Python does
        return str(content)


def elements(spec: dict, file: str):
    """(id, type, name, content, extra columns) in the order info, tags, operations, components."""
    if "info" in spec:
        yield f"{file}:info", "info", "info", spec["info"], {}
    if spec.get("tags"):
        yield f"{file}:tags", "tags", "tags", spec["tags"], {}
    paths = spec.get("paths")
    for path, item in paths.items() if isinstance(paths, dict) else ():
        for verb in VERBS if isinstance(item, dict) else ():
            body = item.get(verb)
            if isinstance(body, dict):
                tags = body.get("tags", [])
                extra = {"path": path, "method": verb, "operation_id": str(body.get("operationId", "")), "tags": [str(t) for t in tags] if isinstance(tags, list) else []}
                yield f"{file}:paths{path}/{verb}", "operation", f"{path}/{verb}", {verb: body}, extra
    parts = spec.get("components")
    for kind, items in parts.items() if isinstance(parts, dict) else ():
        for name, body in items.items() if isinstance(items, dict) else ():
            yield f"{file}:components/{kind}/{name}", "component", str(name), {name: body}, {"component_type": str(kind), "component_name": str(name)}


def yaml_bound(content, most: int = MOST_CHARS) -> int:
    """At least the characters that YAML takes for the content, or any number above ``most``.

    A node takes its indent, marks and quotes; of a printable ASCII string each character may be doubled and each space
    be a line break, of any other each character may be a long escape on a line of its own.
    """
    total, waiting = 0, [(content, 1)]
    while waiting and total <= most:
        x, depth = waiting.pop()
        total += 40 + 2 * depth
        if isinstance(x, str):
            total += 2 * len(x) + x.count(" ") * (6 + 2 * depth) if x.isascii() and x.isprintable() else len(x) * (16 + 2 * depth)
        elif isinstance(x, dict):
            waiting += [(y, depth + 1) for pair in x.items() for y in pair]
        elif isinstance(x, list):
            waiting += [(y, depth + 1) for y in x]
        elif isinstance(x, int):
            total += x.bit_length()
        elif x is not None and not isinstance(x, float):
            return most + 1
    return total


def _succeeds(code) -> bool:
    try:
        return 200 <= int(str(code)) <= 299
    except ValueError:
        return False


def split(kind: str, content) -> list[tuple[str, str | None, object]]:
    """(id suffix, chunk type, content) of an element: an operation without its failing responses, and those; an
    oversize component without its examples, and those."""
    if kind == "operation":
        [(verb, body)] = content.items()
        answers = body.get("responses") or {}
        good = {k: v for k, v in answers.items() if _succeeds(k)}
        bad = {k: v for k, v in answers.items() if not _succeeds(k)}
        main = {k: v for k, v in body.items() if k != "responses"} | ({"responses": good} if good else {})
        return [("", "operation", {verb: main})] + ([(":errors", "error_responses", {f"{verb}_error_responses": bad})] if bad else [])
    if kind == "component" and yaml_bound(content) > MOST_CHARS and len(yaml.dump(content, default_flow_style=False)) > MOST_CHARS:
        [(name, body)] = content.items()
        if isinstance(body, dict):  # anything else stays whole
            shown = {k: v for k, v in body.items() if k in ("example", "examples")}
            rest = {k: v for k, v in body.items() if k not in shown}
            return [("", "definition", {name: rest})] + ([(":examples", "examples", {f"{name}_examples": shown})] if shown else [])
    return [("", None, content)]


ELEMENTS = """file string, success boolean, errors array<string>, pos int, id string, document string, type string,
 chunk_type string, natural_name string, path string, method string, operation_id string, tags array<string>,
 component_type string, component_name string, content_hash string, refs array<string>, child string, parent string,
 ref_ids map<string,array<string>>, ref_order array<string>, referenced_by array<string>"""
TYPES = dict(c.split(maxsplit=1) for c in ELEMENTS.replace("\n", "").split(", "))
COLUMNS = list(TYPES)
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,array<string>>": pa.map_(pa.string(), pa.list_(pa.string()))}
#: Strings in lists after which rows go to Spark, so that a worker holds few files, and operations this deep are rendered
#: even if nobody asks, as rendering may fail on them.
BATCH, DEEP = 50_000, 50


def link(rows: list[dict], file: str, closed: bool = True) -> None:
    """Adds to the elements of one file what they refer to, in order, and what refers to them.

    References hold within a file; those to no element, or to what was split off, go. An element keeps all references
    it had before the split and gets what was split off last, which refers to its parent alone. ``closed`` adds to each
    direct reference the sorted set of all that it reaches, itself excluded.
    """
    whole = {r["id"] for r in rows if r["parent"] is None}
    links: dict[str, dict[str, int]] = {}
    for r in rows:
        own = links.setdefault(r["id"], {})
        for pos, ref in enumerate(r["refs"]):
            if ref.startswith("#/") and (dst := f"{file}:{ref[2:]}") in whole:
                own[dst] = min(pos, own.get(dst, pos))
    after = {src: list(own) for src, own in links.items()}
    deps = {dst: reach(after, dst) for own in after.values() for dst in own} if closed else {}
    back: dict[str, set[tuple[int, str]]] = {}
    for r in rows:
        for dst, pos in ((r["child"], 1 << 30), (r["parent"], 0)):
            if dst is not None:
                links[r["id"]].setdefault(dst, pos)
    order = {src: [dst for _, dst in sorted((pos, dst) for dst, pos in own.items())] for src, own in links.items()}
    for r in rows:
        for dst in order[r["id"]]:
            back.setdefault(dst, set()).add((r["pos"], r["id"]))
    for r in rows:
        r["ref_order"] = order[r["id"]]
        r["referenced_by"] = [src for _, src in sorted(back.get(r["id"], ()))]
        if closed:
            # what was split off, and its parent seen from there, say nothing of what they reach
            r["ref_ids"] = [(dst, deps[dst] if dst in after[r["id"]] else []) for dst in order[r["id"]]]


def reach(after: dict[str, list[str]], start: str) -> list[str]:
    """Sorted nodes that can be reached from ``start``, itself excluded."""
    seen, waiting = {start}, [start]
    while waiting:
        for x in after.get(waiting.pop(), ()):
            if x not in seen:
                seen.add(x)
                waiting.append(x)
    seen.discard(start)
    return sorted(seen)


def _file_elements(file: str, raw: bytes, config: Config, columns: set[str]) -> list[dict]:
    spec, error = load_spec(file, raw)
    errors = [error] if error else spec_errors(spec, config)
    rows = []
    try:
        for name, kind, natural, content, extra in () if errors else elements(spec, file):
            parts = split(kind, content)
            refs, depth = walk(content)
            for suffix, chunk_type, part in parts:
                row = {"file": file, "success": True, "errors": [], "pos": len(rows), "id": name + suffix, "type": kind, "chunk_type": chunk_type, "natural_name": natural, **extra, "refs": [] if suffix else refs, "child": name + parts[1][0] if not suffix and len(parts) > 1 else None, "parent": name if suffix else None}
                if depth > DEEP or columns & {"document", "content_hash"}:
                    row["document"] = text = render(part)
                    row["content_hash"] = hashlib.sha256(text.encode()).hexdigest()[:16]
                rows.append(row)
    except Exception as e:  # one bad file gives no chunks, and says why
        rows, errors = [], [f"cannot extract: {e}"]
    if columns & {"ref_ids", "ref_order", "referenced_by"}:
        link(rows, file, "ref_ids" in columns)
    return rows or [{"file": file, "success": not errors, "errors": errors}]


def _elements(batches, config: Config, columns: list[str]):
    kinds = [ARROW[TYPES[c]] for c in columns]
    lists = [c for c in columns if TYPES[c].startswith("array")]
    out, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], kind) for c, kind in zip(columns, kinds)], columns)

    for given in batches:
        for file, raw in zip(given.column("file"), given.column("content")):
            for row in _file_elements(file.as_py(), raw.as_py(), config, set(columns)):
                out.append(row)
                held += len(columns) + sum(len(row.get(c) or ()) for c in lists) + (sum(1 + len(d) for _, d in row.get("ref_ids", ())) if "ref_ids" in columns else 0)
                if held >= BATCH:
                    yield batch()
                    out, held = [], 0
    if out:
        yield batch()


def parse_elements(files: DataFrame, config: Config = Config(), columns: list[str] = COLUMNS) -> DataFrame:
    """Elements of all files, split and rendered, with their links; files without any give one row with their errors and
    a null id. What is not among ``columns`` is not worked out."""
    visible(files.sparkSession)
    schema = ", ".join(f"{c} {TYPES[c]}" for c in columns)
    return files.select("file", "content").mapInArrow(lambda it: _elements(it, config, columns), schema)


def rejected(parsed: DataFrame) -> DataFrame:
    """(file, errors): the dead letters."""
    return parsed.where(~F.col("success")).select("file", "errors")


def resolve(ref, file):
    """Chunk id of an internal reference; null for any other."""
    return F.when(ref.startswith("#/"), F.concat(file, F.lit(":"), F.expr("substring(ref, 3)")))


def reference_edges(parsed: DataFrame) -> DataFrame:
    """(file, src, dst, pos): references between elements of one file, dangling ones left out."""
    each = parsed.where("id is not null and parent is null").select("file", F.col("id").alias("src"), F.posexplode("refs").alias("pos", "ref"))
    each = each.withColumn("dst", resolve(F.col("ref"), F.col("file"))).where("dst is not null").select("file", "src", "dst", "pos")
    return graph.existing(each, parsed.where("id is not null and parent is null"))


#: Columns of chunks from those of elements.
CHUNKS = {
    **{c: c for c in ("id", "document", "type")}, "source_file": "file",
    **{c: c for c in ("natural_name", "content_hash", "path", "method", "operation_id", "tags", "component_type", "component_name", "chunk_type")},
    "error_responses": "case when chunk_type = 'operation' then child end", "parent_operation": "case when chunk_type = 'error_responses' then parent end",
    "has_examples": "case when chunk_type = 'definition' then child end", "parent_definition": "case when chunk_type = 'examples' then parent end",
    "api_info_ref": "concat(file, ':info')", "api_tags_ref": "concat(file, ':tags')",
    **{c: c for c in ("ref_ids", "ref_order", "referenced_by", "pos")},
}


def build_chunks(parsed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chunks with ``ref_ids`` (each direct reference with all that it reaches), their order, and ``referenced_by``, as
    ``link`` finds them file by file; all columns, or those named."""
    return parsed.where("id is not null").select(*[F.expr(CHUNKS[c]).alias(c) for c in columns or CHUNKS])


def process(files: DataFrame, config: Config = Config(), columns: list[str] | None = None) -> DataFrame:
    """Chunks of all files, without a shuffle; what the columns named do not need is not worked out."""
    needed = [c for c in COLUMNS if c == "id" or any(re.search(rf"\b{c}\b", CHUNKS[x]) for x in columns or CHUNKS)]
    return build_chunks(parse_elements(files, config, needed), columns)
