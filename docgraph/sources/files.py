"""Files as tables: API specifications and Markdown, from directories, lists or memory, parsed with typed errors."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.runtime import visible

try:
    import yaml
except ImportError:  # then only JSON can be read
    yaml = None

SPECS, MARKDOWN = (".json", ".yaml", ".yml"), (".md", ".markdown")


def _status(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    status = fs.getFileStatus(path)
    if not status.isDirectory():
        raise NotADirectoryError(root)
    return fs.makeQualified(path).toString()


def _relative(path, root: str):
    """Path below the root; schemes and slashes may be written differently in the two."""
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/*", "/"), "^\\Q" + base + "\\E", "")


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(file, content) of all files below ``root`` by suffix in any case; names that start with a dot, and all below
    such directories, are left out. Missing roots and files in their place are errors."""
    base = _status(spark, root)
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in suffixes) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    file = _relative(F.col("path"), base)
    wanted = F.lower(file).rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$")
    return found.select(file.alias("file"), "content").where(wanted & ~F.col("file").rlike(r"(^|/)\."))


def scan_specs(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, SPECS)


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, MARKDOWN)


def read_files(spark: SparkSession, paths: list[str], base: str | None = None) -> DataFrame:
    """(file, content) of the given files, named below ``base`` if one is given."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select((_relative(F.col("path"), base) if base else F.element_at(F.split("path", "/"), -1)).alias("file"), "content")


def in_memory(spark: SparkSession, contents: dict[str, str]) -> DataFrame:
    rows = [(k, bytearray(v.encode())) for k, v in contents.items()]
    return spark.createDataFrame(rows, "file string, content binary")


FLOW = re.compile(r"\{[ -\[\]-~]*\}\n?")


def _refuse(text):
    raise ValueError(text)


def _flow(text: str) -> dict | None:
    """YAML that is JSON too and means the same in both; null for any other, which takes YAML's own, far slower reader.

    One line of printable ASCII without escapes, no fractions or constants, and nowhere 500 characters without a quote,
    as YAML wants the colon within 1024 characters of where a key begins.
    """
    if FLOW.fullmatch(text) and max(map(len, text.split('"'))) < 500:
        try:
            return json.loads(text, parse_float=_refuse, parse_constant=_refuse)
        except (ValueError, RecursionError):
            pass
    return None


def load_spec(file: str, raw: bytes) -> tuple[object, str | None]:
    """(data, error) of one specification, by its suffix."""
    kind = file.lower().rsplit(".", 1)[-1]
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return None, f"not UTF-8: {e}"
    if kind == "json":
        try:
            return json.loads(text), None
        except ValueError as e:
            return None, f"invalid JSON: {e}"
    if kind in ("yaml", "yml"):
        if yaml is None:
            return None, "YAML is not available"
        if (data := _flow(text)) is not None:
            return data, None
        try:
            return yaml.safe_load(text), None
        except yaml.YAMLError as e:
            return None, f"invalid YAML: {e}"
    return None, f"unsupported file type: {kind}"


FENCE = re.compile(r"^-{3,}\s*$", re.MULTILINE)


def front_matter(text: str) -> tuple[dict, str]:
    """Fields and body of Markdown; the body is stripped. Text that does not open with a fence has no fields."""
    text = text.strip()
    if yaml is None or not FENCE.match(text):
        return {}, text
    parts = FENCE.split(text, maxsplit=2)
    if len(parts) < 3:
        return {}, text
    data = yaml.safe_load(parts[1])
    return (data if isinstance(data, dict) else {}), parts[2].strip()


PARSED = """file string, success boolean, error string, content string, front string, front_small string, front_yaml string,
 fields map<string,string>, tags array<string>"""


def _plain(x):
    """Values that JSON can hold: null as '', and left out of lists; other objects as text."""
    if x is None:
        return ""
    if isinstance(x, (str, int, float, bool)):
        return x
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x if v is not None]
    return str(x)


def _parse_markdown(frames):
    names = ["title", "author", "description", "category", "created", "published", "updated"]
    for frame in frames:
        out = []
        for file, raw in zip(frame.file, frame.content):
            try:
                data, body = front_matter(bytes(raw).decode("utf-8"))
                tags = data.get("tags", [])
                tags = [tags] if isinstance(tags, str) else [str(t) for t in tags] if isinstance(tags, list) else []
                small = {k: data.get(k) for k in ("title", "author")} | {"tags": data.get("tags", []), "category": data.get("category")}
                front = json.dumps(_plain(data)) if data else None
                text = yaml.dump(data, default_flow_style=False) if data else None
                out.append((file, True, None, body, front, json.dumps(_plain(small)) if data else None, text, {k: str(data[k]) for k in names if k in data}, tags))
            except UnicodeDecodeError as e:
                out.append((file, False, f"not UTF-8: {e}", None, None, None, None, {}, []))
            except Exception as e:  # broken front matter of one file must not end the others
                said = "invalid front matter" if yaml is not None and isinstance(e, yaml.YAMLError) else "cannot parse"
                out.append((file, False, f"{said}: {e}", None, None, None, None, {}, []))
        yield pd.DataFrame(out, columns=["file", "success", "error", "content", "front", "front_small", "front_yaml", "fields", "tags"])


def parse_markdown(files: DataFrame) -> DataFrame:
    """One row a file, with ``success`` and ``error``; a file that fails does not touch the others."""
    visible(files.sparkSession)
    return files.select("file", "content").mapInPandas(_parse_markdown, PARSED)


def read_chunks_json(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Chunks exported as JSON, first of each id by its place; optionally the first ``sample`` ids by order."""
    rows = spark.read.option("multiLine", True).json(path)
    names = rows.columns
    out = rows.withColumn("__at", F.monotonically_increasing_id()).groupBy("id").agg(F.min_by(F.struct(*names), "__at").alias("row"), F.min("__at").alias("__at"))
    return (out.orderBy("__at").limit(sample) if sample else out).select("row.*")
