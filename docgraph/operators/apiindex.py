"""A compact text for every specification, and contexts cut from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docgraph.functions.text import n_tokens
from docgraph.runtime import visible
from docgraph.sources.files import load_spec

INDEXED = ("get", "post", "put", "delete", "patch")


def endpoint_line(path: str, method: str, op: dict) -> str:
    summary = (op.get("summary") or "").strip()
    short = summary[:40] + "..." * (len(summary) > 40)
    tags = op.get("tags") or []
    bits = [f"{method.upper()} {path}", f"[{op['operationId']}]" if op.get("operationId") else "", f"({short})" if len(summary) > 5 else "", "{" + ",".join(tags[:2]) + "}" if tags else ""]
    return " ".join(b for b in bits if b)


def index_text(file: str, spec: dict, most: int = 20) -> str:
    """Name and title, global tags, first sentence of the description, and the first endpoints."""
    info = spec.get("info") or {}
    stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0][:12]
    title, about = info.get("title") or "", (info.get("description") or "").strip()
    given = ((t, (t.get("name") or "") if isinstance(t, dict) else t) for t in spec.get("tags") or [] if isinstance(t, (dict, str)))
    names = [n.strip() for t, n in given if n.strip() or isinstance(t, str)][:5]
    lines = [f"API: {stem}" + (f" - {title[:30]}" if title else "")]
    lines += [f"Tags: {', '.join(names)}"] if names else []
    first = about.split(".")[0][:80] if len(about) > 10 else ""
    lines += [f"Description: {first}"] if first else []
    every = ((p, m, op) for p, item in (spec.get("paths") or {}).items() if isinstance(item, dict) for m, op in item.items() if m.lower() in INDEXED)
    lines += [endpoint_line(p, m, op) for (p, m, op), _ in zip(every, range(most))]
    return "\n".join(lines)


def _index(frames, most: int):
    for frame in frames:
        out = []
        for file, raw in zip(frame.file, frame.content):
            spec, error = load_spec(file, bytes(raw))
            if not error and isinstance(spec, dict):
                out.append((file, index_text(file, spec, most)))
        yield pd.DataFrame(out, columns=["file", "text"])


def build_index(files: DataFrame, most: int = 20) -> DataFrame:
    """(file, text); files that do not parse are left out, a file that two roots share counts once."""
    visible(files.sparkSession)
    return files.select("file", "content").mapInPandas(lambda it: _index(it, most), "file string, text string").dropDuplicates(["file"])


def save_index(index: DataFrame, path: str) -> int:
    """Write as JSON lines; returns the tokens of all texts joined by blank lines."""
    index.write.mode("overwrite").json(path)
    total, files = index.agg(F.sum(F.length("text")), F.count("*")).head()
    return ((total or 0) + 2 * max(0, files - 1)) // 4


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) from JSON lines, from a ``files`` array with version, or from a mapping of files to descriptions."""
    raw = spark.read.option("multiLine", path.endswith(".json")).json(path)
    if "files" in raw.columns:
        return raw.select(F.explode("files").alias("f")).select("f.file", "f.text")
    if "text" in raw.columns:
        return raw.select("file", "text")
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "about"))
    return whole.select("file", F.get_json_object("about", "$.description").alias("text"))


def file_context(spark: SparkSession, path: str) -> str:
    """The files of an index as lines under a heading; a note where there is none. One line a file is what it is for."""
    try:
        lines = [r.line for r in file_lines(load_index(spark, path)).orderBy("line").collect()]
    except Exception:  # a missing or broken index must not stop a question
        return "Available API Files: (context unavailable)"
    return "\n".join(["Available API Files:", *lines])


def compact(index: DataFrame, most: int = 1200) -> DataFrame:
    """(text): texts in file order, each with two characters more, until the first that overflows; the first one alone
    is cut at its last whole line if even it does."""
    upto = W.Window.orderBy("file").rowsBetween(W.Window.unboundedPreceding, 0)
    # every text has two characters at least, so no more than most / 2 files can matter
    rows = index.orderBy("file").limit(most // 2 + 1).withColumn("used", F.sum(F.length("text") + 2).over(upto))
    fits = F.expr(f"listagg(case when used <= {most} then text end, '\n\n') within group (order by file)")
    head = F.substring(F.min_by("text", "file"), 1, most - 10)
    cut = F.when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    return rows.agg(F.coalesce(fits, cut, F.lit("")).alias("text"))


def file_lines(index: DataFrame) -> DataFrame:
    """(line): one for each file with the first line of its text."""
    first = F.split(F.col("text"), "\n")[0]
    return index.select(F.concat(F.lit("- "), "file", F.lit(": "), F.coalesce(F.nullif(first, F.lit("")), F.lit("API Documentation"))).alias("line"))


def index_tokens(index: DataFrame) -> DataFrame:
    return index.select("file", n_tokens(F.col("text")).alias("tokens"))
