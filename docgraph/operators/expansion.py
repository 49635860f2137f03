"""Query expansion by an injected language model."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


PROVIDERS: dict[str, Callable[..., Generator]] = {}


def provider(name: str, **options) -> Generator:
    """A registered model; which services exist is up to the caller."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name](**options)


FIELDS = ("keywords", "paths", "ops")


def prompt(query: str, context: str) -> str:
    return f"""Rewrite the request so that it matches operation ids, methods, paths, tags and parameter names of the index.
Answer with three lines and nothing else:
keywords: comma-separated words and synonyms
paths: space-separated paths, whole or in part
ops: comma-separated operation ids, if any

Index:
{context}

Request:
{query}"""


def parse(text: Column) -> Column:
    """Struct of the three fields of an answer; of several lines for a field the last holds."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def field(i):
        own = F.filter(lines, lambda x: _first_of(x, i))
        said = F.btrim(F.trim(F.regexp_extract(F.try_element_at(own, F.lit(-1)), f"(?i)^.*?{FIELDS[i]}:(.*)$", 1)), F.lit("`"))
        return F.coalesce(said, F.lit("")).alias(FIELDS[i])

    return F.struct(*[field(i) for i in range(3)])


def _first_of(line: Column, i: int) -> Column:
    """Whether a line names the field, and none before it."""
    found = line.rlike(f"(?i){FIELDS[i]}:")
    for f in FIELDS[:i]:
        found = found & ~line.rlike(f"(?i){f}:")
    return found


def merge(parsed: Column) -> Column:
    """One search string; commas of keywords and operation ids become blanks."""
    parts = F.array(F.translate(parsed["keywords"], ",", " "), parsed["paths"], F.translate(parsed["ops"], ",", " "))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def expand_query(spark, query: str, context: str, model: Generator | None) -> str:
    """The expanded query, or the query itself if the model fails or says nothing."""
    try:
        answer = model.generate(prompt(query, context))
        out = spark.createDataFrame([(answer,)], "a string").select(merge(parse(F.col("a"))).alias("q")).head().q
        return out or query
    except Exception:  # a question is never lost to its expansion
        return query
