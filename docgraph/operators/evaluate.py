"""Retrieval quality over ranked results: (query, id, rank) against (query, id) that were expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def judged(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """``results`` with ``hit`` (1 or 0) and the query's number of relevant rows."""
    n = relevant.groupBy("query").agg(F.count_distinct("id").alias("expected"))
    marked = results.join(relevant.select("query", "id").distinct().withColumn("hit", F.lit(1)), ["query", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return marked.join(n, "query", "left").withColumn("expected", F.coalesce("expected", F.lit(0)))


def at_k(j: DataFrame, k: int) -> DataFrame:
    """(query, precision, recall, relevance, reciprocal_rank, average_precision, ndcg) over the first k ranks."""
    upto = W.Window.partitionBy("query").orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0)
    top = j.where(F.col("rank") <= k).withColumn("hits_so_far", F.sum("hit").over(upto))
    best = F.least(F.col("expected"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = top.groupBy("query", "expected").agg(
        F.sum("hit").alias("hits"),
        F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))).alias("rr"),
        F.sum(F.col("hit") * F.col("hits_so_far") / F.col("rank")).alias("ap"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.select("query", (F.col("hits") / k).alias("precision"), share(F.col("hits"), F.col("expected")).alias("recall"), share(F.col("hits"), best).alias("relevance"), F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"), share(F.col("ap"), best).alias("average_precision"), F.when(F.col("expected") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def suite(scores: DataFrame, score: str = "score", tokens: str = "tokens") -> DataFrame:
    """One row: mean score, queries at 0.9 or more, 0.7 or more and below, tokens on average and at most."""
    c = F.col(score)
    return scores.agg(F.count("*").alias("queries"), F.avg(c).alias("average"), F.count_if(c >= 0.9).alias("excellent"), F.count_if((c >= 0.7) & (c < 0.9)).alias("good"), F.count_if(c < 0.7).alias("poor"), F.avg(tokens).alias("average_tokens"), F.max(tokens).alias("most_tokens"))


def completeness(chunks: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(query, score): the share of wanted patterns that any of a query's chunks has."""
    flags = [F.max(F.col("document").rlike(p).cast("int")).alias(n) for n, p in wanted.items()]
    total = sum((F.col(n) for n in wanted), F.lit(0)) / len(wanted)
    return chunks.groupBy("query").agg(*flags).select("query", total.alias("score"), *wanted)


# The phrases that tell classes of questions apart, the interfaces looked for, and the points.
INTERFACES = {"display": "Sponsored Display", "brands": "Sponsored Brands", "products": "Sponsored Products"}


def answered(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, question, score): how far the chunks found (query, document, type, source_file) can answer a question.

    What a question needs goes by its class: how-to questions an endpoint and a schema, questions for fields a schema
    and properties, questions for interfaces several of them, questions for errors such texts and status codes; others
    any chunk. Questions without chunks score 0.
    """
    document, source, said = F.lower("document"), F.lower("source_file"), F.lower("question")
    found = F.lit(None)
    for part, name in reversed(INTERFACES.items()):
        found = F.when(source.contains(part), name).otherwise(found)
    flags = chunks.groupBy("query").agg(
        F.max(F.col("type") == "endpoint").alias("endpoint"),
        F.max(F.col("type") == "schema").alias("schema"),
        F.max(document.contains("properties")).alias("properties"),
        F.max(document.contains("error")).alias("error"),
        F.max(F.col("document").rlike(r"\b[45]\d{2}\b")).alias("codes"),
        F.count_distinct(F.when(source.contains("sponsored"), found)).alias("interfaces"),
        F.lit(True).alias("any"),
    )
    points = lambda name, n: F.when(F.col(name), n).otherwise(0.0)
    has = lambda *phrases: F.lit(False) if not phrases else said.contains(phrases[0]) | has(*phrases[1:])
    score = (
        F.when(has("how do i", "how to"), points("endpoint", 0.6) + points("schema", 0.4))
        .when(has("what fields", "what properties"), points("schema", 0.5) + points("properties", 0.5))
        .when(has("which apis", "what apis"), F.least(F.lit(1.0), F.coalesce("interfaces", F.lit(0)) * 0.4))
        .when(has("error"), points("error", 0.6) + points("codes", 0.4))
        .otherwise(points("any", 0.8))
    )
    return questions.join(flags, "query", "left").select("query", "question", F.least(F.lit(1.0), score).alias("score"))


def paired_t(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean, t) of the paired differences."""
    d = scores.select((F.col(a) - F.col(b)).alias("d"))
    return d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d")))).alias("t"))


def slower(now: DataFrame, before: DataFrame, most: float = 1.2) -> DataFrame:
    """(name, ratio) of what takes more than ``most`` times what it took."""
    return now.join(before.withColumnRenamed("seconds", "was"), "name").withColumn("ratio", F.col("seconds") / F.col("was")).where(F.col("ratio") > most).select("name", "ratio")
