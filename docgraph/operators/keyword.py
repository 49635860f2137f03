"""Keyword and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_words(query: str) -> list[str]:
    return [w for w in query.lower().split() if len(w) > 2]


def contains_any(chunks: DataFrame, query: str, text: str = "document") -> DataFrame:
    """Rows whose text holds a word of the query; words are lower-cased, texts are not."""
    words = query_words(query)
    found = F.lit(False)
    for w in words:
        found = found | F.col(text).contains(w)
    return chunks.where(found)


def hybrid(semantic: DataFrame, keyword: DataFrame, limit: int, key: str = "id", weight: float = 0.7) -> DataFrame:
    """(key, score) ascending: weighted distances, lowered where both searches found the row."""
    s, k = semantic.select(key, F.col("distance").alias("s")), keyword.select(key, F.col("distance").alias("k"))
    both = F.col("s") * weight * 0.5 + F.col("k") * (1 - weight)
    score = F.when(F.col("s").isNotNull() & F.col("k").isNotNull(), both).when(F.col("s").isNotNull(), F.col("s") * weight).otherwise(F.col("k") * 0.5)
    return s.join(k, key, "full_outer").withColumn("score", score).orderBy("score", key).limit(limit)


# Words that a question's word stands for, and the words that ask for a type of chunk.
SYNONYMS = {
    "campaign": ["campaigns", "campaignid"],
    "create": ["post", "add", "new"],
    "get": ["retrieve", "fetch", "show"],
    "list": ["retrieve", "fetch", "show"],
    "error": ["exception", "failure", "problem"],
    "field": ["property", "attribute", "parameter"],
}
TYPE_WORDS = {"endpoint": ["create", "get", "list", "update", "delete"], "schema": ["field", "property", "schema", "object"]}


def weighted_terms(query: str) -> tuple[list[str], str | None]:
    """The words of a question with their synonyms, and the type of chunk that it asks for, if any."""
    said = query.lower().split()
    terms = list(dict.fromkeys(said + [x for w in said for x in SYNONYMS.get(w, [])]))
    return terms, next((kind for kind, words in TYPE_WORDS.items() if any(w in terms for w in words)), None)


def weighted(chunks: DataFrame, terms: list[str], limit: int, boost_type: str | None = None, key: str = "id") -> DataFrame:
    """(key, score) descending: of each term 3 points if the operation id holds it, else 2 if the document does, else 1
    if the metadata does, and one more for chunks of the type asked for, with a term or without; rows without points
    are left out."""
    score = F.lit(0)
    for term in dict.fromkeys(t.lower() for t in terms):
        holds = [(F.lower(c).contains(term), points) for c, points in (("operation_id", 3), ("document", 2), ("metadata", 1)) if c in chunks.columns]
        best = F.when(*holds[0])
        for more in holds[1:]:
            best = best.when(*more)
        score = score + best.otherwise(0)
    if boost_type:
        score = score + F.when(F.col("type") == boost_type, 1).otherwise(0)
    return chunks.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def one_hop(hits: DataFrame, edges: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """Chunks that hits refer to and that are no hits, at their first reference's place, scored 0.5."""
    firsts = hits.select(F.col(key).alias("src"), F.col("rank")).join(edges, "src").groupBy(F.col("dst").alias(key)).agg(F.min(F.struct("rank", "pos")).alias("at"))
    return firsts.join(hits.select(key), key, "left_anti").join(chunks, key).withColumn("score", F.lit(0.5)).orderBy("at", key)


def enriched(chunks: DataFrame, extra: DataFrame, key: str = "id", text: str = "document") -> DataFrame:
    """Chunks with added metadata by id; the document gets what was added as lines."""
    names = [c for c in extra.columns if c != key]
    lines = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in names]
    return chunks.join(extra, key, "left").withColumn(text, F.concat_ws("\n", F.col(text), *lines))


def lists_as_csv(df: DataFrame) -> DataFrame:
    arrays = [f.name for f in df.schema.fields if f.dataType.simpleString() == "array<string>"]
    return df.withColumns({c: F.array_join(c, ",") for c in arrays})


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)
