"""Summaries, responses and stored forms of chunks: documents stand for chunks, their vectors for embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docgraph.functions import text as t
from docgraph.operators import keyword, markdown, retrieval, store
from docgraph.runtime import checkpoint_folder

from .registry import query, table
from .search import HITS, modular_edges


def _chunks(spark, sf_dir):
    """Documents that have a vector, with two references each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("source").alias("source_file"), F.col("lang").alias("type"))
    refs = modular_edges(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"].cast("string")).alias("refs"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return docs.join(vectors, "id").join(refs, "id")


def _query(chunks):
    return chunks.where("id = 0").select("embedding").head()[0]


NEAR = f"n as (select h.vec_id as id, distance, text, source, lang, label from ({HITS}) h join documents on doc_id = vec_id)"


@query(
    f"""with {NEAR}, k as (select * from n where contains(lower(source), 'src1') order by distance, id limit 12)
    select id as chunk_id, case when label % 2 = 0 then source || ':' || id else 'label ' || label end as title, round(least(1, greatest(0, 1 - distance)), 6) as relevance_score, source as file_name, lang as chunk_type from k where id % 5 <> 0"""
)
def search_summaries(spark, sf_dir):
    """Hits in files whose name holds a part, as summaries; excluded ids are not filled up."""
    found, _ = _searched(spark, sf_dir, 12, exclude=True)
    return found.select("chunk_id", "title", F.round("relevance_score", 6).alias("relevance_score"), "file_name", "chunk_type")


def _searched(spark, sf_dir, limit, exclude=False):
    """A search of a store of the documents that have a vector."""
    chunks = _chunks(spark, sf_dir).withColumn("natural_name", F.when(F.col("label") % 2 == 0, "").otherwise(F.concat(F.lit("label "), "label"))).drop("refs")
    kept = store.ChunkStore(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}").setup()
    kept.add(chunks)
    fifth = [r.id for r in chunks.where("id % 5 = 0").select("id").collect()] if exclude else None  # an agent's list
    return retrieval.search_chunks(kept, _query(chunks), limit, "SRC1", fifth)


@query(f"with {NEAR}, k as (select * from n where contains(lower(source), 'src1') order by distance, id limit 12) select list_sort(list(distinct source)) as files_searched from k")
def files_searched(spark, sf_dir):
    return _searched(spark, sf_dir, 12)[1]


RAW = f"""{NEAR}, k as (select *, row_number() over (order by distance, id) as rank from n order by distance, id limit 10),
s as (select *, '=== ' || id || ' ===' || chr(10) || text || chr(10) as part from k),
u as (select *, sum(length(part) + 1) over (order by rank) - 1 as used from s)"""


@query(f"with {RAW}, b as (select *, bool_and(used // 4 <= 1500) over (order by rank rows unbounded preceding) as fits from u) select string_agg(part, chr(10) order by rank) as response from b where fits")
def response_raw(spark, sf_dir):
    """Ten hits as raw text within 1500 tokens."""
    chunks = _chunks(spark, sf_dir)
    rows = store.top_k(chunks, _query(chunks), 10).drop("embedding").orderBy("rank").collect()
    hits = [retrieval.Hit(str(r.id), r.document, {}, 1 - r.distance, "primary_result") for r in rows]
    said = retrieval.respond(retrieval.Context("q", hits, []), 1500, "raw")
    return spark.createDataFrame([(said,)], "response string")


@query(f"with {NEAR}, k as (select * from n order by distance, id limit 10) select 0 as query, sum(length(text) // 4)::bigint as total_tokens from k")
def context_tokens(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    hits = store.top_k(chunks, _query(chunks), 10).withColumn("query", F.lit(0))
    return retrieval.summed_tokens(hits)


@query("""with v as (select count(*) as n from embeddings) select vec_id as id, '["' || ((vec_id * 7 + 1) % n) || '","' || ((vec_id * 3 + 2) % n) || '"]' as refs from embeddings, v where vec_id in (select doc_id from documents)""")
def metadata_flat(spark, sf_dir):
    """Nested fields as JSON text."""
    return store.flatten_metadata(_chunks(spark, sf_dir).select("id", "refs"))


@query("select true as round_trips")
def metadata_round_trip(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select("id", F.col("refs").alias("referenced_by"), F.map_from_arrays(F.array_distinct("refs"), F.transform(F.array_distinct("refs"), lambda x: F.array(x))).alias("ref_ids"))
    return store.round_trips(chunks)


@query("with v as (select count(*) as n from embeddings) select vec_id as id, ((vec_id * 7 + 1) % n) || ',' || ((vec_id * 3 + 2) % n) as refs from embeddings, v where vec_id in (select doc_id from documents)")
def lists_as_csv(spark, sf_dir):
    return keyword.lists_as_csv(_chunks(spark, sf_dir).select("id", "refs"))


@query(
    """with s as (select conv_id as file, turn as pos, role as slug, row_number() over (partition by conv_id, role order by turn) as n from conversations)
    select file, pos, slug || case when n > 1 then '-' || n else '' end as identifier from s"""
)
def unique_section_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), "role")
    return markdown.unique_ids(rows, t.slug_header(F.col("role"))).select("file", "pos", "identifier")


@query(
    """select conv_id || ':' || turn as id, 'missing document' as problem from conversations where trim(text) = '' or text is null
    union all select conv_id || ':' || turn, 'duplicate id' from conversations group by conv_id, turn having count(*) > 1
    union all select conv_id || ':' || turn, 'negative chunk_index' from conversations where turn - 1 < 0"""
)
def chunk_validation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    chunks = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.trim("text").alias("document"), F.col("role").alias("type"), F.col("conv_id").cast("string").alias("source_file"), (F.col("turn") - 1).alias("chunk_index"), *[F.lit(None).cast("string").alias(n) for n in markdown.LINKS], *[none.alias(n) for n in markdown.LISTS])
    return markdown.validate(chunks)
