"""Decisions, expansions and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import apiindex, evaluate, expansion, markdown, retrieval

from .registry import query, table

LINES = """l as (select conv_id, 'c' || (turn % 4) as key, case when turn % 3 = 0 then 'KEEP' when turn % 3 = 1 then 'DISCARD' else 'EXPAND_3' end as action, turn from conversations)"""


def _decisions(spark, sf_dir):
    turn = F.col("turn")
    action = F.when(turn % 3 == 0, "KEEP").when(turn % 3 == 1, "DISCARD").otherwise("EXPAND_3")
    line = F.concat(F.lit("  c"), (turn % 4).cast("string"), F.lit(" -> "), action, F.lit(" "))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "\nno decision\n").alias("said"))
    return said.select("conv_id", F.explode(retrieval.parse_decisions(F.col("said"))).alias("key", "action"))


@query(f"with {LINES} select conv_id, key, arg_max(action, turn) as action from l group by all")
def decisions_parse(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query(f"with {LINES}, d as (select conv_id, key, arg_max(action, turn) as action from l group by all) select conv_id, c.turn, action from conversations c join d using (conv_id) where key = 'c' || c.turn and action <> 'DISCARD'")
def decisions_apply(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", F.col("conv_id"), F.concat(F.lit("c"), F.col("turn"))).alias("chunk_id"))
    decided = _decisions(spark, sf_dir).select(F.concat_ws(":", "conv_id", "key").alias("key"), "action")
    return retrieval.apply_decisions(chunks, decided).select("conv_id", "turn", "action")


@query(
    """select doc_id, trim(concat_ws(' ', nullif(replace(lang || ',' || source, ',', ' '), ''), nullif('/v1/' || lang, ''), nullif(replace('get' || source || ',put', ',', ' '), ''))) as merged from documents"""
)
def expansion_merge(spark, sf_dir):
    answer = F.concat(F.lit("noise\nKeywords: "), F.col("lang"), F.lit(","), F.col("source"), F.lit("\n2. `paths:` /old\npaths: `/v1/"), F.col("lang"), F.lit("`\nOPS: get"), F.col("source"), F.lit(",put"))
    return table(spark, sf_dir, "documents").select("doc_id", expansion.merge(expansion.parse(answer)).alias("merged"))


@query("select count(*) as chunks, count(distinct source) as files, round(avg(len(regexp_extract_all(text, '\\S+'))), 1) as average_words, sum(len(regexp_extract_all(text, '\\S+')))::bigint as total_words from documents")
def processing_stats(spark, sf_dir):
    return markdown.processing_stats(_as_chunks(spark, sf_dir)).select(F.col("total_chunks").alias("chunks"), F.col("total_files").alias("files"), "average_words", "total_words")


def _as_chunks(spark, sf_dir):
    words = F.regexp_count("text", F.lit(r"\S+"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.col("lang").alias("type"), F.col("source").alias("source_file"), words.alias("word_count"))


@query("select lang as type, count(*) as n from documents group by lang")
def chunk_type_counts(spark, sf_dir):
    return markdown.processing_stats(_as_chunks(spark, sf_dir)).select(F.explode("chunk_types").alias("type", "n"))


WRONG = ["Missing required field: total_chunks", "Missing required field: content_hash", "word_count must be an integer", "document_tags must be a list", "has_tables must be a boolean"]


@query(
    f"""select doc_id::varchar as id, unnest({WRONG}) as problem from documents
    union all select doc_id::varchar, 'Missing required field: title' from documents where doc_id % 3 = 0
    union all select doc_id::varchar, 'has_images must be a boolean' from documents where doc_id % 7 = 0"""
)
def metadata_validation(spark, sf_dir):
    """Chunks with fields that are absent, null, or of a wrong type where they hold something."""
    c = _as_chunks(spark, sf_dir).withColumn("n", F.col("id").cast("long"))
    c = c.withColumns({"word_count": F.col("word_count").cast("string"), "title": F.when(F.col("n") % 3 > 0, F.col("type")), "section_level": F.lit(1), "chunk_index": F.lit(0)})
    c = c.withColumns({"content_hash": F.lit(None).cast("string"), "document_tags": F.lit("a,b"), "has_tables": F.lit(1), "has_images": F.when(F.col("n") % 7 == 0, "yes"), "child_sections": F.array(F.lit("x")), "is_split_section": F.lit(False)})
    return markdown.validate_metadata(c)


@query(
    """with q as (select distinct source, case regexp_extract(source, '[0-9]+')::int % 5 when 0 then 'How do I ' when 1 then 'What fields of ' when 2 then 'Which APIs have ' when 3 then 'the ERROR in ' else 'about ' end || source as question from documents),
    f as (select source, max((lang = 'en')::int) as e, max((lang = 'fr')::int) as s, max(contains(lower(text), 'properties')::int) as p, max(contains(lower(text), 'error')::int) as r,
      max(regexp_matches(text, '\\b[45][0-9]{2}\\b')::int) as c, count(distinct case when doc_id % 4 < 3 then doc_id % 4 end) as n from documents where regexp_extract(source, '[0-9]+')::int <> 19 group by source)
    select q.source as query, question, round(coalesce(case regexp_extract(q.source, '[0-9]+')::int % 5 when 0 then 0.6 * e + 0.4 * s when 1 then 0.5 * s + 0.5 * p when 2 then least(1.0, 0.4 * n) when 3 then 0.6 * r + 0.4 * c
      else case when f.source is null then 0.0 else 0.8 end end, 0.0)::double, 6) as score from q left join f on f.source = q.source"""
)
def answered_by_class(spark, sf_dir):
    """Completeness by the class of the question; one source has a question and no chunks."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    docs = table(spark, sf_dir, "documents")
    start = F.when(number % 5 == 0, "How do I ").when(number % 5 == 1, "What fields of ").when(number % 5 == 2, "Which APIs have ").when(number % 5 == 3, "the ERROR in ").otherwise("about ")
    questions = docs.select(F.col("source").alias("query"), F.concat(start, "source").alias("question")).distinct()
    kind = F.when(F.col("lang") == "en", "endpoint").when(F.col("lang") == "fr", "schema").otherwise("other")
    file = F.element_at(F.array(*[F.lit(f"Sponsored_{x}.json") for x in ("Display", "Brands", "Products", "Rest")]), (F.col("doc_id") % 4 + 1).cast("int"))
    chunks = docs.where(number != 19).select(F.col("source").alias("query"), F.col("text").alias("document"), kind.alias("type"), file.alias("source_file"))
    return evaluate.answered(questions, chunks).withColumn("score", F.round("score", 6))


PARTS = """select p_brand as file, 'API: ' || p_brand || chr(10) || string_agg('GET /parts/' || p_partkey || ' [get' || p_size || ']', chr(10) order by p_partkey) as text
  from (select *, row_number() over (partition by p_brand order by p_partkey) as rn from part) where rn <= 20 group by p_brand"""


def _index(spark, sf_dir):
    """Index texts of specifications, one a brand, with an operation for each of its parts."""
    path = F.concat(F.lit('"/parts/'), "p_partkey", F.lit('": {"get": {"operationId": "get'), "p_size", F.lit('"}}'))
    rows = table(spark, sf_dir, "part").withColumn("path", path)
    paths = rows.groupBy(F.col("p_brand").alias("file")).agg(F.expr("listagg(path, ', ') within group (order by p_partkey)").alias("l"))
    specs = paths.select("file", F.encode(F.concat(F.lit('{"openapi": "3.0.0", "paths": {'), "l", F.lit("}}")), "utf-8").alias("content"))
    return apiindex.build_index(specs.withColumn("file", F.concat("file", F.lit(".json")))).withColumn("file", F.regexp_replace("file", r"\.json$", ""))


@query(PARTS)
def index_text(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"with i as ({PARTS}), c as (select *, sum(length(text) + 2) over (order by file) as used from i) select string_agg(text, chr(10) || chr(10) order by file) as text from c where used <= 1800")
def compact_context(spark, sf_dir):
    return apiindex.compact(_index(spark, sf_dir), 1800)


@query(f"with i as ({PARTS}) select '- ' || file || ': ' || string_split(text, chr(10))[1] as line from i")
def context_lines(spark, sf_dir):
    return apiindex.file_lines(_index(spark, sf_dir))


@query(
    """with s as (select doc_id, (quality + (1 - toxic)) / 2.0::double as score, length(text) // 4 as tokens from labels join documents using (doc_id))
    select count(*) as queries, round(avg(score), 6) as average, count(*) filter (score >= 0.9) as excellent, count(*) filter (score >= 0.7 and score < 0.9) as good, count(*) filter (score < 0.7) as poor,
      round(avg(tokens), 3) as average_tokens, max(tokens)::int as most_tokens from s"""
)
def suite_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    scores = rows.select(((F.col("quality") + 1 - F.col("toxic")) / 2.0).alias("score"), F.floor(F.length("text") / 4).cast("int").alias("tokens"))
    return evaluate.suite(scores).withColumn("average", F.round("average", 6)).withColumn("average_tokens", F.round("average_tokens", 3))


@query(
    """with f as (select source as query, max(regexp_matches(text, 'idiot')::int) as rude, max(regexp_matches(text, '[0-9]{3}-[0-9]{4}')::int) as phone, max(regexp_matches(text, '!!')::int) as loud from documents group by source)
    select query, round((rude + phone + loud)::double / 3, 6) as score, rude, phone, loud from f"""
)
def completeness(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.col("text").alias("document"))
    return evaluate.completeness(chunks, {"rude": "idiot", "phone": "[0-9]{3}-[0-9]{4}", "loud": "!!"}).withColumn("score", F.round("score", 6))


@query("select count(*) as n, round(avg(quality - toxic), 6) as mean, round(avg(quality - toxic) / (stddev_samp(quality - toxic) / sqrt(count(*))), 5) as t from labels")
def paired_t(spark, sf_dir):
    return evaluate.paired_t(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))
