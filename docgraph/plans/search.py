"""Vector search, its filters, and contexts built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.vectors import clamp, distance
from docgraph.operators import embedding, evaluate, graph, keyword, retrieval, store

from .registry import query, table

K = 10
DIST = "1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
HITS = f"select e.vec_id, e.label, {DIST} as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q"


def _chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _query(chunks: DataFrame) -> list[float]:
    return chunks.where("id = 0").select("embedding").head()[0]


def _top(spark, sf_dir, limit=K, filters=None) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return store.top_k(chunks, _query(chunks), limit, filters).withColumnRenamed("id", "vec_id")


def _out(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("distance", 6).alias("distance"), "rank")


def _ranked(hits: str, limit: int = K) -> str:
    return f"select vec_id, label, round(distance, 6) as distance, row_number() over (order by distance, vec_id)::int as rank from ({hits}) order by distance, vec_id limit {limit}"


@query(_ranked(HITS))
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_top(spark, sf_dir))


@query(_ranked(f"{HITS} where e.label = 3"))
def vec_topk_filter_eq(spark, sf_dir):
    return _out(_top(spark, sf_dir, filters={"label": 3}))


@query(_ranked(f"{HITS} where e.label in (1, 2) and e.vec_id >= 10 and (e.label <> 2 or e.vec_id < 400)"))
def vec_topk_filter_ops(spark, sf_dir):
    filters = {"label": {"$in": [1, 2]}, "id": {"$gte": 10}, "$or": [{"label": {"$ne": 2}}, {"id": {"$lt": 400}}]}
    return _out(_top(spark, sf_dir, filters=filters))


@query(f"select * from ({_ranked(HITS)}) where vec_id % 2 = 1")
def vec_topk_excluded(spark, sf_dir):
    """Exclusion after the ranking: ranks keep their gaps and nothing fills them."""
    return _out(_top(spark, sf_dir)).where("vec_id % 2 = 1")


BATCH = f"""select q.vec_id as query_id, e.vec_id as id, {DIST} as distance,
  row_number() over (partition by q.vec_id order by {DIST}, e.vec_id) as rank
  from embeddings e, (select * from embeddings where vec_id % 50 = 0) q"""


def _batch(spark, sf_dir, limit):
    chunks = _chunks(spark, sf_dir)
    asked = chunks.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return store.top_k_many(chunks, asked, limit)


@query(f"select query_id, id, round(distance, 6) + 0.0 as distance, rank::int as rank from ({BATCH}) where rank <= 5")
def vec_batch_topk(spark, sf_dir):
    return _batch(spark, sf_dir, 5).select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query("select count(embedding) as vectors, count(distinct len(embedding)) as dimensions, count(distinct len(embedding)) <= 1 as consistent from embeddings")
def vec_dim_check(spark, sf_dir):
    return embedding.dimensions(table(spark, sf_dir, "embeddings"))


@query(f"select vec_id, round(greatest(0, 1 - distance), 6) as relevance, round(least(1, greatest(0, 1 - distance)), 6) as clamped from ({HITS})")
def vec_relevance(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in _query(chunks)])
    out = retrieval.relevance(chunks.withColumn("distance", distance(F.col("embedding"), q)))
    return out.select(F.col("id").alias("vec_id"), F.round("relevance", 6).alias("relevance"), F.round(clamp(1 - F.col("distance")), 6).alias("clamped"))


def modular_edges(spark, sf_dir) -> DataFrame:
    """Two references from every vector to others, with cycles."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    n = ids.count()
    to = F.array(F.struct(F.lit(0).alias("pos"), ((F.col("vec_id") * 7 + 1) % n).alias("dst")), F.struct(F.lit(1).alias("pos"), ((F.col("vec_id") * 3 + 2) % n).alias("dst")))
    return ids.select(F.col("vec_id").alias("src"), F.explode(to).alias("e")).select("src", "e.dst", "e.pos")


def level_sql(seeds: str, levels: int = 3) -> str:
    """CTEs v0, v1, ...: everything seen up to a depth, in the order of a queue."""
    out = f"""e as (select vec_id as src, (vec_id * 7 + 1) % (select count(*) from embeddings) as dst, 0 as pos from embeddings
      union all select vec_id, (vec_id * 3 + 2) % (select count(*) from embeddings), 1 from embeddings),
    v0 as (select query, node, 0 as depth, ord from ({seeds}))"""
    for d in range(1, levels + 1):
        out += f""",
    s{d} as (select v.query, e.dst as node, min((v.ord, e.pos)) as spot from v{d - 1} v join e on e.src = v.node
             where v.depth = {d - 1} and not exists (select 1 from v{d - 1} w where w.query = v.query and w.node = e.dst) group by v.query, e.dst),
    v{d} as (select * from v{d - 1} union all select query, node, {d}, row_number() over (partition by query order by spot, node) from s{d})"""
    return out


def context_sql(limit: int, most: int, primary: str) -> str:
    seeds = f"select query_id as query, id as node, rank as ord from b where rank <= {limit}"
    return f"""with b as ({BATCH}), {level_sql(seeds)},
    x as (select *, row_number() over (partition by query order by depth, ord) as place from v3 where depth > 0),
    c as (select query, node, 'primary_result' as reason, ord, round(greatest(0, 1 - distance), 6) as relevance from v0 join b on query = query_id and node = id
      union all select query, node, 'referenced_dependency', place, 0.5 from x where place <= 15),
    r as (select *, count(*) over (partition by query) as n, count(*) filter (reason = 'primary_result') over (partition by query) as p,
      row_number() over (partition by query, reason order by case when reason = 'primary_result' then 0 else -relevance end, ord) as rn from c)
    select query, node, reason, relevance from r where n <= {most} or rn <= case when reason = 'primary_result' then least(p, {primary}) else {most} - least(p, {primary}) end"""


def _context(spark, sf_dir, limit, most, prioritize):
    hits = _batch(spark, sf_dir, limit)
    seeds = hits.select(F.col("query_id").alias("query"), F.col("id").alias("node"), F.col("rank").alias("ord"))
    found = graph.expand(modular_edges(spark, sf_dir), seeds, 3, 15)
    place = F.expr("row_number() over (partition by query order by depth, ord)")
    refs = found.select("query", "node", F.lit("referenced_dependency").alias("reason"), place.alias("ord"), F.lit(0.5).alias("relevance"))
    first = retrieval.relevance(hits).select(F.col("query_id").alias("query"), F.col("id").alias("node"), F.lit("primary_result").alias("reason"), F.col("rank").alias("ord"), F.round("relevance", 6).alias("relevance"))
    return retrieval.limit_context(first.unionByName(refs), most, prioritize).select("query", "node", "reason", "relevance")


@query(context_sql(5, 15, "9"))
def context_60_40(spark, sf_dir):
    """For every stated query vector: five nearest, what they refer to, and the size limit that prefers primaries."""
    return _context(spark, sf_dir, 5, 15, True)


@query(context_sql(8, 10, "5"))
def context_even_split(spark, sf_dir):
    return _context(spark, sf_dir, 8, 10, False)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_60_40(spark, sf_dir)


# ---- keyword and hybrid ranking over documents that have a vector

WORDS = "The thing and that with"


@query("select doc_id from documents where contains(text, 'the') or contains(text, 'thing') or contains(text, 'and') or contains(text, 'that') or contains(text, 'with')")
def keyword_or(spark, sf_dir):
    return keyword.contains_any(table(spark, sf_dir, "documents"), WORDS, "text").select("doc_id")


@query(
    """with c as (select doc_id as id, lower(text) as document, lower('op' || case when doc_id % 3 = 0 then 'Thing' else source end) as operation_id,
        lower('operationId: op' || case when doc_id % 3 = 0 then 'Thing' else source end || ' lang: ' || lang || ' source: ' || source) as metadata,
        case when lang = 'en' then 'endpoint' else 'schema' end as type from documents),
      w as (select unnest(['get', 'thing', 'was', 'field', 'src1', 'es', 'retrieve', 'fetch', 'show', 'property', 'attribute', 'parameter']) as word),
      p as (select id, any_value(type) as type, sum(case when contains(operation_id, word) then 3 when contains(document, word) then 2 when contains(metadata, word) then 1 else 0 end) as points from c, w group by id)
    select id, (points + (type = 'endpoint')::int)::int as score from p where points + (type = 'endpoint')::int > 0 order by score desc, id limit 20"""
)
def keyword_weighted(spark, sf_dir):
    """A term counts where it stands first: operation id, document, metadata; chunks of the type asked for get a point."""
    name = F.concat(F.lit("op"), F.when(F.col("doc_id") % 3 == 0, "Thing").otherwise(F.col("source")))
    kind = F.when(F.col("lang") == "en", "endpoint").otherwise("schema")
    metadata = F.concat(F.lit("operationId: "), name, F.lit(" lang: "), "lang", F.lit(" source: "), "source")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), name.alias("operation_id"), metadata.alias("metadata"), kind.alias("type"))
    terms, asked = keyword.weighted_terms("Get thing was FIELD src1 es")
    return keyword.weighted(docs, terms, 20, asked).select("id", "score")


@query(
    f"""with h as ({HITS}), s as (select vec_id as id, distance from h order by distance, vec_id limit 30),
    k as (select vec_id as id, distance from h join documents on doc_id = vec_id where contains(text, 'thing') or contains(text, 'with') order by distance, vec_id limit 30)
    select id, round(case when s.distance is not null and k.distance is not null then s.distance * 0.7 * 0.5 + k.distance * 0.3
      when s.distance is not null then s.distance * 0.7 else k.distance * 0.5 end, 6) + 0.0 as score
    from s full join k using (id) order by case when s.distance is not null and k.distance is not null then s.distance * 0.7 * 0.5 + k.distance * 0.3
      when s.distance is not null then s.distance * 0.7 else k.distance * 0.5 end, id limit 20"""
)
def hybrid_fusion(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    q = _query(chunks)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    near = store.top_k(chunks, q, 30)
    words = store.top_k(keyword.contains_any(chunks.join(docs, "id"), "thing with", "text"), q, 30)
    return keyword.hybrid(near, words, 20).select("id", (F.round("score", 6) + 0.0).alias("score"))


@query(
    f"""with b as (select * from ({BATCH}) where rank <= 5), e as (select vec_id as src, (vec_id * 7 + 1) % (select count(*) from embeddings) as dst, 0 as pos from embeddings
      union all select vec_id, (vec_id * 3 + 2) % (select count(*) from embeddings), 1 from embeddings)
    select distinct dst as id, 0.5::double as score from b join e on src = id where query_id = 0 and dst not in (select id from b where query_id = 0)"""
)
def one_hop(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    hits = store.top_k(chunks, _query(chunks), 5)
    return keyword.one_hop(hits, modular_edges(spark, sf_dir), chunks).select("id", "score")


# ---- retrieval quality: a result is relevant if it has the query's label

JUDGED = f"""with b as (select * from ({BATCH}) where rank <= 10),
r as (select q.vec_id as query, e.vec_id as id from embeddings q join embeddings e on q.label = e.label where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id),
n as (select query, count(distinct id) as expected from r group by query),
j as (select b.query_id as query, b.id, b.rank, (r.id is not null)::int as hit, coalesce(n.expected, 0) as expected
  from b left join r on r.query = b.query_id and r.id = b.id left join n on n.query = b.query_id)"""


def metrics_sql(k: int) -> str:
    return f"""{JUDGED},
    t as (select *, sum(hit) over (partition by query order by rank) as sofar from j where rank <= {k}),
    g as (select query, expected, sum(hit) as hits, max(case when hit = 1 then 1.0::double / rank end) as rr, sum(hit * sofar::double / rank) as ap, sum(hit / log2(rank + 1.0::double)) as dcg from t group by query, expected)
    select query, round(hits::double / {k}, 6) as precision, round(case when expected > 0 then hits::double / expected else 0 end, 6) as recall,
      round(case when expected > 0 then hits::double / least(expected, {k}) else 0 end, 6) as relevance, round(coalesce(rr, 0), 6) as reciprocal_rank,
      round(case when expected > 0 then ap / least(expected, {k}) else 0 end, 6) as average_precision,
      round(case when expected > 0 then dcg / list_sum(list_transform(range(1, greatest(1, least(expected, {k})) + 1), lambda i: 1 / log2(i + 1.0::double))) else 0 end, 6) as ndcg
    from g"""


def _metrics(spark, sf_dir, k):
    chunks = _chunks(spark, sf_dir)
    asked = chunks.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("label").alias("l"))
    relevant = asked.join(chunks, asked.l == chunks.label).where("query <> id").select("query", "id")
    results = _batch(spark, sf_dir, 10).withColumnRenamed("query_id", "query")
    out = evaluate.at_k(evaluate.judged(results, relevant), k)
    return out.select("query", *[F.round(c, 6).alias(c) for c in out.columns if c != "query"])


@query(metrics_sql(3))
def metrics_at_3(spark, sf_dir):
    return _metrics(spark, sf_dir, 3)


@query(metrics_sql(10))
def metrics_at_10(spark, sf_dir):
    return _metrics(spark, sf_dir, 10)


@query(
    f"""with a as (select query_id, list(id) as x from ({BATCH}) where rank <= 5 group by query_id),
    b as (select query_id, list(id) as y from ({BATCH}) where rank <= 10 and id % 2 = 0 group by query_id)
    select a.query_id, round(len(list_intersect(x, coalesce(y, [])))::double / len(list_distinct(list_concat(x, coalesce(y, [])))), 6) as overlap from a left join b using (query_id)"""
)
def jaccard_overlap(spark, sf_dir):
    from docgraph.functions.text import jaccard

    hits = _batch(spark, sf_dir, 10)
    sets = hits.groupBy("query_id").agg(F.collect_set(F.when(F.col("rank") <= 5, F.col("id"))).alias("x"), F.collect_set(F.when(F.col("id") % 2 == 0, F.col("id"))).alias("y"))
    return sets.select("query_id", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("overlap"))
