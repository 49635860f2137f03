"""Reference graphs: foreign keys as edges, and the modular graph with cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import graph, retrieval

from .registry import query, table
from .search import level_sql, modular_edges

FK = """f as (select 'o' || o_orderkey as src, 'c' || o_custkey as dst, 0 as pos from orders union all select 'c' || c_custkey, 'n' || c_nationkey, 0 from customer
  union all select 's' || s_suppkey, 'n' || s_nationkey, 0 from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey, 0 from nation)"""


def fk_edges(spark, sf_dir):
    pair = lambda t, a, x, b, y: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(0).alias("pos"))
    return pair("orders", "o", "o_orderkey", "c", "o_custkey").union(pair("customer", "c", "c_custkey", "n", "c_nationkey")).union(pair("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(pair("nation", "n", "n_nationkey", "r", "n_regionkey"))


def nodes(spark, sf_dir):
    one = lambda t, a, x: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x)).alias("id"))
    return one("customer", "c", "c_custkey").union(one("nation", "n", "n_nationkey")).union(one("region", "r", "r_regionkey"))


@query(f"with {FK} select src, dst, pos from f where dst in (select 'c' || c_custkey from customer union all select 'n' || n_nationkey from nation union all select 'r' || r_regionkey from region)")
def ref_edges(spark, sf_dir):
    return graph.existing(fk_edges(spark, sf_dir), nodes(spark, sf_dir))


@query("select 'l' || l_orderkey as src, 'p' || (l_partkey * 2) as dst, l_linenumber as pos from lineitem where l_partkey * 2 not in (select p_partkey from part)")
def dangling_refs(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey") * 2).alias("dst"), F.col("l_linenumber").alias("pos"))
    return graph.dangling(edges, table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id")))


@query(f"with {FK} select dst as id, list_sort(list(distinct src)) as referenced_by from f group by dst")
def ref_inverse(spark, sf_dir):
    return graph.inverse(fk_edges(spark, sf_dir))


@query(f"with recursive {FK}, c as (select src, dst from f union select c.src, f.dst from c join f on c.dst = f.src) select src, dst from c")
def ref_closure(spark, sf_dir):
    return graph.closure(fk_edges(spark, sf_dir))


@query(
    f"""with recursive {FK}, c as (select src, dst from f union select c.src, f.dst from c join f on c.dst = f.src)
    select f.src, f.dst, coalesce((select list_sort(list(c.dst)) from c where c.src = f.dst), []) as deps from f"""
)
def ref_dependencies(spark, sf_dir):
    return graph.dependencies(fk_edges(spark, sf_dir)).select("src", "dst", "deps")


SEEDS = "select vec_id as query, vec_id as node, 1 as ord from embeddings where vec_id % 50 = 0"


def _seeds(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return ids.select(F.col("vec_id").alias("query"), F.col("vec_id").alias("node"), F.lit(1).alias("ord"))


@query(f"with {level_sql(SEEDS)}, x as (select *, row_number() over (partition by query order by depth, ord) as place from v3 where depth > 0) select query, node, depth, place from x where place <= 15")
def bfs_expand(spark, sf_dir):
    out = graph.expand(modular_edges(spark, sf_dir), _seeds(spark, sf_dir), 3, 15)
    return out.select("query", "node", "depth", F.expr("row_number() over (partition by query order by depth, ord)").cast("long").alias("place"))


@query(f"with {level_sql(SEEDS)} select query, depth, count(*) as n from v3 group by all")
def bfs_depth_histogram(spark, sf_dir):
    found = graph.expand(modular_edges(spark, sf_dir), _seeds(spark, sf_dir), 3, None).select("query", "node", "depth")
    return graph.depth_histogram(found.union(_seeds(spark, sf_dir).select("query", "node", F.lit(0))))


@query(f"with {level_sql(SEEDS)}, t as (select query, count(*) as found from v3 group by query) select query, least(10, found) as total, found >= 10 as truncated from t")
def expand_truncated(spark, sf_dir):
    found = graph.expand(modular_edges(spark, sf_dir), _seeds(spark, sf_dir), 3, 9).groupBy("query").agg(F.count("*").alias("n"))
    return _seeds(spark, sf_dir).join(found, "query", "left").select("query", (F.coalesce("n", F.lit(0)) + 1).alias("total"), (F.coalesce("n", F.lit(0)) + 1 >= 10).alias("truncated"))


@query("""with s as (select *, sum(n_chars + 2) over (partition by source order by doc_id) as used from documents) select source, doc_id, used::bigint as used from s where used <= 20000""")
def token_budget_prefix(spark, sf_dir):
    """Documents of each source up to the first that overflows the budget."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return retrieval.budget_prefix(rows, ["source"], ["doc_id"], F.col("n_chars") + 2, 20000).select("source", "doc_id", "used")
