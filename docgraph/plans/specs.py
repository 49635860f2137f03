"""One generated specification for every customer (orders as paths and schemas), of which five in eight are rejected.

Of a customer's orders each schema refers to the next, the last to the first; orders of status F have a failing response
that refers to a schema that is not there, those of status P a second verb. Two of three valid files are YAML.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import openapi

from .registry import query, table

# Kinds of files by customer: 0 no JSON, 1 old version, 2 no version, 3 no title, 4 paths without a slash, 5 to 7 valid.
FILES = """k as (select c_custkey, c_name, c_mktsegment, c_custkey % 8 as kind, 'c/' || c_custkey || case c_custkey % 8 when 6 then '.yaml' when 7 then '.yml' else '.json' end as file from customer),
v as (select * from k where kind >= 5 or kind = 4 and not exists (select 1 from orders where o_custkey = c_custkey)),
o as (select v.*, o_orderkey, o_orderstatus, o_orderpriority, file || ':paths/orders/' || o_orderkey || '/get' as op, file || ':components/schemas/O' || o_orderkey as schema,
  coalesce(lead(o_orderkey) over w, first_value(o_orderkey) over w) as next_key from v join orders on o_custkey = c_custkey window w as (partition by c_custkey order by o_orderkey))"""
EDGES = """e as (select file, op as src, schema as dst, case when o_orderstatus = 'F' then 1 else 0 end as pos from o
  union all select file, schema, file || ':components/schemas/O' || next_key, 0 from o)"""


def specs(spark, sf_dir):
    each = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    mine = each.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))
    kind, key = F.col("c_custkey") % 8, lambda o: o["o_orderkey"].cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    slash = F.when(kind == 4, "").otherwise("/")
    fails = lambda o: F.when(o["o_orderstatus"] == "F", ',"404":{"$ref":"#/components/schemas/Gone"}').otherwise("")
    drops = lambda o: F.when(o["o_orderstatus"] == "P", text(',"delete":{"operationId":"drop_', key(o), '","responses":{"204":{"description":"gone"}}}')).otherwise("")
    path = lambda o: text('"', slash, "orders/", key(o), '":{"get":{"operationId":"get_', key(o), '","tags":["', o["o_orderpriority"], '"],"responses":{"200":{"$ref":"#/components/schemas/O', key(o), '"}', fails(o), "}}", drops(o), "}")
    following = lambda i: F.get("orders", F.pmod(i + 1, F.size("orders")))
    schema = lambda o, i: text('"O', key(o), '":{"type":"object","properties":{"next":{"$ref":"#/components/schemas/O', key(following(i)), '"}}}')
    version = F.when(kind == 1, '"openapi":"2.0.0",').when(kind == 2, "").otherwise('"openapi":"3.0.1",')
    title = F.when(kind == 3, "").otherwise(text('"title":"', F.col("c_name"), '",'))
    tags = F.when(F.col("c_mktsegment") == "BUILDING", '"tags":[{"name":"BUILDING"}],').otherwise("")
    orders = F.coalesce("orders", F.array().cast("array<struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>>"))
    found = table(spark, sf_dir, "customer").join(mine, "c_custkey", "left").withColumn("orders", orders)
    whole = text("{", version, '"info":{', title, '"version":"1.0"},', tags, '"paths":{', F.array_join(F.transform("orders", path), ","), '},"components":{"schemas":{', F.array_join(F.transform("orders", schema), ","), "}}}")
    ending = F.when(kind == 6, ".yaml").when(kind == 7, ".yml").otherwise(".json")
    return found.select(text("c/", F.col("c_custkey").cast("string"), ending).alias("file"), F.encode(F.when(kind == 0, "{").otherwise(whole), "UTF-8").alias("content"))


def parsed(spark, sf_dir):
    return openapi.graph.cut(openapi.parse_elements(specs(spark, sf_dir), columns=["file", "id", "refs", "parent"]))


@query(
    f"""with {FILES} select file, case kind when 0 then ['invalid JSON: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)']
      when 1 then ['OpenAPI version 2.0.0 is below minimum required version 3.0.0'] when 2 then ['Missing required ''openapi'' field']
      when 3 then ['Info section missing required ''title'' field']
      else (select list('Path ''orders/' || o_orderkey || ''' must start with ''/''' order by o_orderkey) from orders where o_custkey = c_custkey) end as errors
    from k where kind < 4 or kind = 4 and exists (select 1 from orders where o_custkey = c_custkey)"""
)
def spec_errors_many(spark, sf_dir):
    return openapi.rejected(openapi.parse_elements(specs(spark, sf_dir), columns=["file", "success", "errors"]))


@query(
    f"""with {FILES} select file || ':info' as id, 'info' as type, null as chunk_type, 'info' as natural_name, null as path, null as method, null as operation_id, null as tags, null as component_type, null as component_name, null as child, null as parent from v
    union all select file || ':tags', 'tags', null, 'tags', null, null, null, null, null, null, null, null from v where c_mktsegment = 'BUILDING'
    union all select op, 'operation', 'operation', '/orders/' || o_orderkey || '/get', '/orders/' || o_orderkey, 'get', 'get_' || o_orderkey, [o_orderpriority], null, null, case when o_orderstatus = 'F' then op || ':errors' end, null from o
    union all select op || ':errors', 'operation', 'error_responses', '/orders/' || o_orderkey || '/get', '/orders/' || o_orderkey, 'get', 'get_' || o_orderkey, [o_orderpriority], null, null, null, op from o where o_orderstatus = 'F'
    union all select file || ':paths/orders/' || o_orderkey || '/delete', 'operation', 'operation', '/orders/' || o_orderkey || '/delete', '/orders/' || o_orderkey, 'delete', 'drop_' || o_orderkey, [], null, null, null, null from o where o_orderstatus = 'P'
    union all select schema, 'component', null, 'O' || o_orderkey, null, null, null, null, 'schemas', 'O' || o_orderkey, null, null from o"""
)
def spec_elements_many(spark, sf_dir):
    """Info, tags, operations (split from their failing responses) and components of the valid files, JSON and YAML."""
    names = ["id", "type", "chunk_type", "natural_name", "path", "method", "operation_id", "tags", "component_type", "component_name", "child", "parent"]
    return openapi.parse_elements(specs(spark, sf_dir), columns=names).where("id is not null")


LINE = "|| chr(10) ||"


@query(
    f"""with {FILES}, d as (select file || ':info' as id, 'title: ' || c_name {LINE} 'version: ''1.0''' as document from v
    union all select file || ':tags', '- name: BUILDING' from v where c_mktsegment = 'BUILDING'
    union all select op, 'get:' {LINE} '  operationId: get_' || o_orderkey {LINE} '  tags:' {LINE} '  - ' || o_orderpriority {LINE} '  responses:' {LINE} '    ''200'':' {LINE} '      $ref: ''#/components/schemas/O' || o_orderkey || '''' from o
    union all select op || ':errors', 'get_error_responses:' {LINE} '  ''404'':' {LINE} '    $ref: ''#/components/schemas/Gone''' from o where o_orderstatus = 'F'
    union all select file || ':paths/orders/' || o_orderkey || '/delete', 'delete:' {LINE} '  operationId: drop_' || o_orderkey {LINE} '  responses:' {LINE} '    ''204'':' {LINE} '      description: gone' from o where o_orderstatus = 'P'
    union all select schema, 'O' || o_orderkey || ':' {LINE} '  type: object' {LINE} '  properties:' {LINE} '    next:' {LINE} '      $ref: ''#/components/schemas/O' || next_key || '''' from o)
    select id, document, substr(sha256(document), 1, 16) as content_hash from d"""
)
def spec_documents(spark, sf_dir):
    return openapi.parse_elements(specs(spark, sf_dir), columns=["id", "document", "content_hash"]).where("id is not null")


@query(f"with {FILES}, {EDGES} select file, src, dst, pos from e")
def spec_references(spark, sf_dir):
    return openapi.reference_edges(parsed(spark, sf_dir))


@query(
    f"""with {FILES}, {EDGES}, l as (select src, dst, pos, case when src like '%/get' then 0 else 1 end as place from e
      union all select op, op || ':errors', 1000, 0 from o where o_orderstatus = 'F' union all select op || ':errors', op, 0, 0 from o where o_orderstatus = 'F'),
    i as (select file, file || ':info' as id from v union all select file, file || ':tags' from v where c_mktsegment = 'BUILDING' union all select file, op from o union all select file, op || ':errors' from o where o_orderstatus = 'F'
      union all select file, file || ':paths/orders/' || o_orderkey || '/delete' from o where o_orderstatus = 'P' union all select file, schema from o),
    f as (select src, list(dst order by pos) as ref_order from l group by 1), b as (select dst, list(src order by place, src) as referenced_by from l group by 1)
    select id, coalesce(ref_order, []) as ref_order, coalesce(referenced_by, []) as referenced_by, case when list_contains(ref_order, id || ':errors') then id || ':errors' end as error_responses,
      case when id like '%:errors' then replace(id, '/get:errors', '/get') end as parent_operation, file || ':info' as api_info_ref
    from i left join f on f.src = i.id left join b on b.dst = i.id"""
)
def spec_links(spark, sf_dir):
    """Each chunk's references in order and what refers to it, after operations are split."""
    return openapi.process(specs(spark, sf_dir), columns=["id", "ref_order", "referenced_by", "error_responses", "parent_operation", "api_info_ref"])


@query(
    f"""with {FILES}, {EDGES} select e.src as id, e.dst as target, coalesce((select list(s.schema order by s.schema) from o s where s.file = e.file and s.schema <> e.dst), []) as deps from e
    union all select op, op || ':errors', [] from o where o_orderstatus = 'F' union all select op || ':errors', op, [] from o where o_orderstatus = 'F'"""
)
def spec_reach(spark, sf_dir):
    """Each direct reference with all that it reaches (the schemas of one customer form a cycle)."""
    return openapi.process(specs(spark, sf_dir), columns=["id", "ref_ids"]).select("id", F.explode("ref_ids").alias("target", "deps"))
