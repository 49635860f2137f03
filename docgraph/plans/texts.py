"""Scalar text functions over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docgraph.functions import text as t
from docgraph.operators import keyword
from docgraph.operators.embedding import EmbeddingCache
from docgraph.runtime import checkpoint_folder

from .registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("select doc_id, substr(sha256(text), 1, 16) as content_hash from documents")
def chunk_hash16(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.hash16(F.col("text")).alias("content_hash"))


@query("select doc_id, sha256('hashing:' || substr(sha256(text), 1, 16)) as cache_key from documents")
def cache_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.cache_key("hashing", t.hash16(F.col("text"))).alias("cache_key"))


@query("select doc_id, (length(text) // 4)::int as tokens from documents")
def token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.n_tokens(F.col("text")).alias("tokens"))


@query("select doc_id, case when length(text) > 400 then substr(text, 1, 397) || '...' else text end as trimmed from documents")
def token_trim(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.trim_tokens(F.col("text"), 100).alias("trimmed"))


STRIPS = ((r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"\[([^\]]*)\]\([^)]+\)", r"\1"), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"(?m)^#+\s*", ""), (r"[*_]{1,2}([^*_]+)[*_]{1,2}", r"\1"))


def words_sql(column: str) -> str:
    for pattern, by in STRIPS:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return rf"len(list_filter(regexp_split_to_array({column}, '[\s\p{{Z}}]+'), lambda w: w <> ''))::int"


@query(f"select doc_id, {words_sql('text')} as words from documents")
def word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.count_words(F.col("text")).alias("words"))


def slug_sql(column: str, drop: str, dash: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({column}), '{drop}', '', 'g'), '{dash}', '-', 'g'), '-+', '-', 'g'), '-')"


HEADER = slug_sql("text", r"[^\p{L}\p{N}_\s.-]", r"[.\s]+")
SPLIT = slug_sql("text", r"[^\p{L}\p{N}_\s-]", r"[-\s]+")
ANCHOR = slug_sql("text", r"[^\p{L}\p{N}_\s-]", r"[-\s_]+")


@query(f"select doc_id, {HEADER} as by_header, {SPLIT} as by_split, {ANCHOR} as by_anchor from documents")
def slugs(spark, sf_dir):
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", t.slug_header(c).alias("by_header"), t.slug_split(c).alias("by_split"), t.slug_anchor(c).alias("by_anchor"))


@query(
    r"""select page_id, regexp_matches(html, '```[\s\S]*?```') or regexp_matches(html, '`[^`]+`') or regexp_matches(html, '(?m)^    .*\S') as has_code,
      regexp_matches(html, '\|\s*:?-+:?\s*\|') as has_table from pages
    union all select -doc_id - 1, regexp_matches(text, '```[\s\S]*?```') or regexp_matches(text, '`[^`]+`') or regexp_matches(text, '(?m)^    .*\S'),
      regexp_matches(text, '\|\s*:?-+:?\s*\|') from documents"""
)
def content_flags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("x"))
    every = pages.union(docs(spark, sf_dir).select(-F.col("doc_id") - 1, "text"))
    return every.select("page_id", t.has_code(F.col("x")).alias("has_code"), t.has_table(F.col("x")).alias("has_table"))


@query("select page_id, coalesce(list_extract(string_split(url, '/'), -2), '') as category from pages")
def category_from_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.parent_dir(F.col("url")).alias("category"))


@query("select substr(sha256(text), 1, 16) as id, count(*) as n from documents group by 1 having count(*) > 1")
def dup_ids(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(t.hash16(F.col("text")).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


SEEN = "select distinct sha256(text) as k from documents where lang = 'en'"


def _cache(spark, sf_dir):
    """A cache of the English documents' embeddings, of which some are put again; keyed documents."""
    keyed = docs(spark, sf_dir).withColumn("cache_key", F.sha2("text", 256))
    cache = EmbeddingCache(spark, f"{checkpoint_folder(spark)}/cache-{uuid.uuid4().hex}")
    english = keyed.where("lang = 'en'")
    cache.put(english.select("cache_key", F.array(F.lit(0.0).cast("float")).alias("embedding")))
    cache.put(english.where("doc_id % 2 = 0").select("cache_key", F.array(F.lit(1.0).cast("float")).alias("embedding")))
    return cache, keyed


@query(f"with c as ({SEEN}), e as (select distinct sha256(text) as k from documents where lang = 'en' and doc_id % 2 = 0) select doc_id, c.k is not null as cached, case when c.k is not null then (e.k is not null)::int end as value from documents left join c on sha256(text) = c.k left join e on sha256(text) = e.k")
def cache_hits(spark, sf_dir):
    """Documents with what the cache has for them: the embedding put last."""
    cache, keyed = _cache(spark, sf_dir)
    return cache.lookup(keyed).select("doc_id", F.col("embedding").isNotNull().alias("cached"), F.get("embedding", F.lit(0)).cast("int").alias("value"))


@query(f"select distinct sha256(text) as cache_key from documents where sha256(text) not in ({SEEN})")
def cache_misses(spark, sf_dir):
    cache, keyed = _cache(spark, sf_dir)
    return cache.misses(keyed).select("cache_key").distinct()


# ---- links: the pages' anchors written as Markdown

AS_MARKDOWN = r"""regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1) <http://x.org/\2>', 'g')"""
LINES = f"m as (select page_id, unnest(string_split({AS_MARKDOWN}, chr(10))) as line, generate_subscripts(string_split({AS_MARKDOWN}, chr(10)), 1) as no from pages)"
KIND = r"""case when trim(url) like '#%' then 'internal' when regexp_matches(trim(url), '(?i)^https?:') then 'external'
  when trim(url) like '%.md' or trim(url) like '%.markdown' or contains(trim(url), '.md#') or contains(trim(url), '.markdown#') then 'cross_doc'
  when not regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:') and (contains(trim(url), '/') or trim(url) like '%.html') then 'cross_doc' else 'external' end"""
FOUND = rf"""{LINES},
u as (select page_id, no, 0 as sort, unnest(regexp_extract_all(line, '\[([^\]]*)\]\(([^)]+)\)', 2)) as url, generate_subscripts(regexp_extract_all(line, '\[([^\]]*)\]\(([^)]+)\)', 2), 1) as i from m
  union all select page_id, no, 1, unnest(regexp_extract_all(line, '<(https?://[^>]+)>', 1)), generate_subscripts(regexp_extract_all(line, '<(https?://[^>]+)>', 1), 1) from m),
k as (select page_id, url, case when sort = 1 then 'external' else {KIND} end as kind, row_number() over (partition by page_id order by no, sort, i) as place from u),
f as (select page_id, url, kind, min(place) as place from k group by all)"""


def _found(spark, sf_dir):
    text = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1) <http://x.org/$2>")
    return table(spark, sf_dir, "pages").select("page_id", t.links(text).alias("found"))


@query(f"with {FOUND} select page_id, url, kind, place from k")
def link_extract(spark, sf_dir):
    each = _found(spark, sf_dir).select("page_id", F.posexplode("found").alias("i", "l"))
    return each.select("page_id", "l.url", F.col("l.type").alias("kind"), (F.col("i") + 1).cast("long").alias("place"))


def _list(kind: str) -> str:
    return f"coalesce(string_agg(f.url, ' ' order by place) filter (kind = '{kind}'), '')"


@query(f"with {FOUND} select p.page_id, {_list('internal')} as internal, {_list('cross_doc')} as cross_doc, {_list('external')} as external from pages p left join f using (page_id) group by p.page_id")
def links_by_type(spark, sf_dir):
    return _found(spark, sf_dir).select("page_id", *[F.array_join(t.links_of(F.col("found"), k), " ").alias(k) for k in ("internal", "cross_doc", "external")])


@query(r"""with x as (select page_id, list_distinct(regexp_extract_all(regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '![\2](\1)', 'g'), '!\[([^\]]*)\]\(([^)]+)\)', 2)) as l from pages)
select page_id, array_to_string(list_sort(l), ' ') as images from x""")
def image_refs(spark, sf_dir):
    text = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "![$2]($1)")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(t.images(text)), " ").alias("images"))


@query(
    """with u as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]*)"', 1))) as ref from pages)
    select page_id, ref || '/index.md#Top Part' as url, 'docs/fr' || case when ref like '/%' then ref else '/' || ref end || '/index.md:top-part' as target
    from u where not contains(ref, '.') and not contains(ref, '//') and ref <> ''"""
)
def link_targets(spark, sf_dir):
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]*)"'), F.lit(1)))
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(refs).alias("ref")).where("not contains(ref, '.') and not contains(ref, '//') and ref <> ''")
    url = F.concat("ref", F.lit("/index.md#Top Part"))
    return each.select("page_id", url.alias("url"), t.link_target(F.concat(F.lit("../fr"), url), F.lit("docs/de/a.md")).alias("target")).withColumn("target", F.regexp_replace("target", "^docs/fr/?", "docs/fr/"))


@query("select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') as parts from documents")
def csv_lists(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.csv_list(F.col("text")).alias("parts"))


@query("select event_id, (event_id % 5)::varchar || '.' || (event_id % 3)::varchar as version, (event_id % 5, event_id % 3) >= (3, 1) as supported from events")
def version_compare(spark, sf_dir):
    v = F.concat_ws(".", (F.col("event_id") % 5).cast("string"), (F.col("event_id") % 3).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("version"), t.version_at_least(v, "3.1.0").alias("supported"))


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as tidy from documents")
def tidy_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.tidy(F.col("text")).alias("tidy"))


@query("select doc_id, source, text || chr(10) || 'quality: ' || coalesce(quality::varchar, '') as document from documents join labels using (doc_id) union all select doc_id, source, text from documents where doc_id not in (select doc_id from labels)")
def enriched_documents(spark, sf_dir):
    extra = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return keyword.enriched(docs(spark, sf_dir), extra, "doc_id", "text").select("doc_id", "source", F.col("text").alias("document"))
