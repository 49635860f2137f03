"""One generated Markdown file for every customer: with front matter, without, with broken front matter, without headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import markdown
from docgraph.sources import files

from .registry import query, table

# Kinds of files by customer: 0 title, tags and category, 1 neither front matter nor headers, 2 broken front matter, 3 one tag and an author.
FILES = """k as (select c_custkey % 4 as kind, c_name as name, c_mktsegment as segment, 'n' || c_nationkey as folder, 'n' || c_nationkey || '/' || c_custkey || '.md' as file from customer),
b as (select *, '# ' || name || chr(10) || chr(10) || 'see [other](../x.md#Part)' || chr(10) || chr(10) || '# Account' || chr(10) || chr(10) || segment || ' words here' as body from k)"""


def notes(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    kind, name, segment = F.col("c_custkey") % 4, F.col("c_name"), F.col("c_mktsegment")
    body = F.format_string("# %s\n\nsee [other](../x.md#Part)\n\n# Account\n\n%s words here\n", name, segment)
    text = (
        F.when(kind == 0, F.concat(F.format_string("---\ntitle: %s\ntags: [a, %s]\ncategory: %s\n---\n", name, segment, segment), body))
        .when(kind == 1, F.format_string("plain %s\n", name))
        .when(kind == 2, F.lit("---\ntitle: [\n---\n# x\n"))
        .otherwise(F.concat(F.format_string("---\ntags: solo\nauthor: %s\n---\n", name), body))
    )
    file = F.format_string("n%s/%s.md", F.col("c_nationkey"), F.col("c_custkey"))
    return customer.select(file.alias("file"), F.encode(text, "UTF-8").alias("content"))


@query(
    f"""with {FILES} select file, kind <> 2 as success, case when kind = 2 then 'invalid front matter' end as error,
      case kind when 1 then 'plain ' || name when 2 then null else body end as content, case when kind = 0 then name end as title, case when kind = 3 then name end as author,
      case when kind = 0 then segment end as category, case kind when 0 then ['a', segment] when 3 then ['solo'] else [] end as tags,
      case kind when 0 then '{{"title": "' || name || '", "tags": ["a", "' || segment || '"], "category": "' || segment || '"}}' when 3 then '{{"tags": "solo", "author": "' || name || '"}}' end as front,
      case kind when 0 then 'category: ' || segment || chr(10) || 'tags:' || chr(10) || '- a' || chr(10) || '- ' || segment || chr(10) || 'title: ' || name || chr(10)
        when 3 then 'author: ' || name || chr(10) || 'tags: solo' || chr(10) end as front_yaml
    from b"""
)
def md_front_matter(spark, sf_dir):
    """Bodies, fields and payloads of front matter; a file that cannot be parsed says so and leaves the others alone."""
    field = lambda n: F.col("fields")[n].alias(n)
    found = files.parse_markdown(notes(spark, sf_dir))
    return found.select("file", "success", F.split("error", ":")[0].alias("error"), "content", field("title"), field("author"), field("category"), "tags", "front", "front_yaml")


@query(f"with {FILES} select kind <> 2 as success, count(*) as count from b group by 1")
def md_failures(spark, sf_dir):
    return markdown.failures(files.parse_markdown(notes(spark, sf_dir)))


@query(
    f"""with {FILES}, c as (select *, 0 as chunk_index, file || ':frontmatter' as id, 'markdown_frontmatter' as type, 0 as section_level, case when kind = 0 then name else '' end as title, [] as refs, 3 as total from b where kind in (0, 3)
      union all select *, 1, file || ':' || lower(replace(name, '#', '')) || ':L1', 'markdown_section', 1, name, ['../x.md#Part'], 3 from b where kind in (0, 3)
      union all select *, 2, file || ':account:L5', 'markdown_section', 1, 'Account', [], 3 from b where kind in (0, 3)
      union all select *, 0, file || ':document', 'markdown_document', 0, '', [], 1 from b where kind = 1)
    select id, type, file as source_file, section_level, title, chunk_index, total as total_chunks, refs as cross_doc_refs, case when kind = 0 then name else '' end as document_title,
      case when kind = 3 then name else '' end as document_author, case when kind = 0 then segment else folder end as document_category,
      case kind when 0 then ['a', segment] when 3 then ['solo'] else [] end as document_tags,
      lag(id) over w as previous_chunk, lead(id) over w as next_chunk from c window w as (partition by file order by chunk_index)"""
)
def md_chunks(spark, sf_dir):
    """Chunks of all files with ids, kinds, neighbours and what the document gives them; failed files give none."""
    names = ["id", "type", "source_file", "section_level", "title", "chunk_index", "total_chunks", "cross_doc_refs", "document_title", "document_author", "document_category", "document_tags", "previous_chunk", "next_chunk"]
    return markdown.assemble(files.parse_markdown(notes(spark, sf_dir))).select(*names)


CHUNKS = """c as (select kind, file || ':frontmatter' as id from b where kind in (0, 3) union all select kind, file || ':' || lower(replace(name, '#', '')) || ':L1' from b where kind in (0, 3)
  union all select kind, file || ':account:L5' from b where kind in (0, 3) union all select kind, file || ':document' from b where kind = 1)"""


@query(f"with {FILES}, {CHUNKS} select id, 'Missing required field: title' as problem from c where kind = 3 union all select id, 'word_count must be an integer' from c")
def md_metadata_problems(spark, sf_dir):
    """Metadata with a wrong type everywhere, and a field taken out of the files that name an author."""
    chunks = markdown.assemble(files.parse_markdown(notes(spark, sf_dir)))
    spoilt = chunks.withColumns({"title": F.when(F.col("document_author") == "", F.col("title")), "word_count": F.col("word_count").cast("string")})
    return markdown.validate_metadata(spoilt)
