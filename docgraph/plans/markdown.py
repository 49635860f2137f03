"""Sections and navigation: conversations as files, turns as sections (a user's turn opens a level)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import markdown as md

from .registry import query, table
from .texts import slug_sql

ROWS = """h as (select conv_id as file, turn as pos, conv_id || ':' || turn as id, case role when 'system' then 1 when 'user' then 2 else 3 end as level, role || ' ' || turn as title from conversations),
p as (select a.*, (select max(b.pos) from h b where b.file = a.file and b.pos < a.pos and b.level < a.level) as parent,
  (select min(b.pos) from h b where b.file = a.file and b.pos > a.pos and b.level <= a.level) as stop from h a)"""


def rows(spark, sf_dir):
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), F.concat_ws(":", "conv_id", "turn").alias("id"), level.alias("level"), F.concat_ws(" ", "role", "turn").alias("title"))


@query(f"with {ROWS} select file, pos, level, parent, stop from p")
def header_hierarchy(spark, sf_dir):
    return md.hierarchy(rows(spark, sf_dir)).select("file", "pos", "level", "parent", F.col("end").alias("stop"))


@query(f"with {ROWS}, g as (select *, min(level) over (partition by file) as top from h) select file, pos, sum((level = top)::int) over (partition by file order by pos)::bigint as grp from g")
def top_level_groups(spark, sf_dir):
    return md.top_groups(rows(spark, sf_dir)).select("file", "pos", "grp")


@query(f"with {ROWS} select file, pos, lag(id) over w as previous_chunk, lead(id) over w as next_chunk from h window w as (partition by file order by pos)")
def nav_prev_next(spark, sf_dir):
    return md.navigation(rows(spark, sf_dir), order="pos").select("file", "pos", "previous_chunk", "next_chunk")


@query(f"with {ROWS} select a.file, a.pos, a.id, b.id as parent_section from p a left join p b on a.file = b.file and a.parent = b.pos")
def nav_parent(spark, sf_dir):
    return md.navigation(rows(spark, sf_dir), order="pos").select("file", "pos", "id", "parent_section")


@query(f"with {ROWS} select a.id, coalesce((select list(b.id order by b.pos) from p b where b.file = a.file and b.parent = a.pos), []) as child_sections from p a")
def nav_children(spark, sf_dir):
    return md.navigation(rows(spark, sf_dir), order="pos").select("id", "child_sections")


@query(f"with {ROWS} select a.id, coalesce((select list(b.id order by b.pos) from p b where b.file = a.file and b.level = a.level and b.parent is not distinct from a.parent and b.pos <> a.pos), []) as sibling_sections from p a")
def nav_siblings(spark, sf_dir):
    return md.navigation(rows(spark, sf_dir), order="pos").select("id", "sibling_sections")


ANCHOR = slug_sql("title", r"[^\p{L}\p{N}_\s-]", r"[-\s_]+")


@query(
    f"""with recursive {ROWS}, s as (select *, {ANCHOR} as slug from p),
    c as (select file, pos, parent, slug as section_path, title as hierarchical_context from s
      union all select c.file, c.pos, s.parent, s.slug || '/' || c.section_path, s.title || ' > ' || c.hierarchical_context from c join s on c.file = s.file and c.parent = s.pos)
    select file, pos, section_path, hierarchical_context from c where parent is null"""
)
def nav_section_path(spark, sf_dir):
    return md.navigation(rows(spark, sf_dir), order="pos").select("file", "pos", "section_path", "hierarchical_context")


@query(
    f"""with {ROWS}, k as (select a.file, a.pos, count(b.id) as children from p a left join p b on a.file = b.file and b.parent = a.pos group by all),
    s as (select a.file, a.pos, count(b.id) as siblings from p a left join p b on a.file = b.file and b.level = a.level and b.parent is not distinct from a.parent and b.pos <> a.pos group by all),
    n as (select file, pos, lag(id) over w as v, lead(id) over w as x from h window w as (partition by file order by pos))
    select count(*) as total_chunks, count(v) as with_previous_chunk, count(x) as with_next_chunk, count(parent) as with_parent_section, sum(children)::bigint as total_child_sections, sum(siblings)::bigint as total_sibling_sections
    from p join k using (file, pos) join s using (file, pos) join n using (file, pos)"""
)
def nav_summary(spark, sf_dir):
    return md.navigation_summary(md.navigation(rows(spark, sf_dir), order="pos"))


@query(f"with {ROWS}, n as (select id, pos, lag(id) over w as v from h window w as (partition by file order by pos)) select id, 'previous_chunk' as field, v as target from n where pos % 3 <> 1 and v in (select id from n where pos % 3 = 1)")
def nav_validate(spark, sf_dir):
    """Links that dangle once every third turn is taken out; only the links back are shown."""
    nav = md.navigation(rows(spark, sf_dir), order="pos").where("pos % 3 <> 1")
    return md.dangling_navigation(nav).where("field = 'previous_chunk'")


@query(
    f"""with {ROWS}, n as (select id, pos, lag(id) over w as v, lead(id) over w as x from h window w as (partition by file order by pos)),
    k as (select id, pos, 'previous_chunk' as field, v as target from n
      union all select id, pos, 'next_chunk', x from n
      union all select a.id, a.pos, 'parent_section', b.id from p a join p b on a.file = b.file and a.parent = b.pos
      union all select a.id, a.pos, 'child_sections', b.id from p a join p b on a.file = b.file and b.parent = a.pos
      union all select a.id, a.pos, 'sibling_sections', b.id from p a join p b on a.file = b.file and b.level = a.level and b.parent is not distinct from a.parent and b.pos <> a.pos)
    select id, field, target from k where pos % 3 <> 1 and target in (select id from n where pos % 3 = 1)"""
)
def nav_validate_fields(spark, sf_dir):
    """As ``nav_validate``, with the dangling links of all fields."""
    return md.dangling_navigation(md.navigation(rows(spark, sf_dir), order="pos").where("pos % 3 <> 1"))


# ---- conversations written as Markdown text

TEXT = """d as (select conv_id as file, string_agg(case role when 'system' then '# ' when 'user' then '## ' else '### ' end || role || ' ' || turn || chr(10) || text, chr(10) order by turn) as content from conversations group by conv_id),
n as (select file, content, string_split(content, chr(10)) as ls from d),
a as (select file, unnest(ls) as line, generate_subscripts(ls, 1) as no from n),
h as (select file, no, length(regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 1)) as level, trim(regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 2)) as title,
  coalesce((select sum(length(b.line) + 1) from a b where b.file = a.file and b.no < a.no), 0)::int as pos from a where regexp_matches(trim(line), '^(#{1,6})\\s+(.+)$')),
e as (select h.*, coalesce((select min(b.no) from h b where b.file = h.file and b.no > h.no and b.level <= h.level), (select len(ls) + 1 from n where n.file = h.file)) as stop from h),
t as (select e.*, (select string_agg(line, chr(10) order by a.no) from a where a.file = e.file and a.no >= e.no and a.no < e.stop) as content from e),
g as (select *, sum((level = top)::int) over (partition by file order by no) as grp, row_number() over (partition by file order by no) as k from (select *, min(level) over (partition by file) as top from t))"""


def files(spark, sf_dir):
    mark = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("### ")
    text = F.concat(mark, "role", F.lit(" "), "turn", F.lit("\n"), "text")
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file")).agg(F.sort_array(F.collect_list(F.struct("turn", text.alias("x")))).alias("l"))
    return turns.select("file", F.array_join(F.transform("l", lambda s: s["x"]), "\n").alias("content"))


@query(f"with {TEXT} select file, level::int as level, title as text, pos as position, no::int as line_number from h")
def headers(spark, sf_dir):
    return md.headers(files(spark, sf_dir))


@query(f"with {TEXT} select file, title, content, (stop - no)::int as n_lines from t")
def section_boundaries(spark, sf_dir):
    each = files(spark, sf_dir).select("file", F.explode(md.with_headers(F.col("content"), lambda lines, found: md.boundary_array(F.col("content"), lines, found))).alias("b"))
    return each.select("file", "b.title", "b.content", F.size(F.split("b.content", "\n")).alias("n_lines"))


MOST = 400


@query(
    f"""with {TEXT}, j as (select file, grp, string_agg(content, chr(10) || chr(10) order by k) as joined, count(*) as n, min(k) as first from g group by all),
    whole as (select j.file, j.grp, 1 as part, false as is_split, joined as content from j where length(joined) // 4 <= {MOST} or n = 1),
    m as (select g.*, joined, n, first from g join j using (file, grp) where length(joined) // 4 > {MOST} and n > 1),
    main as (select file, grp, content, title, level from m where k = first),
    below as (select main.file, main.grp, string_agg(line, chr(10) order by no) as own from main,
        (select m2.file as f2, m2.grp as g2, unnest(string_split(m2.content, chr(10))[2:]) as line, generate_subscripts(string_split(m2.content, chr(10))[2:], 1) as no from main m2) x
      where x.f2 = main.file and x.g2 = main.grp and trim(line) <> ''
        and no < coalesce((select min(i) from (select unnest(string_split(main.content, chr(10))[2:]) as y, generate_subscripts(string_split(main.content, chr(10))[2:], 1) as i) where ltrim(y) like '#%'), 1000000) group by all),
    ctx as (select main.*, repeat('#', main.level::int) || ' ' || title || coalesce(chr(10) || chr(10) || own, '') as context from main left join below using (file, grp)),
    parts as (select m.file, m.grp, m.k - m.first as part, true as is_split,
      case when m.k - m.first = 1 then ctx.content || case when ctx.content like '%' || chr(10) || chr(10) then '' else chr(10) || chr(10) end || m.content
        else ctx.context || ' > ' || m.title || chr(10) || chr(10) || m.content end as content
      from m join ctx on ctx.file = m.file and ctx.grp = m.grp where m.k > m.first),
    every as (select * from whole union all select * from parts)
    select file, (row_number() over (partition by file order by grp, part) - 1)::int as idx, is_split, sha256(content) as content_sha, (length(content) // 4)::int as tokens from every"""
)
def merge_or_split(spark, sf_dir):
    return md.sections(files(spark, sf_dir), MOST).select("file", "idx", "is_split", F.sha2("content", 256).alias("content_sha"), "tokens")
