"""Markdown as chunks: headers, sections, adaptive splitting, navigation, content analysis. All in column functions.

Text work on one file stays in its row (arrays and higher-order functions, no shuffle); navigation over many sections
uses windows partitioned by file, with one running value for each of the six header levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docgraph.functions import text as t

LEVELS = range(1, 7)
STRIP = r"(?U)^\s+|\s+$"


def clamp_config(max_tokens: int = 1000, min_tokens: int = 100, overlap: int = 50) -> tuple[int, int, int]:
    most = min(8000, max(100, max_tokens))
    return most, min(max(10, min_tokens), most // 2), min(max(0, overlap), most // 4)


# ---- headers


def header_array(lines: Column) -> Column:
    """Headers among the lines of a text, in order: line (from 0), level, text, position in characters. Lines in code
    fences count."""

    def header(line, i):
        own = F.regexp_replace(line, STRIP, "")
        marks = F.regexp_extract(own, r"^(#{1,6})(?U)\s+(.+)$", 1)
        said = F.regexp_replace(F.regexp_extract(own, r"^(#{1,6})(?U)\s+(.+)$", 2), STRIP, "")
        return F.struct(i.alias("line"), F.length(marks).alias("level"), said.alias("text"))

    found = F.filter(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.ltrim(s["x"]).rlike(r"^(?U)\s*#")), lambda s: header(s["x"], s["i"])), lambda h: h["level"] > 0)
    start = lambda h: F.when(h["line"] == 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice(lines, F.lit(1), F.greatest(h["line"], F.lit(1))), "\n")) + 1)
    return F.transform(found, lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["text"].alias("text"), start(h).alias("pos")))


def with_headers(content: Column, body) -> Column:
    """``body(lines, headers)`` with both evaluated once."""
    return t.let(F.split(content, "\n"), lambda lines: t.let(header_array(lines), lambda found: body(lines, found)))


def headers(files: DataFrame) -> DataFrame:
    """(file, level, text, position, line_number)."""
    each = files.select("file", F.explode(with_headers(F.col("content"), lambda _, found: found)).alias("h"))
    return each.select("file", "h.level", "h.text", F.col("h.pos").alias("position"), (F.col("h.line") + 1).alias("line_number"))


def hierarchy(rows: DataFrame, order: str = "pos", level: str = "level", file: str = "file") -> DataFrame:
    """``rows`` with ``parent`` (place of the nearest earlier one of lesser level) and ``end`` (place of the next one of no
    greater level; null at the file's end): as-of joins by one running value a level, in one sort of each file."""
    before = W.Window.partitionBy(file).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    after = W.Window.partitionBy(file).orderBy(order).rowsBetween(1, W.Window.unboundedFollowing)
    last = {n: F.last(F.when(F.col(level) == n, F.col(order)), ignorenulls=True).over(before) for n in LEVELS}
    following = {n: F.first(F.when(F.col(level) == n, F.col(order)), ignorenulls=True).over(after) for n in LEVELS}
    out = rows.withColumns({f"__b{n}": c for n, c in last.items()} | {f"__a{n}": c for n, c in following.items()})
    parent = F.greatest(*[F.when(F.col(level) > n, F.col(f"__b{n}")) for n in LEVELS])
    end = F.least(*[F.when(F.col(level) >= n, F.col(f"__a{n}")) for n in LEVELS])
    return out.withColumn("parent", parent).withColumn("end", end).drop(*[f"__{s}{n}" for s in "ab" for n in LEVELS])


def paths(rows: DataFrame, title: str = "title", order: str = "pos", level: str = "level", file: str = "file") -> DataFrame:
    """``rows`` with ``section_path`` (slugs) and ``context`` (titles) from the top ancestor down.

    The last title of a level is an ancestor if it stands after the last ones of all lesser levels.
    """
    before = W.Window.partitionBy(file).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    out = rows.withColumns({f"__p{n}": F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(title).alias("title"))), ignorenulls=True).over(before) for n in LEVELS})

    def chain(make):
        parts = []
        for n in LEVELS:
            lesser = [F.coalesce(F.col(f"__p{m}")["at"].cast("long"), F.lit(-(2**62))) for m in range(1, n)]
            above = F.lit(True) if not lesser else F.col(f"__p{n}")["at"] > (F.greatest(*lesser) if len(lesser) > 1 else lesser[0])
            parts.append(F.when((F.col(level) > n) & above, make(F.col(f"__p{n}")["title"])))
        return [*parts, make(F.col(title))]

    out = out.withColumn("section_path", F.concat_ws("/", *chain(t.slug_anchor))).withColumn("context", F.concat_ws(" > ", *chain(lambda c: c)))
    return out.drop(*[f"__p{n}" for n in LEVELS])


def unique_ids(rows: DataFrame, slug: Column, order: str = "pos", file: str = "file") -> DataFrame:
    """``rows`` with ``identifier``: the slug, and -2, -3, ... where it repeats in a file."""
    n = F.row_number().over(W.Window.partitionBy(file, "__slug").orderBy(order))
    out = rows.withColumn("__slug", slug).withColumn("__n", n)
    return out.withColumn("identifier", F.when(F.col("__n") == 1, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", "__n"))).drop("__slug", "__n")


def top_groups(rows: DataFrame, order: str = "pos", level: str = "level", file: str = "file") -> DataFrame:
    """``rows`` with ``grp``: the number of headers of the file's top level up to there; 0 stands before the first."""
    top = F.min(level).over(W.Window.partitionBy(file))
    upto = W.Window.partitionBy(file).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumn("__top", top).withColumn("grp", F.sum((F.col(level) == F.col("__top")).cast("int")).over(upto)).drop("__top")


# ---- sections

SECTION = "struct<content:string,level:int,title:string,line:int,start:int,stop:int,kind:string,tokens:int,is_split:boolean,split_index:int,total_splits:int,split_parent:string,parent_context:string>"


def _section(**given) -> Column:
    kinds = dict(p.split(":") for p in SECTION[len("struct<") : -1].split(","))
    return F.struct(*[(given[n] if n in given else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def boundary_array(content: Column, lines: Column, found: Column) -> Column:
    """Sections before any merging: text before the first header unless blank, then each header with all below it."""
    text = lambda a, b: F.array_join(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), "\n")
    shape = lambda c, h, stop, kind: F.struct(c.alias("content"), h["level"].alias("level"), h["text"].alias("title"), h["line"].alias("line"), h["pos"].alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"))

    def section(h, i):
        below = F.filter(F.slice(found, i + 2, F.size(found)), lambda x: x["level"] <= h["level"])
        return t.let(F.get(below, F.lit(0)), lambda end: shape(text(h["line"], F.coalesce(end["line"], F.size(lines))), h, F.coalesce(end["pos"], F.length(content)), "section"))

    sections = F.transform(found, section)
    first = F.get(found, F.lit(0))
    head = text(F.lit(0), first["line"])
    blank = F.struct(F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("line"), F.lit(0).alias("pos"))
    lead = F.when((first["line"] > 0) & head.rlike(r"(?U)\S"), F.array(shape(head, blank, first["pos"], "document")))
    return F.concat(F.coalesce(lead, F.slice(sections, 1, 0)), sections)


def group_array(bounds: Column) -> Column:
    """Boundaries in groups: each top-level header opens one, what stands before the first is one."""
    mark = lambda i, top: F.size(F.filter(F.slice(bounds, F.lit(1), i + 1), lambda b: b["level"] == top))
    last = lambda tagged: F.coalesce(F.array_max(F.transform(tagged, lambda x: x["g"])), F.lit(0))
    group = lambda tagged, g: F.transform(F.filter(tagged, lambda x: x["g"] == g), lambda x: x["b"])
    level = t.let(F.array_min(F.transform(bounds, lambda b: b["level"])), lambda top: F.transform(bounds, lambda b, i: F.struct(mark(i, top).alias("g"), b.alias("b"))))
    groups = t.let(level, lambda tagged: F.transform(F.sequence(F.lit(0), last(tagged)), lambda g: group(tagged, g)))
    return F.filter(groups, lambda g: F.size(g) > 0)


def _split_context(main: Column) -> Column:
    """Title line of a group's main boundary and the text right below it, up to the next header line."""
    rest = F.slice(F.split(main["content"], "\n"), F.lit(2), F.size(F.split(main["content"], "\n")))
    stop = F.array_position(F.transform(rest, lambda x: F.ltrim(x).startswith("#")), F.lit(True)).cast("int")
    own = F.filter(F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(rest), lambda x: x.rlike(r"(?U)\S"))
    said = F.concat(F.repeat(F.lit("#"), main["level"]), F.lit(" "), main["title"])
    return F.when(main["level"].isNull(), F.lit("")).otherwise(F.when(F.size(own) > 0, F.concat(said, F.lit("\n\n"), F.array_join(own, "\n"))).otherwise(said))


def split_group(group: Column, most: int) -> Column:
    """Sections of one group: all of it if its tokens fit, a lone boundary as it is, else the main one with its first
    subsection and then each other subsection under the context of the main one."""
    joined = F.array_join(F.transform(group, lambda b: b["content"]), "\n\n")
    main, last = F.get(group, F.lit(0)), F.get(group, F.size(group) - 1)
    header = F.get(F.filter(group, lambda b: b["level"].isNotNull()), F.lit(0))

    def one(h, content):
        return F.array(_section(content=content, level=h["level"], title=h["title"], line=h["line"], start=main["start"], stop=last["stop"], kind=main["kind"], tokens=t.n_tokens(content), is_split=F.lit(False)))

    def several(context):
        sub = F.slice(group, F.lit(2), F.size(group))
        total = F.when(F.size(group) > 2, F.size(group)).otherwise(F.lit(1))
        parent = F.when(main["level"].isNotNull(), t.slug_split(main["title"]))

        def part(b, i):
            gap = F.when(main["content"].endswith("\n\n") | (b["content"] == ""), F.lit("")).otherwise(F.lit("\n\n"))
            opening = F.concat(main["content"], gap, b["content"])
            under = F.when(context == "", b["content"]).otherwise(F.concat(context, F.lit(" > "), b["title"], F.lit("\n\n"), b["content"]))
            pick = lambda n: F.when(i == 0, main[n]).otherwise(b[n])
            section = lambda text: _section(content=text, level=pick("level"), title=pick("title"), line=pick("line"), start=pick("start"), stop=b["stop"], kind=F.lit("section"), tokens=t.n_tokens(text), is_split=F.lit(True), split_index=i + 1, total_splits=total, split_parent=parent, parent_context=F.when(i > 0, context))
            return t.let(F.when(i == 0, opening).otherwise(under), section)

        return F.transform(sub, part)

    split = F.when(F.size(group) == 1, one(main, main["content"])).otherwise(t.let(_split_context(main), several))
    return t.let(joined, lambda text: F.when(t.n_tokens(text) <= most, one(header, text)).otherwise(split))


def sections(files: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """(file, idx, section fields): front matter first if there is any; a file without headers is one document."""
    most = clamp_config(max_tokens)[0]
    content = F.col("content")
    document = _section(content=content, start=F.lit(0), stop=F.length(content), kind=F.lit("document"), tokens=t.n_tokens(content), is_split=F.lit(False))
    grouped = lambda lines, found: t.let(boundary_array(content, lines, found), lambda bounds: F.flatten(F.transform(group_array(bounds), lambda g: split_group(g, most))))
    body = with_headers(content, lambda lines, found: F.when(F.size(found) == 0, F.array(document)).otherwise(grouped(lines, found)))
    if "front_yaml" in files.columns:
        text = F.concat(F.lit("---\n"), F.col("front_yaml"), F.lit("---"))
        front = _section(content=text, start=F.lit(0), stop=F.lit(0), kind=F.lit("frontmatter"), tokens=t.n_tokens(text), is_split=F.lit(False))
        body = F.when(F.col("front_yaml").isNotNull(), F.concat(F.array(front), body)).otherwise(body)
    return files.withColumn("__s", body).select(*files.columns, F.posexplode("__s").alias("idx", "s")).select(*[c for c in files.columns if c != "content"], "idx", "s.*")


# ---- navigation


def chunk_id() -> Column:
    """Id of a section row: by kind, else slug and line, with the split number above 1."""
    split = F.when(F.col("is_split") & (F.col("split_index") > 1), F.concat(F.lit("-"), F.col("split_index"))).otherwise(F.lit(""))
    by_header = F.concat("file", F.lit(":"), t.slug_anchor(F.col("title")), F.lit(":L"), F.col("line") + 1, split)
    return F.when(F.col("kind").isin("frontmatter", "document"), F.concat_ws(":", "file", "kind")).when(F.col("level").isNotNull(), by_header).otherwise(F.concat("file", F.lit(":section-"), F.col("idx")))


def navigation(rows: DataFrame, file: str = "file", order: str = "idx", key: str = "id", level: str = "level", title: str = "title") -> DataFrame:
    """``rows`` (one a section; level null without a header) with neighbours, parent, children, siblings and path."""
    per = W.Window.partitionBy(file).orderBy(order)
    out = rows.withColumns({"previous_chunk": F.lag(key).over(per), "next_chunk": F.lead(key).over(per)})
    out = paths(hierarchy(out, order, level, file).drop("end"), title, order, level, file)
    out = out.withColumn("__at", F.col(order)).withColumn("__parent_at", F.when(F.col(level).isNotNull(), F.col("parent"))).drop("parent")
    names = out.select(F.col(file).alias("__f"), F.col(order).alias("__o"), F.col(key).alias("parent_section"))
    out = out.join(names, (F.col(file) == F.col("__f")) & (F.col("__parent_at") == F.col("__o")), "left").drop("__f", "__o")
    ordered = lambda: F.transform(F.sort_array(F.collect_list(F.struct("__at", key))), lambda x: x[key])
    children = out.where("__parent_at is not null").groupBy(F.col(file).alias("__f"), F.col("__parent_at").alias("__o")).agg(ordered().alias("child_sections"))
    alike = out.where(F.col(level).isNotNull()).groupBy(F.col(file).alias("__f"), F.col(level).alias("__l"), F.coalesce("__parent_at", F.lit(-1)).alias("__o")).agg(ordered().alias("__alike"))
    out = out.join(children, (F.col(file) == F.col("__f")) & (F.col("__at") == F.col("__o")), "left").drop("__f", "__o")
    out = out.join(alike, (F.col(file) == F.col("__f")) & (F.col(level) == F.col("__l")) & (F.coalesce("__parent_at", F.lit(-1)) == F.col("__o")), "left").drop("__f", "__l", "__o")
    none = F.array().cast("array<string>")
    path = lambda c: F.when(F.col(level).isNotNull(), F.col(c)).otherwise("")
    return out.withColumns({"child_sections": F.coalesce("child_sections", none), "sibling_sections": F.coalesce(F.array_remove("__alike", F.col(key)), none), "section_path": path("section_path"), "hierarchical_context": path("context")}).drop("__at", "__parent_at", "__alike", "context")


LINKS = ("previous_chunk", "next_chunk", "parent_section")
LISTS = ("child_sections", "sibling_sections")


def dangling_navigation(chunks: DataFrame) -> DataFrame:
    """(id, field, target): links to chunks that are not there."""
    one = [F.struct(F.lit(c).alias("field"), F.array(F.col(c)).alias("targets")) for c in LINKS]
    many = [F.struct(F.lit(c).alias("field"), F.col(c).alias("targets")) for c in LISTS]
    each = chunks.select("id", F.explode(F.array(*one, *many)).alias("l")).select("id", "l.field", F.explode("l.targets").alias("target")).where("target is not null")
    return each.join(chunks.select(F.col("id").alias("target")).distinct(), "target", "left_anti").select("id", "field", "target")


def navigation_summary(chunks: DataFrame) -> DataFrame:
    sizes = {f"total_{c}": F.sum(F.size(c)) for c in LISTS}
    return chunks.agg(F.count("*").alias("total_chunks"), *[F.count(c).alias(f"with_{c}") for c in LINKS], *[F.coalesce(v, F.lit(0)).alias(k) for k, v in sizes.items()])


# ---- analysis and assembly


def analyze(rows: DataFrame, content: str = "content") -> DataFrame:
    c = F.col(content)
    out = rows.withColumn("__links", t.links(c))
    out = out.withColumns({"cross_doc_refs": t.links_of(F.col("__links"), "cross_doc"), "external_links": t.links_of(F.col("__links"), "external"), "internal_links": t.links_of(F.col("__links"), "internal")})
    return out.withColumns({"word_count": t.count_words(c), "has_code_blocks": t.has_code(c), "has_tables": t.has_table(c), "has_images": F.size(t.images(c)) > 0, "content_hash": t.hash16(c)}).drop("__links")


def assemble(parsed: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """Chunks of parsed files (``sources.files.parse_markdown``); files that failed give none."""
    rows = sections(parsed.where("success"), max_tokens).withColumn("id", chunk_id())
    rows = analyze(navigation(rows))
    field = lambda n: F.coalesce(F.col("fields")[n], F.lit(""))
    category = F.when(field("category") != "", field("category")).otherwise(t.parent_dir(F.col("file")))
    return rows.select(
        "id", F.col("content").alias("document"), F.concat(F.lit("markdown_"), "kind").alias("type"), F.col("file").alias("source_file"), F.coalesce("level", F.lit(0)).alias("section_level"),
        F.coalesce("title", field("title")).alias("title"), "section_path", "previous_chunk", "next_chunk", "parent_section", "child_sections", "sibling_sections", "cross_doc_refs", "external_links", "internal_links",
        "word_count", "has_code_blocks", "has_tables", "has_images", F.when(F.col("kind") == "frontmatter", F.col("front")).otherwise(F.coalesce("front_small", F.lit("{}"))).alias("frontmatter"),
        field("title").alias("document_title"), field("author").alias("document_author"), field("description").alias("document_description"), category.alias("document_category"), F.col("tags").alias("document_tags"),
        *[F.col("fields")[n].alias(f"document_{n}") for n in ("created", "published", "updated")],
        F.col("idx").alias("chunk_index"), F.count("*").over(W.Window.partitionBy("file")).cast("int").alias("total_chunks"), "content_hash", F.col("is_split").alias("is_split_section"), "split_index", "total_splits", F.col("split_parent").alias("split_parent_id"),
        F.coalesce("parent_context", "hierarchical_context").alias("hierarchical_context"), "tokens",
    )


def optimize(chunks: DataFrame) -> DataFrame:
    """Documents tidied; empty texts and lists become null."""
    out = {"document": t.tidy(F.col("document"))}
    for f in chunks.schema.fields:
        if f.dataType.typeName() == "string" and f.name not in ("id", "document"):
            out[f.name] = F.nullif(F.col(f.name), F.lit(""))
        elif f.dataType.typeName() == "array":
            out[f.name] = F.when(F.size(f.name) > 0, F.col(f.name))
    return chunks.withColumns(out)


def validate(chunks: DataFrame) -> DataFrame:
    """(id, problem): missing fields, wrong values, ids that repeat, links that lead nowhere."""
    missing = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in ("id", "document", "type", "source_file")]
    wrong = [F.when(F.col(c) < 0, F.lit(f"negative {c}")) for c in ("word_count", "chunk_index", "total_chunks") if c in chunks.columns]
    fields = chunks.select("id", F.explode(F.filter(F.array(*missing, *wrong), lambda x: x.isNotNull())).alias("problem"))
    twice = chunks.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    lost = dangling_navigation(chunks).select("id", F.concat(F.lit("broken "), "field", F.lit(": "), "target").alias("problem"))
    return fields.unionByName(twice).unionByName(lost)


# What a chunk's metadata must hold, and of which type.
REQUIRED = ["type", "source_file", "section_level", "title", "word_count", "chunk_index", "total_chunks", "content_hash"]
INTEGERS = ["word_count", "section_level"]
LIST_FIELDS = ["cross_doc_refs", "external_links", "internal_links", "child_sections", "sibling_sections", "document_tags"]
BOOLEANS = ["has_code_blocks", "has_tables", "has_images", "is_split_section"]


def validate_metadata(chunks: DataFrame) -> DataFrame:
    """(id, problem): required fields that are absent or null, and fields of a wrong type where they hold a value."""
    kinds = {f.name: f.dataType.typeName() for f in chunks.schema.fields}
    problems = [F.when(F.col(c).isNull() if c in kinds else F.lit(True), F.lit(f"Missing required field: {c}")) for c in REQUIRED]
    for names, right, said in ((INTEGERS, ("byte", "short", "integer", "long"), "must be an integer"), (LIST_FIELDS, ("array",), "must be a list"), (BOOLEANS, ("boolean",), "must be a boolean")):
        problems += [F.when(F.col(c).isNotNull(), F.lit(f"{c} {said}")) for c in names if c in kinds and kinds[c] not in right]
    return chunks.select("id", F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))


def processing_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks in all and by type, words, files."""
    per_type = chunks.groupBy("type").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.collect_set("source_file").alias("files"))
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_list("files"))))
    total = per_type.agg(F.sum("n").alias("total_chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("chunk_types"), F.round(F.sum("words") / F.sum("n"), 1).alias("average_words"), F.sum("words").alias("total_words"), files.alias("files"))
    return total.withColumn("total_files", F.size("files"))


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("success").count()


def resolved_references(chunks: DataFrame) -> DataFrame:
    """(id, url, target): links to other documents as chunk ids, against the corpus root."""
    each = chunks.select("id", "source_file", F.explode("cross_doc_refs").alias("url"))
    return each.select("id", "url", t.link_target(F.col("url"), F.col("source_file")).alias("target")).where("target is not null")
