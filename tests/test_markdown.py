import json

from docgraph.functions import text as t
from docgraph.operators import markdown as md
from docgraph.sources import files
from pyspark.sql import functions as F


def assemble(spark, contents, **kw):
    return md.assemble(files.parse_markdown(files.in_memory(spark, contents)), **kw)


def one(spark, f, *values):
    return spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))]).select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).head().x


def test_headers(spark):
    df = spark.createDataFrame([("f", "x\n# A\n####### no\n  ## B  \n```\n# code\n```\n#no")], "file string, content string")
    got = [(r.level, r.text, r.position, r.line_number) for r in md.headers(df).collect()]
    assert got == [(1, "A", 2, 2), (2, "B", 17, 4), (1, "code", 30, 6)]


def test_small_file_is_one_merged_section_with_repeats(spark):
    [r] = assemble(spark, {"d/a.md": "# A\n\nx\n\n## B\n\ny"}).collect()
    assert r.id == "d/a.md:a:L1" and r.document == "# A\n\nx\n\n## B\n\ny\n\n## B\n\ny" and r.document_category == "d"


def test_split_with_context(spark):
    long = "word " * 120
    rows = assemble(spark, {"a.md": f"intro\n# A\n\nabout\n\n## B b\n{long}\n## C\n{long}\n# D\nz"}, max_tokens=100).orderBy("chunk_index").collect()
    assert [r.id for r in rows] == ["a.md:document", "a.md:a:L2", "a.md:c:L8-2", "a.md:d:L10"]
    assert rows[2].document.startswith("# A\n\nabout > C\n\n## C") and rows[2].split_parent_id == "a" and rows[2].total_splits == 3
    assert rows[1].is_split_section and rows[1].next_chunk == rows[2].id and rows[2].parent_section == rows[1].id
    assert rows[1].child_sections == [rows[2].id] and rows[2].section_path == "a/c" and rows[1].sibling_sections == [rows[3].id]


def test_front_matter(spark):
    rows = assemble(spark, {"a.md": "---\ntitle: T\ntags: x\ncategory:\n---\nbody [l](b.md#S)"}).orderBy("chunk_index").collect()
    assert [r.type for r in rows] == ["markdown_frontmatter", "markdown_document"]
    assert rows[0].document_tags == ["x"] and rows[0].document_category == "None" and json.loads(rows[0].frontmatter)["category"] == ""
    assert rows[1].title == "T" and rows[1].cross_doc_refs == ["b.md#S"]


def test_bad_files(spark):
    parsed = files.parse_markdown(files.in_memory(spark, {"bad.md": "---\na: [\n---\nx", "good.md": "x"}))
    assert {r.file: r.success for r in parsed.collect()} == {"bad.md": False, "good.md": True}
    assert {r.success: r["count"] for r in md.failures(parsed).collect()} == {False: 1, True: 1}


def test_empty_and_blank_files(spark):
    rows = assemble(spark, {"a.md": "", "b.md": " \n "}).collect()
    assert {(r.id, r.document) for r in rows} == {("a.md:document", ""), ("b.md:document", "")}


def test_links_and_targets(spark):
    text = "[a](#x) ![i](p/i.png) [b](../o.md#S t)\n<http://e.org> [m](mailto:x@y) [a](#x)"
    got = one(spark, lambda c: F.struct(*[t.links_of(t.links(c), k).alias(k) for k in ("internal", "cross_doc", "external")]), text)
    assert got.asDict() == {"internal": ["#x"], "cross_doc": ["p/i.png", "../o.md#S t"], "external": ["mailto:x@y", "http://e.org"]}
    assert one(spark, t.link_target, "../o.md#S_t", "d/e/a.md") == "d/o.md:s-t"
    assert one(spark, t.link_target, "o.md", "a.md") == "o.md:document" and one(spark, t.link_target, "i.png", "a.md") is None


def test_slugs_words_tokens(spark):
    assert [one(spark, f, "Q. Ünï_x  a-b!") for f in (t.slug_header, t.slug_split, t.slug_anchor)] == ["q-ünï_x-a-b", "q-ünï_x-a-b", "q-ünï-x-a-b"]
    assert one(spark, t.count_words, "# A **b** `c` [d e](u) ![f](g)\n```\nno\n```") == 5
    assert one(spark, lambda c: t.trim_tokens(c, 2), "x" * 20) == "xxxxx..." and one(spark, lambda c: t.trim_tokens(c, 0), "x") == ""
    assert one(spark, t.has_code, "a\n    b") and not one(spark, t.has_code, "a\n    \nb")
    assert one(spark, t.has_table, "| a |\n| :-- |") and one(spark, t.tidy, " a  \n\n\n b \n") == "a\n\n b"


def test_versions(spark):
    for v, ok in (("3.0", True), ("3.1.0", True), ("2.9.9", False), ("3.0.0.1", True), ("x", False)):
        assert one(spark, lambda c: t.version_at_least(c, "3.0.0"), v) is ok


def test_validate_optimize_stats(spark):
    rows = assemble(spark, {"a.md": "# A\n\nx  \n\n\n\ny", "b.md": "# B"})
    assert md.validate(rows).count() == 0
    assert {r.problem for r in md.validate(rows.union(rows.where("id = 'b.md:b:L1'"))).collect()} == {"duplicate id"}
    assert md.optimize(rows).where("source_file = 'a.md'").head().document == "# A\n\nx\n\ny"
    stats = md.processing_stats(rows).head()
    assert stats.total_chunks == 2 and stats.files == ["a.md", "b.md"] and stats.chunk_types == {"markdown_section": 2}
    summary = md.navigation_summary(rows).head()
    assert summary.with_previous_chunk == 0


def test_config_clamp():
    assert md.clamp_config(1, 1, 1)[0] == 100 and md.clamp_config(99999)[0] == 8000


def test_unique_ids(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(["a", "b", "a", "a"])], "file string, pos int, title string")
    assert [r.identifier for r in md.unique_ids(df, t.slug_header(F.col("title"))).orderBy("pos").collect()] == ["a", "b", "a-2", "a-3"]


def test_dangling_links_of_all_fields(spark, sf):
    from docgraph import plans

    found = plans.queries()["nav_validate_fields"](spark, sf)
    assert {r.field for r in found.select("field").distinct().collect()} == {"previous_chunk", "next_chunk", "parent_section", "child_sections", "sibling_sections"}
