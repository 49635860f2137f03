import json

import pytest
from docgraph.operators import apiindex, graph, openapi, outline
from docgraph.sources import files
from docgraph.sources.config import Config
from pyspark.sql import functions as F


def spec(**more):
    return {"openapi": "3.0.0", "info": {"title": "T", "version": "1"}, "paths": {}} | more


def chunks(spark, specs):
    found = openapi.process(files.in_memory(spark, {k: v if isinstance(v, str) else json.dumps(v) for k, v in specs.items()}))
    return {r.id: r for r in found.collect()}


@pytest.mark.parametrize(
    "data,said",
    [
        (None, "None"),
        ([], "dictionary"),
        ({"info": {"title": "a", "version": "1"}, "paths": {}}, "'openapi'"),
        (spec(openapi=3), "string"),
        (spec(openapi="2.9"), "below"),
        (spec(openapi="3.x"), "below"),
        (spec(info=[]), "Info section must"),
        (spec(info={"title": "a"}), "'version'"),
        ({"openapi": "3.0.0", "info": {"title": "a", "version": "1"}}, "either"),
        (spec(paths=[]), "Paths section"),
        (spec(paths={"x": {}}), "start with"),
        (spec(paths={"/x": 1}), "Path item"),
        (spec(components={"schemas": []}), "'schemas'"),
    ],
)
def test_invalid(data, said):
    assert any(said in e for e in openapi.spec_errors(data))


def test_valid_and_lenient():
    assert openapi.spec_errors(spec(openapi="3.1")) == []
    assert openapi.spec_errors(spec(components={"x-own": []})) == []
    assert openapi.spec_errors({"openapi": "3.0.0"}, Config(require_info_section=False, require_paths_or_components=False)) == []


def test_references_walk():
    x = {"$ref": "#/b", "also": [{"$ref": "#/a"}, {"$ref": {"$ref": "#/c"}}], "t": "$ref"}
    assert openapi.references(x) == ["#/a", "#/b", "#/c"]


def test_operations_split_and_link(spark):
    op = {"operationId": "o", "responses": {"200": {"$ref": "#/components/schemas/A"}, "default": {"$ref": "#/components/schemas/A"}, "404": {}}}
    got = chunks(spark, {"a/s.json": spec(paths={"/x": {"get": op, "weird": {}}}, components={"schemas": {"A": {"type": "object"}}})})
    main, errors = got["a/s.json:paths/x/get"], got["a/s.json:paths/x/get:errors"]
    assert main.ref_order == ["a/s.json:components/schemas/A", "a/s.json:paths/x/get:errors"]
    assert errors.ref_ids == {"a/s.json:paths/x/get": []} and errors.parent_operation == main.id and main.error_responses == errors.id
    assert "default" in errors.document and "200" not in errors.document and "default" not in main.document
    assert main.referenced_by == [errors.id] and len(got) == 4


def test_cycles_and_self_reference(spark):
    ref = lambda n: {"$ref": f"#/components/schemas/{n}"}
    got = chunks(spark, {"s.json": spec(components={"schemas": {"A": ref("B"), "B": ref("C"), "C": ref("A"), "E": {"p": ref("E")}, "X": ref("missing")}})})
    name = lambda n: f"s.json:components/schemas/{n}"
    assert {k: set(v) for k, v in got[name("A")].ref_ids.items()} == {name("B"): {name("A"), name("C")}}
    assert got[name("E")].ref_ids == {name("E"): []} and got[name("E")].referenced_by == [name("E")]
    assert got[name("X")].ref_ids == {}


def test_large_components_lose_examples(spark):
    body = {"description": "x" * 9000, "example": {"a": 1}}
    got = chunks(spark, {"s.json": spec(components={"schemas": {"A": body, "B": {"example": 1}}, "examples": {"L": "y" * 9000}})})
    big = got["s.json:components/schemas/A"]
    assert big.chunk_type == "definition" and big.has_examples == big.id + ":examples" and "example" not in big.document
    assert got[big.has_examples].parent_definition == big.id and got["s.json:components/schemas/B"].chunk_type is None
    assert got["s.json:components/examples/L"].chunk_type is None


def test_bad_files_do_not_touch_others(spark):
    given = files.in_memory(spark, {"a.json": "{", "b.yaml": "a: [", "c.json": json.dumps(spec()), "d.txt": "x", "e.json": '{"openapi": "1.0"}'})
    parsed = openapi.parse_elements(given)
    assert {r.file for r in openapi.rejected(parsed).collect()} == {"a.json", "b.yaml", "d.txt", "e.json"}
    assert [r.id for r in openapi.build_chunks(parsed).collect()] == ["c.json:info"]


def test_yaml_and_key_order(spark):
    got = chunks(spark, {"s.yml": "openapi: 3.0.0\ninfo:\n  version: '1'\n  title: Ünï\npaths: {}\n"})
    assert got["s.yml:info"].document == "version: '1'\ntitle: Ünï"


def test_scan(spark, tmp_path):
    for name in ("a.json", "sub/b.YAML", ".hidden/c.json", "sub/.d.json", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert {r.file for r in files.scan_specs(spark, str(tmp_path)).collect()} == {"a.json", "sub/b.YAML"}
    with pytest.raises(FileNotFoundError):
        files.scan_specs(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        files.scan_specs(spark, str(tmp_path / "a.json"))
    assert {r.file for r in files.read_files(spark, [str(tmp_path / "sub/b.YAML")], str(tmp_path)).collect()} == {"sub/b.YAML"}


def test_index_text(spark, tmp_path):
    op = {"operationId": "list", "summary": "s" * 50, "tags": ["a", "b", "c"]}
    data = spec(info={"title": "T" * 40, "version": "1", "description": "First sentence here. More."}, tags=[{"name": "one"}, "two"], paths={f"/p{i:02}": {"get": op, "head": op} for i in range(30)})
    text = apiindex.index_text("dir/long-file-name-here.json", data).split("\n")
    assert text[:3] == ["API: long-file-na - " + "T" * 30, "Tags: one, two", "Description: First sentence here"]
    assert len(text) == 23 and text[3] == "GET /p00 [list] (" + "s" * 40 + "...) {a,b}"
    index = apiindex.build_index(files.in_memory(spark, {"a.json": json.dumps(data), "b.json": "{"}))
    assert apiindex.save_index(index, str(tmp_path / "i")) == len("\n".join(text).replace("long-file-na", "a")) // 4
    assert apiindex.load_index(spark, str(tmp_path / "i")).count() == 1
    assert apiindex.compact(index, 100).head().text.startswith("API: a")
    assert apiindex.compact(index.limit(0)).head().text == ""


def test_closure_against_brute_force(spark):
    import random

    rng = random.Random(3)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(20)}
    df = spark.createDataFrame([(a, b, 0) for a, b in edges], "src string, dst string, pos int")

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        return seen

    got = {(r.src, r.dst) for r in graph.closure(df).where(F.col("src") != F.col("dst")).collect()}
    assert got == {(a, b) for a, _ in edges for b in reach(a) if a != b}


def test_closure_of_long_paths(spark):
    """A path of 100 edges that ends in a cycle of 70: whole, with the cycle's nodes reaching themselves."""
    after = {i: i + 1 for i in range(169)} | {169: 100}
    df = spark.createDataFrame([(str(a), str(b)) for a, b in after.items()], "src string, dst string")
    got = [(int(r.src), int(r.dst)) for r in graph.closure(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(170) for b in range(170) if b > a or a >= 100 and b >= 100}


def test_outlines(spark):
    op = {"summary": "s", "parameters": [{"name": "a", "in": "query", "required": True}, {"$ref": "#/x"}, {"name": "c"}, {"name": "d"}], "responses": {"200": {"description": "ok"}}}
    shapes = {"A": {"type": "object", "properties": {"b": {"$ref": "#/components/schemas/B"}, "c": {"type": "string"}}, "required": ["c"]}, "B": {}}
    got = {r.id: r for r in outline.outlines(files.in_memory(spark, {"d/s.json": json.dumps(spec(paths={"/p": {"get": op}}, components={"schemas": shapes})), "x.json": "{"})).collect()}
    assert got["s:get_/p"].document == "GET /p\nOperation: get_/p\n\nSummary: s\n\nParameters:\n  - a (query) [required]\n  - c (unknown) [optional]\nResponses:\n  - 200: ok"
    assert got["s:A"].document.endswith("Properties:\n  - b: unknown\n  - c: string [required]") and got["s:A"].refs == ["s:B"] and len(got) == 3


def test_index_forms(spark, tmp_path):
    (tmp_path / "v2.json").write_text(json.dumps({"version": "2.0", "total_files": 1, "files": [{"file": "a", "text": "API: a\nx"}]}))
    (tmp_path / "old.json").write_text(json.dumps({"a.json": {"description": "of a"}, "b.json": {}}))
    assert apiindex.file_context(spark, str(tmp_path / "v2.json")) == "Available API Files:\n- a: API: a"
    assert apiindex.file_context(spark, str(tmp_path / "old.json")) == "Available API Files:\n- a.json: of a\n- b.json: API Documentation"
    assert "unavailable" in apiindex.file_context(spark, str(tmp_path / "none.json"))


def test_chunks_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "b", "x": 1}, {"id": "a", "x": 2}, {"id": "b", "x": 3}]))
    assert [(r.id, r.x) for r in files.read_chunks_json(spark, str(tmp_path / "c.json"), 2).collect()] == [("b", 1), ("a", 2)]


def test_links_of_one_file_without_a_shuffle(spark):
    """References are found file by file: no join, no exchange, and an id of another file is no target."""
    ref = lambda n: {"$ref": f"#/{n}"}
    given = {"a": spec(components={"schemas": {"A": ref("b.json:info"), "B": ref("components/schemas/A")}}), "a:b.json": spec()}
    found = openapi.process(files.in_memory(spark, {f"{k}.json" if k == "a" else k: json.dumps(v) for k, v in given.items()}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r.id: r for r in found.collect()}
    assert got["a.json:components/schemas/A"].ref_order == [] and got["a.json:components/schemas/A"].referenced_by == ["a.json:components/schemas/B"]


def test_links_need_no_rendering(spark, monkeypatch):
    """Columns that are not asked for are not worked out, and those that are come out the same."""
    op = {"responses": {"200": {"$ref": "#/components/schemas/A"}, "404": {}}}
    data = spec(paths={"/x": {"get": op}}, components={"schemas": {"A": {"$ref": "#/components/schemas/B"}, "B": {"$ref": "#/components/schemas/A"}}})
    raw = json.dumps(data).encode()
    whole = openapi._file_elements("s.json", raw, Config(), set(openapi.COLUMNS))
    monkeypatch.setattr(openapi, "render", lambda content: 1 / 0)
    names = ["id", "ref_ids", "ref_order", "referenced_by", "child", "parent"]
    slim = openapi._file_elements("s.json", raw, Config(), set(names))
    assert [[r.get(c) for c in names] for r in slim] == [[r.get(c) for c in names] for r in whole] and len(slim) == 5


def test_links_against_joins(spark):
    """Random graphs, with self references and dangling ones, against the edge table and its closure."""
    import random

    rng = random.Random(5)
    given = {f"{f}.json": spec(components={"schemas": {f"S{i}": {"p": [{"$ref": f"#/components/schemas/S{rng.randrange(14)}"} for _ in range(rng.randrange(4))]} for i in range(12)}}) for f in range(6)}
    parsed = graph.cut(openapi.parse_elements(files.in_memory(spark, {k: json.dumps(v) for k, v in given.items()})))
    got = {(r.id, dst): deps for r in openapi.build_chunks(parsed).collect() for dst, deps in r.ref_ids.items()}
    assert got == {(r.src, r.dst): r.deps for r in graph.dependencies(openapi.reference_edges(parsed)).collect()}
    back = {r.id: sorted(r.referenced_by) for r in openapi.build_chunks(parsed).collect() if r.referenced_by}
    assert back == {r.id: r.referenced_by for r in graph.inverse(openapi.reference_edges(parsed)).collect()}


def test_batches_hold_bounded_rows():
    import pyarrow as pa

    n = 400  # a cycle: each reference reaches all the others
    ring = spec(components={"schemas": {f"S{i}": {"$ref": f"#/components/schemas/S{(i + 1) % n}"} for i in range(n)}})
    given = pa.RecordBatch.from_pydict({"file": ["a.json"] * 2, "content": [json.dumps(ring).encode()] * 2})
    sizes = [b.num_rows for b in openapi._elements([given], Config(), ["id", "ref_ids"])]
    assert sum(sizes) == 2 * (n + 1) and max(sizes) <= openapi.BATCH // n + 2


def test_yaml_bound():
    import random

    import yaml

    rng = random.Random(7)
    words = ["a", "plain words", "x" * 130, "a: b #c", "it's", '"q" \\', " lead", "Ünï", "\x07\n\n", "true", "", "word " * 60, "😀" * 30]

    def some(depth):
        kind = rng.randrange(6) if depth else 9
        if kind < 2:
            return {rng.choice(words) + str(rng.randrange(9)): some(depth - 1) for _ in range(rng.randrange(4))}
        if kind == 2:
            return [some(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([*words, None, True, -7, 10**40, 1.5e-300, float("nan")])

    for _ in range(400):
        x = {"N": some(6)}
        assert openapi.yaml_bound(x, 1 << 40) >= len(yaml.dump(x, default_flow_style=False))
    loop = {}
    loop["again"] = loop
    assert openapi.yaml_bound(loop) > openapi.MOST_CHARS and openapi.yaml_bound({"small": {"type": "object"}}) < openapi.MOST_CHARS


@pytest.mark.parametrize(
    "text,direct",
    [
        ('{"a":{"b":[1,-2,0,-0,null,true,"x: #y",""]},"<<":{"c":1},"2020-01-01":"2020-01-01"}\n', True),
        ('{"a": 1, "a": 2, "b" : [ ] , "on": "yes"}', True),
        ('{"a":1.5e3}', False),
        ('{"a":NaN}', False),
        ('{"a":"\\u0041"}', False),
        ('{"a":"é "}', False),
        ('{"a"\n:1}', False),
        ('{"' + "k" * 1100 + '":1}', False),
        ('{"a"' + " " * 1100 + ":1}", False),
        ("{a: 1}", False),
        ('{"a":1,}', False),
        ("{", False),
    ],
)
def test_yaml_that_is_json(text, direct):
    """Read directly only where YAML's reader says the same."""
    import yaml

    found = files._flow(text)
    assert (found is not None) == direct
    if direct:
        want = yaml.safe_load(text)
        assert found == want and list(found) == list(want)


def test_reach_leaves_nothing_on_disk(spark, sf, monkeypatch):
    """No checkpoint, no shuffle of elements or of what they reach: only two columns leave the parser."""
    from docgraph.plans import specs

    def refuse(df):
        raise AssertionError("checkpoint")

    monkeypatch.setattr(graph, "cut", refuse)
    found = specs.spec_reach(spark, sf)
    after, before = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert "Exchange" not in after and "document" not in before.split("\n")[0] and "ref_order" not in before.split("\n")[0]
    assert found.count() > 0
