import json

from docgraph import engine
from docgraph.__main__ import main
from docgraph.operators import markdown, store
from docgraph.plans import ingest
from docgraph.sources import files
from docgraph.sources.config import Config
from docgraph.streaming import ingest as stream


def config(tmp_path):
    (tmp_path / "specs").mkdir()
    (tmp_path / "specs/shop.json").write_text(json.dumps(ingest.SPEC))
    (tmp_path / "specs/bad.json").write_text("{")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/notes.md").write_text(ingest.NOTES)
    return Config(specs_dir=str(tmp_path / "specs"), docs_dir=str(tmp_path / "docs"), store_path=str(tmp_path / "store"), index_path=str(tmp_path / "index"), cache_path=str(tmp_path / "cache"))


def test_index_and_ask(spark, tmp_path):
    e = engine.Engine(spark, config(tmp_path))
    report = e.index()
    assert report["chunks"] == 8 and report["rejected"] == 1 and e.index()["chunks"] == 8
    said = engine.Engine(spark, e.config).open().ask("operationId: list")
    assert "shop.json:" in said and "Confidence: high" in said
    assert e.search("Notes title", file_filter="NOTES")["files_searched"] == ["notes.md"]
    got = e.fetch(["shop.json:paths/items/get"], 3)
    assert [h.id for h in got["expanded"]] == ["shop.json:components/schemas/Item", "shop.json:paths/items/get:errors", "shop.json:components/schemas/Maker"]


def test_command_line(spark, tmp_path, capsys):
    c = config(tmp_path)
    (tmp_path / ".env").write_text("\n".join(f"{k.upper()}={getattr(c, k)}" for k in ("specs_dir", "docs_dir", "store_path", "index_path", "cache_path")))
    env = ["--env-file", str(tmp_path / ".env")]
    assert main([*env, "ask", "x"], spark) == 1
    assert main([*env, "index"], spark) == 0 and main([*env, "info"], spark) == 0
    assert main([*env, "ask", "list items", "--style", "raw"], spark) == 0 and main([*env, "get", "notes.md:top:L1"], spark) == 0
    assert "=== " in capsys.readouterr().out


def test_missing_directories_give_nothing(spark, tmp_path):
    e = engine.Engine(spark, Config(specs_dir=str(tmp_path / "a"), docs_dir=str(tmp_path / "b"), store_path=str(tmp_path / "s"), index_path=str(tmp_path / "i"), cache_path=str(tmp_path / "c")))
    assert e.index() == {"chunks": 0, "rejected": 0, "index_tokens": 0}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\nx")
    s = store.ChunkStore(spark, str(tmp_path / "store")).setup()

    def run():
        chunks = lambda f: markdown.assemble(files.parse_markdown(f))
        stream.index_stream(stream.file_stream(spark, str(tmp_path / "in")), chunks, s, str(tmp_path / "cp")).awaitTermination()
        return s.count()

    assert run() == 1
    (tmp_path / "in/b.md").write_text("# B")
    assert run() == 2


def test_windowed_counts(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert stream.windowed_counts(events).agg({"n": "sum"}).head()[0] == events.count()
