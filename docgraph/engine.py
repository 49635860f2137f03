"""Everything put together: build a store and an index from directories, ask questions of them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docgraph.operators import apiindex, embedding, markdown, openapi
from docgraph.operators.expansion import Generator, expand_query
from docgraph.operators.retrieval import Hit, Retriever, RetrieverConfig, answer, get_chunks, search_chunks
from docgraph.operators.store import ChunkStore
from docgraph.sources import files
from docgraph.sources.config import Config


class Engine:
    def __init__(self, spark: SparkSession, config: Config = Config(), model: Generator | None = None):
        self.spark, self.config, self.model = spark, config, model
        limit = {"max_tokens": config.embedding_max_tokens} if config.embedding_max_tokens else {}
        self.embedder = embedding.load_embedder(config.embedding_model, **limit)
        self.store = ChunkStore(spark, config.store_path, config.collection, config.embedding_model, config.embedding_device)
        limits = RetrieverConfig(config.max_primary_results, config.max_total_chunks, config.max_depth)
        self.retriever = Retriever(self.store, lambda q: embedding.embed_query(self.embedder, q), limits)

    def _scan(self, find, root: str):
        try:
            return find(self.spark, root)
        except (FileNotFoundError, NotADirectoryError):  # what is not there gives nothing
            return files.in_memory(self.spark, {})

    def index(self) -> dict:
        """Rebuild the store and the text index; files that cannot be read are reported, not fatal."""
        specs, notes = self._scan(files.scan_specs, self.config.specs_dir), self._scan(files.scan_markdown, self.config.docs_dir)
        parsed, documents = openapi.graph.cut(openapi.parse_elements(specs, self.config)), openapi.graph.cut(files.parse_markdown(notes))
        both = openapi.build_chunks(parsed).drop("pos").unionByName(markdown.assemble(documents, self.config.chunk_max_tokens), allowMissingColumns=True)
        if self.config.embedding_cache:
            ready = embedding.embed_cached(both, self.embedder, embedding.EmbeddingCache(self.spark, self.config.cache_path)).drop("cache_key")
        else:
            ready = embedding.embed(both, self.embedder)
        self.store.setup(reset=True).add(ready)
        tokens = apiindex.save_index(apiindex.build_index(specs), self.config.index_path)
        return {"chunks": self.store.count(), "rejected": openapi.rejected(parsed).count() + documents.where("not success").count(), "index_tokens": tokens}

    def open(self) -> Engine:
        self.store.setup()
        if not self.store.exists():
            raise FileNotFoundError(f"no store at {self.store.table}: build it first")
        return self

    def ask(self, query: str, max_chunks: int = 50, max_tokens: int = 4000, expand: bool = False, **more) -> str:
        """A question's context as text, by the query as a model rewrites it if one is given and asked for."""
        if expand and self.model is not None:
            context = apiindex.compact(apiindex.load_index(self.spark, self.config.index_path)).head().text
            query = expand_query(self.spark, query, context, self.model)
        return answer(self.retriever, query, max_chunks, max_tokens, **more)

    def search(self, query: str, max_chunks: int = 25, file_filter: str | None = None, exclude: list[str] | None = None) -> dict:
        hits, where = search_chunks(self.store, embedding.embed_query(self.embedder, query), max_chunks, file_filter, exclude)
        rows = [r.asDict() for r in hits.orderBy("rank").collect()]
        return {"chunks": rows, "total_found": len(rows), "files_searched": where.head()[0]}

    def fetch(self, ids: list[str], expand_depth: int = 3, max_total: int = 100) -> dict:
        def get(wanted: list[str]) -> dict[str, Hit]:
            return self.retriever._get(wanted)

        return get_chunks(get, ids, expand_depth, max_total)
