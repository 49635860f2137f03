"""Small corpora from memory through the whole pipelines. What they give has no SQL form."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docgraph.operators import apiindex, embedding, markdown, openapi, outline
from docgraph.sources import files

from .registry import query, table

SPEC = {
    "openapi": "3.0.1",
    "info": {"title": "Shop", "version": "1"},
    "tags": [{"name": "items"}],
    "paths": {"/items": {"get": {"operationId": "list", "tags": ["items"], "responses": {"200": {"$ref": "#/components/schemas/Item"}, "404": {"description": "none"}}}}},
    "components": {"schemas": {"Item": {"type": "object", "properties": {"maker": {"$ref": "#/components/schemas/Maker"}}}, "Maker": {"type": "object", "properties": {"best": {"$ref": "#/components/schemas/Item"}}}}},
}
NOTES = "---\ntitle: Notes\ntags: [a, b]\n---\n# Top\n\nintro [x](other.md#Part)\n\n## Sub\n\ntext `code`\n"


def _specs(spark, sf_dir):
    """The specification once for every nation, and one that does not parse."""
    names = [f"{r.n_nationkey}/{r.n_name.lower()}.json" for r in table(spark, sf_dir, "nation").collect()]
    return files.in_memory(spark, {n: json.dumps(SPEC) for n in names} | {"bad.json": "{", "old.json": '{"openapi": "2.0"}'})


@query()
def spec_ingest(spark, sf_dir):
    return openapi.process(_specs(spark, sf_dir)).select("id", "type", "chunk_type", "content_hash", "ref_order", "referenced_by")


@query()
def spec_rejects(spark, sf_dir):
    return openapi.rejected(openapi.parse_elements(_specs(spark, sf_dir)))


@query()
def spec_index(spark, sf_dir):
    return apiindex.build_index(_specs(spark, sf_dir))


@query()
def spec_outlines(spark, sf_dir):
    return outline.outlines(_specs(spark, sf_dir))


@query()
def md_ingest(spark, sf_dir):
    names = [f"{r.n_nationkey}/{r.n_name.lower()}.md" for r in table(spark, sf_dir, "nation").collect()]
    chunks = markdown.assemble(files.parse_markdown(files.in_memory(spark, {n: NOTES for n in names})))
    return chunks.select("id", "type", "title", "section_path", "word_count", "cross_doc_refs", "document_tags", "total_chunks")


@query()
def embed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    return embedding.embed(docs, embedding.HashingEmbedder()).select("doc_id", "embedding")
