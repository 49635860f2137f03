"""Retrieval of one question: search, exclusion, reference expansion, size limits, and responses as text."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docgraph.functions.text import n_tokens
from docgraph.functions.vectors import clamp

from .store import ChunkStore, top_k


@dataclass(frozen=True)
class RetrieverConfig:
    max_primary_results: int = 5
    max_total_chunks: int = 15
    max_depth: int = 3
    prioritize_primary: bool = True

    def updated(self, **changes) -> RetrieverConfig:
        known = {k: v for k, v in changes.items() if k in self.__dataclass_fields__}
        return replace(self, **known)


@dataclass
class Hit:
    id: str
    document: str
    metadata: dict
    relevance: float
    reason: str
    depth: int = 0
    ref_ids: list[str] = field(default_factory=list)


@dataclass
class Context:
    query: str
    primary: list[Hit]
    referenced: list[Hit]
    total_tokens: int = 0
    stats: dict = field(default_factory=dict)

    @property
    def total(self) -> int:
        return len(self.primary) + len(self.referenced)


def tokens(text: str) -> int:
    return len(text) // 4


def _hit(row, reason: str, relevance: float, depth: int = 0) -> Hit:
    data = row.asDict(recursive=True)
    refs = data.get("ref_order") or list((data.get("ref_ids") or {}).keys())
    meta = {k: v for k, v in data.items() if k not in ("id", "document", "embedding", "distance", "rank")}
    return Hit(data["id"], data["document"], meta, relevance, reason, depth, refs)


class Queue:
    """First-in-first-out expansion over lookups, one for each depth: all of a depth wait before its first is due."""

    def __init__(self, get: Callable[[list[str]], dict[str, Hit]]):
        self.get, self.known = get, {}

    def fetch(self, waiting: list[tuple[str, int]], at: int) -> Hit | None:
        """The chunk at the queue's head, looked up together with all that wait at its depth."""
        name, depth = waiting[at]
        if name not in self.known:
            ahead = list(dict.fromkeys(i for i, d in waiting[at:] if d == depth and i not in self.known))
            found = self.get(ahead)
            self.known.update({i: found.get(i) for i in ahead})
        return self.known[name]


def expand_references(get, seeds: list[Hit], max_depth: int, max_total: int) -> tuple[list[Hit], dict]:
    """Breadth-first expansion of retrieved chunks, with the depth that the queue reached and repeated sights counted."""
    visited = {h.id for h in seeds}
    waiting: list[tuple[str, int]] = []
    out: list[Hit] = []
    again = reached = at = 0

    def enqueue(hit: Hit, depth: int) -> int:
        seen = [r in visited for r in hit.ref_ids]
        waiting.extend((r, depth) for r, s in zip(hit.ref_ids, seen) if not s)
        return sum(seen)

    for s in seeds:
        again += enqueue(s, 1)
    queue = Queue(get)
    while at < len(waiting) and len(out) < max_total:
        name, depth = waiting[at]
        at += 1
        reached = max(reached, depth)
        if name in visited:
            again += 1
        elif depth <= max_depth and (hit := queue.fetch(waiting, at - 1)) is not None:
            visited.add(name)
            out.append(replace(hit, relevance=0.5, reason="referenced_dependency", depth=depth))
            again += enqueue(hit, depth + 1)
    return out, {"depth_reached": reached, "circular_refs_detected": again}


def size_limited(primary: list[Hit], referenced: list[Hit], most: int, prioritize: bool) -> tuple[list[Hit], list[Hit]]:
    """Over the limit, primary results keep 60 % (or half) of it at most and references fill the rest by relevance."""
    if len(primary) + len(referenced) <= most:
        return primary, referenced
    first = min(len(primary), int(most * 0.6) if prioritize else most // 2)
    return primary[:first], sorted(referenced, key=lambda h: -h.relevance)[: most - first]


class Retriever:
    def __init__(self, store: ChunkStore, embed: Callable[[str], list[float]], config: RetrieverConfig | None = None):
        self.store, self.embed, self.config = store, embed, config or RetrieverConfig()

    def update(self, **changes) -> None:
        self.config = self.config.updated(**changes)

    def _get(self, ids: list[str]) -> dict[str, Hit]:
        return {r.id: _hit(r, "lookup", 0.0) for r in self.store.get(ids).drop("embedding").collect()}

    def retrieve(self, query: str, max_primary: int = 0, max_total: int = 0, max_depth: int = 0, filters: Mapping | None = None, exclude: list[str] | None = None, references: bool = True) -> Context:
        """Search, then expand with what the total leaves; excluded ids go after each step and are not filled up."""
        empty = Context(query, [], [], 0, {"primary_count": 0, "referenced_count": 0, "depth_reached": 0, "circular_refs_detected": 0, "total_time_ms": 0.0})
        if not query or not query.strip():
            return empty
        c, barred, began = self.config, set(exclude or ()), time.time()
        try:
            rows = self.store.search(self.embed(query), max_primary or c.max_primary_results, filters).drop("embedding").orderBy("rank").collect()
        except Exception:  # a search that fails finds nothing
            return empty
        primary = [_hit(r, "primary_result", max(0.0, 1.0 - (r.distance or 0.0))) for r in rows if r.id not in barred]
        if not primary:
            return empty
        room = (max_total or c.max_total_chunks) - len(primary)
        referenced, stats = [], {"depth_reached": 0, "circular_refs_detected": 0}
        if references and room > 0:
            referenced, stats = expand_references(self._get, primary, max_depth or c.max_depth, room)
            referenced = [h for h in referenced if h.id not in barred]
        primary, referenced = size_limited(primary, referenced, c.max_total_chunks, c.prioritize_primary)
        stats |= {"primary_count": len(primary), "referenced_count": len(referenced), "total_time_ms": (time.time() - began) * 1000}
        return Context(query, primary, referenced, sum(tokens(h.document) for h in primary + referenced), stats)


# ---- the same rules over tables, for many queries at once


def relevance(hits: DataFrame) -> DataFrame:
    return hits.withColumn("relevance", F.greatest(F.lit(0.0), 1 - F.coalesce("distance", F.lit(0.0))))


def limit_context(rows: DataFrame, most: int, prioritize: bool = True) -> DataFrame:
    """``size_limited`` over (query, reason, ord, relevance, ...): references by falling relevance, then their order."""
    per = W.Window.partitionBy("query")
    is_primary = F.col("reason") == "primary_result"
    counts = rows.withColumns({"__all": F.count("*").over(per), "__primary": F.count_if(is_primary).over(per)})
    share = int(most * 0.6) if prioritize else most // 2
    first = F.least(F.col("__primary"), F.lit(share))
    rank = F.row_number().over(W.Window.partitionBy("query", "reason").orderBy(F.when(is_primary, F.lit(0.0)).otherwise(-F.col("relevance")), "ord"))
    limit = F.when(is_primary, first).otherwise(F.lit(most) - first)
    kept = counts.withColumn("__rank", rank).where((F.col("__all") <= most) | (F.col("__rank") <= limit))
    return kept.drop("__all", "__primary", "__rank")


def budget_prefix(rows: DataFrame, partition: list[str], order: list[str], size, budget: int) -> DataFrame:
    """Rows up to the first that overflows the budget; sizes are not negative, so the running sum only grows."""
    upto = W.Window.partitionBy(*partition).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(upto)).where(F.col("used") <= budget)


# ---- tools of an agent


def search_chunks(store: ChunkStore, query: list[float], max_chunks: int = 25, file_filter: str | None = None, exclude: list[str] | None = None, rerank: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summaries, files_searched): hits as summaries; reranking asks for 1.6 times as many."""
    limit = int(max_chunks * 1.6) if rerank else max_chunks
    chunks = store.chunks()
    if file_filter:
        chunks = chunks.where(F.lower("source_file").contains(file_filter.lower()))
    hits = top_k(chunks, query, limit)
    files = hits.agg(F.array_sort(F.collect_set("source_file")).alias("files_searched"))
    if exclude:
        hits = hits.where(~F.col("id").isin(exclude))
    title = F.coalesce(F.nullif(F.col("natural_name"), F.lit("")), F.concat_ws(":", "source_file", "id"))
    refs = F.map_keys("ref_ids") if "ref_ids" in hits.columns else F.array().cast("array<string>")
    out = hits.select(F.col("id").alias("chunk_id"), title.alias("title"), F.col("document").alias("content_preview"), F.col("type").alias("chunk_type"), F.col("source_file").alias("file_name"), refs.alias("ref_ids"), clamp(1 - F.coalesce("distance", F.lit(0.0))).alias("relevance_score"), "rank")
    return out, files


def get_chunks(get, ids: list[str], expand_depth: int = 3, max_total: int = 100) -> dict:
    """Chunks by id with their references by depth; the total counts the requested ones too, which are never cut."""
    found = get(ids) if ids else {}
    requested = [replace(found[i], reason="requested") for i in dict.fromkeys(ids) if i in found]
    out: list[Hit] = []
    visited, at = {h.id for h in requested}, 0
    waiting = [(r, 1) for h in requested for r in h.ref_ids if r not in visited] if expand_depth > 0 else []
    queue = Queue(get)
    while at < len(waiting) and len(requested) + len(out) < max_total:
        name, depth = waiting[at]
        at += 1
        if name in visited or (hit := queue.fetch(waiting, at - 1)) is None:
            continue
        visited.add(name)
        out.append(replace(hit, reason="expanded", depth=depth))
        if depth < expand_depth:
            waiting.extend((r, depth + 1) for r in hit.ref_ids if r not in visited)
    histogram = {0: len(requested)} if ids else {}
    for h in out:
        histogram[h.depth] = histogram.get(h.depth, 0) + 1
    total = len(requested) + len(out)
    return {"requested": requested, "expanded": out, "total_chunks": total, "total_tokens": sum(tokens(h.document) for h in requested + out), "expansion_stats": histogram, "truncated": bool(ids) and total >= max_total}


def parse_decisions(text):
    """Map of chunk id to action from lines ``id -> ACTION``, the last of an id holding; as a column."""
    lines = F.filter(F.split(F.trim(text), "\n"), lambda x: x.contains("->"))
    pairs = F.transform(lines, lambda x: F.split(F.trim(x), "->", 2))
    each = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))
    last = F.filter(each, lambda p, i: ~F.exists(F.slice(each, i + 2, F.size(each)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def apply_decisions(chunks: DataFrame, decisions: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks whose action is anything but DISCARD; those not decided on go too."""
    known = decisions.select(F.col("key").alias(key), "action")
    return chunks.join(known, key).where("action <> 'DISCARD'")


def decision_stats(original: int, kept: int, fallback: bool = False) -> dict:
    return {"original_count": original, "filtered_count": kept, "reduction_ratio": 1.0 - kept / original if original else 0.0, "fallback_used": fallback}


def rerank_prompt(query: str, chunks: list[dict], target: int, search_context: str | None = None) -> str:
    """What a language model is asked, a line ``id -> ACTION`` for every chunk worth keeping."""
    told = [f'Question: "{query}"'] + ([f"Why it is asked: {search_context}"] if search_context else [])
    for c in chunks:
        told += ["", f"Chunk {c['id']} ({c['type']}, {c['file']}), score {c['score']:.3f}", f"Title: {c['title']}", f"References: {c['ref_ids']}", c["content"]]
    told += ["", f"Answer with one line for each relevant chunk, about {target} of them: chunk id -> ACTION, the action being", "KEEP, EXPAND_1, EXPAND_3, EXPAND_5 (how far its references are needed) or DISCARD. Chunks not named are discarded."]
    return "\n".join(told)


def rerank(chunks: list[dict], query: str, target: int, decide: Callable[[str], str] | None, search_context: str | None = None) -> tuple[list[dict], dict]:
    """Chunks that an injected model keeps; the first ``target`` if it fails or decides nothing."""
    try:
        actions = {}
        for line in decide(rerank_prompt(query, chunks, target, search_context)).splitlines():
            name, arrow, action = line.partition("->")
            if arrow:
                actions[name.strip()] = action.strip()
        if not actions:
            raise ValueError("no decision")
        kept = [c for c in chunks if actions.get(c["id"], "DISCARD") != "DISCARD"]
        return kept, decision_stats(len(chunks), len(kept)) | {"decisions": actions}
    except Exception as e:
        kept = chunks[:target]
        return kept, decision_stats(len(chunks), len(kept), True) | {"decisions": {}, "error": str(e)}


# ---- responses

# The sentences of responses.
NO_RESULTS = """No relevant API documentation found for: "{query}"

This might mean:
1. The query is too specific or uses terminology not in the knowledge base
2. Try rephrasing with more general API terms
3. The indexed documentation might not cover this topic

---
Confidence: low (no matches)
Sources: 0 chunks"""


def footer(context: Context) -> str:
    return f"---\nConfidence: high (from pre-built index)\nSources: {context.total} chunks\nResponse time: {context.stats.get('total_time_ms', 0):.0f}ms retrieval"


def _fitting(parts: list[str], head: list[str], budget: int | None, gap: bool, count: Callable[[str], int]) -> tuple[list[str], int]:
    """Parts after ``head`` until the first one that overflows the budget; its cost is that of the whole text so far."""
    out, taken = list(head), 0
    for part in parts:
        if budget is not None and count("\n".join([*out, part])) > budget:
            break
        out += [part, ""] if gap else [part]
        taken += 1
    return out, taken


def respond(context: Context, max_tokens: int = 4000, style: str = "detailed", by_count: bool = False, count: Callable[[str], int] = tokens) -> str:
    """The context as text within a token budget, of which head and footer are taken off first (the head counts again).

    ``count`` is how tokens are counted; any tokenizer will do.
    """
    hits = context.primary + context.referenced
    if not hits:
        return NO_RESULTS.format(query=context.query)
    if style == "raw":
        return "\n".join(_fitting([f"=== {h.id} ===\n{h.document}\n" for h in hits], [], None if by_count else max_tokens, False, count)[0])
    end = footer(context)
    if style == "summary":
        head, parts = [f'Found {len(hits)} relevant chunks for: "{context.query}"\n'], [f"• {h.id}: {h.document[:100]}..." for h in hits]
    else:
        head = [f'Based on your query: "{context.query}"\n', "I found the following relevant API documentation:\n"]
        kind = lambda h: f" ({h.metadata['type']})" if h.metadata.get("type") else ""
        parts = [f"{i}. {h.id}{kind(h)} [relevance: {h.relevance:.2f}]\n{h.document}" for i, h in enumerate(hits, 1)]
    room = None if by_count else max_tokens - count("\n".join(head) + end)
    out, taken = _fitting(parts, head, room, style != "summary", count)
    if taken < len(hits):
        out += [f"... (showing {taken}/{len(hits)} chunks)"] if style == "summary" else [f"... (truncated {len(hits) - taken} additional chunks to fit response limit)", ""]
    if style == "summary":
        out.append("")
    return "\n".join([*out, end])


def answer(retriever: Retriever, query: str, max_chunks: int = 50, max_tokens: int = 4000, style: str = "detailed", exclude: str = "", references: bool = True, max_depth: int = 0) -> str:
    """The search tool: more than 20 chunks mean that the count limits the response, not its length."""
    barred = [x.strip() for x in exclude.split(",") if x.strip()]
    context = retriever.retrieve(query, max_total=max_chunks, max_depth=max_depth, exclude=barred, references=references)
    return respond(context, max_tokens, style, by_count=max_chunks > 20)


def summed_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query").agg(F.sum(n_tokens(F.col("document"))).alias("total_tokens"))
