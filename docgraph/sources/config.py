"""Settings from the environment or a ``.env`` file, typed, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    specs_dir: str = "./specs"
    docs_dir: str = "./docs"
    store_path: str = "./store"
    collection: str = "chunks"
    index_path: str = "./api_index"
    embedding_model: str = "hashing"
    embedding_device: str = "cpu"
    embedding_max_tokens: int = 0  # 0: the embedder's own
    embedding_cache: bool = True
    cache_path: str = "./embedding_cache"
    chunk_max_tokens: int = 1000
    max_primary_results: int = 5
    max_total_chunks: int = 15
    max_depth: int = 3
    require_info_section: bool = True
    require_paths_or_components: bool = True
    min_openapi_version: str = "3.0.0"
    reset: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, env_file: str | None = None) -> Config:
        """Upper-case names of the fields; the process's environment wins over the file."""
        found = dict(_read(env_file)) if env_file and os.path.exists(env_file) else {}
        found |= os.environ if env is None else env
        values = {}
        for f in fields(cls):
            if (raw := found.get(f.name.upper())) is not None:
                kind = type(f.default)
                values[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**values)


def _read(path: str):
    with open(path) as lines:
        for line in lines:
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                yield name.strip(), value.strip().strip("'\"")
