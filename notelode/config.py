"""Engine configuration: dataclasses, the YAML loader and its environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class Features:
    hybrid_retrieval: bool = True
    reranking: bool = True
    mmr_diversification: bool = True
    query_rewriting: bool = True
    iterative_retrieval: bool = True
    summarization: bool = True
    auto_tagging: bool = True
    related_content_generation: bool = True
    vault_hygiene_analysis: bool = True
    evaluation_mode: bool = False


@dataclass(frozen=True)
class Models:
    embedding_model: str = "nomic-embed-text"
    embedding_dimension: int = 768
    embedding_batch_size: int = 8
    llm_model: str = "llama3"
    reranker_model: str = "llama3"
    query_rewrite_model: str = "llama3"
    hygiene_model: str = "llama3"
    temperature: float = 0.2
    max_tokens: int = 512


@dataclass(frozen=True)
class StrongBoundaries:
    hr: bool = True
    callout: bool = True
    list: bool = True
    code: bool = True
    table: bool = True


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 350
    max_tokens: int = 900
    min_tokens: int = 80
    overlap_tokens: int = 60
    merge_small_chunks: bool = True
    strong_boundaries: StrongBoundaries = field(default_factory=StrongBoundaries)
    metadata_prefix_strategy: str = "heading_path"


@dataclass(frozen=True)
class FusionWeights:
    vector: float = 0.7
    lexical: float = 0.3


@dataclass(frozen=True)
class Retrieval:
    vector_top_k: int = 40
    lexical_top_k: int = 30
    fusion_strategy: str = "rrf"
    fusion_weights: FusionWeights = field(default_factory=FusionWeights)
    mmr_lambda: float = 0.65
    rerank_top_n: int = 12
    context_token_budget: int = 1800
    recency_boost: float = 0.05
    diversification_pool: int = 40


@dataclass(frozen=True)
class Prompts:
    qa: str = (
        "Answer from the chunks below and nothing else; cite them as [C{{index}}]. If they do not"
        " hold the answer, say so.\nQuestion: {{question}}\n\nChunks:\n{{context}}\n\nAnswer:\n"
    )
    summarization: str = (
        'Write a recap and recommendations for the note "{{title}}" ({{path}}).\n\n{{context}}\n'
    )
    tagging: str = (
        'Give a JSON array with at most {{tag_limit}} general tags for "{{title}}".\n\n{{context}}\n'
    )
    related: str = 'List as wiki links what to read after "{{title}}".\n\n{{context}}\n'
    journal: str = (
        "Reflect on the journal entry {{title}} ({{path}}).\n\nToday:\n{{today_entry}}\n\n"
        "Last {{history_days}} days:\n{{recent_entries}}\n\nKnowledge:\n{{knowledge_context}}\n"
    )
    rework: str = (
        "Restructure this note so that it splits well, adding and dropping no facts.\n"
        "Path: {{path}}\nTitle: {{title}}\nCreated: {{created_at}}\nModified: {{modified_at}}\n\n"
        "{{context}}\n"
    )
    reranker: str = (
        'Order these chunks by relevance to "{{question}}" as a JSON array of ids, best first.\n'
        "{{chunks}}\n"
    )
    query_rewrite: str = (
        'Give a JSON array of up to 4 other ways to search for "{{question}}".\n'
    )
    iterative_gap: str = (
        'For the question "{{question}}" this was found:\n{{context}}\n'
        "List up to 3 follow-up searches as bullets.\n"
    )


@dataclass(frozen=True)
class Paths:
    vault: str = "./vault"
    database: str = "./index"
    log_level: str = "info"


@dataclass(frozen=True)
class Config:
    version: int = 1
    paths: Paths = field(default_factory=Paths)
    features: Features = field(default_factory=Features)
    models: Models = field(default_factory=Models)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    prompts: Prompts = field(default_factory=Prompts)


LOG_LEVELS = ("debug", "info", "warn", "error")

_cached: Config | None = None


def _build(kind: type, data: Any) -> Any:
    """Dataclass of ``kind`` from a mapping; absent keys keep defaults, unknown ones are ignored."""
    data = data or {}
    defaults = kind()
    values = {}
    for item in fields(kind):
        if item.name not in data:
            continue
        current = getattr(defaults, item.name)
        value = data[item.name]
        values[item.name] = _build(type(current), value) if is_dataclass(current) else value
    return kind(**values)


def _log_level(level: Any) -> str:
    lowered = str(level).lower()
    return lowered if lowered in LOG_LEVELS else "info"


def load_config() -> Config:
    """Configuration from ``RAG_CONFIG_PATH`` (default ``./rag.config.yaml``), read once.

    ``OBSIDIAN_VAULT``, ``RAG_DB_PATH`` (else ``DB_PATH``) and ``RAG_LOG_LEVEL`` override the
    file's paths and log level.
    """
    global _cached
    if _cached is not None:
        return _cached
    path = Path(os.environ.get("RAG_CONFIG_PATH") or Path.cwd() / "rag.config.yaml")
    if not path.exists():
        example = Path(f"{path}.example")
        if example.exists():
            raise FileNotFoundError(f"{path} is missing; copy {example} to it and edit the copy")
        raise FileNotFoundError(f"no configuration file at {path}")
    data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    env = os.environ
    paths = dict(data.get("paths") or {})
    paths["vault"] = env.get("OBSIDIAN_VAULT", paths.get("vault", Paths.vault))
    paths["database"] = env.get(
        "RAG_DB_PATH", env.get("DB_PATH", paths.get("database", Paths.database))
    )
    paths["log_level"] = _log_level(
        env.get("RAG_LOG_LEVEL", paths.get("log_level", Paths.log_level))
    )
    _cached = _build(Config, {**data, "paths": paths})
    return _cached


def reset_config_cache() -> None:
    global _cached
    _cached = None
