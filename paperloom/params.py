"""Constants that define behaviour; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchParams:
    threshold: float = 0.50
    entity_threshold: float = 0.45
    fallback_threshold: float = 0.40
    top_k: int = 20
    entity_top_k: int = 50
    complex_top_k: int = 30
    vector_max_top_k: int = 1000
    exact_cap: float = 0.95
    base_score: float = 0.60
    per_occurrence: float = 0.05
    full_document_chunks: int = 50
    max_results: int = 50
    vector_weight: float = 0.7
    database_weight: float = 1.0
    exact_boost: float = 1.3
    rerank_min_score: float = 2.5
    rrf_k: int = 60
    max_rewrites: int = 3


@dataclass(frozen=True)
class ChunkParams:
    size: int = 512
    overlap: int = 128
    min_chars: int = 50
    min_words: int = 5
    embedding_dim: int = 768


SEARCH = SearchParams()
CHUNK = ChunkParams()
