"""Defaults of all operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Ranking, fusion and context limits.
    rrf_k: int = 60
    bm25_candidates: int = 100
    dense_candidates: int = 20
    rerank_limit: int = 5
    chunks_per_article: int = 20
    max_context_chars: int = 12000
    relax_filter: bool = True
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    chunk_size: int = 1000
    fusion_queries: int = 4
    original_weight: float = 3.0
    tau_high: float = 0.70
    tau_low: float = 0.20
    choices: int = 4
    crag_upper: float = 0.75
    crag_lower: float = 0.35
    crag_external: int = 3
    strip_chars: int = 20
    refine_threshold: float = 0.35
    strip_words: int = 50
    compression_target: int = 500
    late_chunk_tokens: int = 8192
    overlap_tokens: int = 512
    missing_score: float = 0.5


DEFAULTS = EngineConfig()
