"""All settings in one place; the defaults are those that retrieval quality was published for."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: Signal names in their fixed order; ties between signals go to the earlier one.
SIGNALS = ("semantic", "section", "entity", "adjacency", "utility_question", "citation")


@dataclass(frozen=True)
class EdgeWeights:
    """Weight of each signal in the combined graph; they add up to one."""

    semantic: float = 0.150
    section: float = 0.200
    entity: float = 0.250
    adjacency: float = 0.100
    utility_question: float = 0.280
    citation: float = 0.020

    def __post_init__(self) -> None:
        total = sum(self.as_dict().values())
        if abs(total - 1) > 1e-4:
            raise ValueError(f"edge weights add up to {total:.6f}, not 1")

    def as_dict(self) -> dict[str, float]:
        return {s: getattr(self, s) for s in SIGNALS}


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 1200
    chunk_overlap: int = 100
    min_chunk_tokens: int = 32
    id_hash_prefix: int = 64
    strategy: str = "auto"  # auto, structural or semantic
    table_extraction: bool = True
    breakpoint_percentile: float = 90.0


@dataclass(frozen=True)
class Indexing:
    semantic_k: int = 7
    semantic_threshold: float = 0.75
    sparsify_threshold: float = 0.1
    edge_weight_mode: str = "fixed"  # fixed, calibrate or fit
    spectral_mode: str = "combined"  # combined or multiplex
    spectral_components: int = 32
    spectral_local_nodes: int = 3000
    clusters: int = 5
    questions_per_chunk: int = 2
    question_threshold: float = 0.80
    question_search_k: int = 20
    question_text_chars: int = 2000
    entity_mode: str = "llm_concepts"  # llm_concepts or ner
    entity_min_freq: int = 2
    max_section_members: int = 100


@dataclass(frozen=True)
class Retrieval:
    seed_k: int = 20
    hops: int = 2
    max_candidates: int = 200
    question_seeds: bool = True
    question_seed_k: int = 20
    rrf_k: int = 60
    bm25_seeds: bool = True
    bm25_seed_k: int = 20
    lexical_weight: float = 0.30
    alpha: float = 0.5
    diffusion_mode: str = "hybrid"  # spectral, ppr or hybrid
    ppr_damping: float = 0.85
    seed_aggregation: str = "max"  # max, topk_mean or relevance_weighted
    seed_topk: int = 3
    clusters: int = 5
    final_k: int = 10
    selection_mode: str = "token_budget"
    anchor_core_k: int = 10
    anchor_neighbours: int = 4
    anchor_ce_threshold: float = -10.0
    token_budget: int = 12000
    head_ratio: float = 0.30
    head_k: int = 5
    tail_ratio: float = 0.55
    backfill: bool = True
    tie_band: float = 0.02
    protected_core_k: int = 10
    mmr_lambda: float = 0.75
    sel_diffused: float = 0.35
    sel_raw: float = 0.15
    sel_redundancy: float = 0.30
    sel_connectivity: float = 0.10
    sel_diversity: float = 0.10


@dataclass(frozen=True)
class View:
    max_nodes: int = 200
    label_chars: int = 80
    preview_chars: int = 200


@dataclass(frozen=True)
class Config:
    edge_weights: EdgeWeights = field(default_factory=EdgeWeights)
    chunking: Chunking = field(default_factory=Chunking)
    indexing: Indexing = field(default_factory=Indexing)
    retrieval: Retrieval = field(default_factory=Retrieval)
    view: View = field(default_factory=View)
    fallback_language: str = "en"
    embedding_dim: int = 256


def from_env(base: Config | None = None, env: Mapping[str, str] | None = None, prefix: str = "WEFTLINE_") -> Config:
    """The settings with those that the environment gives: WEFTLINE_RETRIEVAL_SEED_K=30, for one."""
    config, env = base or Config(), os.environ if env is None else env
    out = {}
    for part in fields(config):
        group = getattr(config, part.name)
        if hasattr(group, "__dataclass_fields__"):
            given = {}
            for f in fields(group):
                if (raw := env.get(f"{prefix}{part.name}_{f.name}".upper())) is not None:
                    old = getattr(group, f.name)
                    given[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(raw)
            out[part.name] = replace(group, **given)
        elif (raw := env.get(f"{prefix}{part.name}".upper())) is not None:
            out[part.name] = type(group)(raw)
    return replace(config, **out)
