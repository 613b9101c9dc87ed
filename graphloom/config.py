"""Defaults of every stage."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fixed values: limits and weights that results depend on
    top_products: int = 50_000
    features_per_product: int = 5
    max_features: int = 5000
    similarity_threshold: float = 0.85
    similarity_top_k: int = 5
    resolution: float = 4.0
    level1_factor: float = 0.5
    largest_share: float = 0.4
    hub_cap: int = 30
    max_nodes: int = 1000
    vector_candidates: int = 50
    sibling_cap: int = 10
    local_top_k: int = 10
    global_top_k: int = 5
    max_hops: int = 2
    multi_hop_limit: int = 20
    seeds_per_entity: int = 3
    max_seeds: int = 10
    fuzzy_cutoff: float = 80.0
    bought_together_weight: float = 2.0
    also_bought_weight: float = 1.0
    also_bought_cap: int = 10
    bonus_bought_together: float = 0.30
    bonus_similar_to: float = 0.15
    bonus_has_brand: float = 0.10
    neighbour_discount: float = 0.5
    answer_tokens: int = 600
    baseline_tokens: int = 512


DEFAULTS = Settings()
