"""Protocol constants, passed to operators as plain values."""

from __future__ import annotations

from dataclasses import dataclass


# Thresholds, lists and seeds of the protocol.
@dataclass(frozen=True)
class Protocol:
    """Thresholds, lists and gates of the analyses; units are those of the distances."""

    stable_at: float = 0.0
    near: float = 0.025
    thresholds: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1)
    yield_ks: tuple[int, ...] = (100, 300, 500, 1000, 5000, 10000)
    precision_ks: tuple[int, ...] = (100, 300, 500, 1000, 2000)
    top_fraction: float = 0.10
    top_floor: int = 20
    permutations: int = 2000
    bootstraps: int = 2000
    seed: int = 20260520
    launch_n: int = 200
    launch_discordance: float = 0.40
    launch_shift: float = 0.05
    select_models: int = 2
    select_rate: float = 0.30
    select_enrichment: float = 2.0
    select_p: float = 0.10
    alpha: float = 0.10
    rho: float = 0.10
    release_ks: tuple[int, ...] = (50, 100, 124, 200, 287)
    release_seeds: tuple[int, ...] = tuple(range(20))
    coverage_full: int = 1000
    coverage_min: int = 200


DEFAULT = Protocol()

# Preregistered endpoints with the gates that are numbers; null where a gate is not one.
ENDPOINTS = [
    ("E1_pairwise_binary_discordance", 0.40, 0.10, 200),
    ("E2_near_hull_localization", None, None, None),
    ("E3_model_ranking_flip", 0.05, 0.02, None),
    ("E4_discovered_stable_count_delta", 0.25, 0.10, 50),
    ("E5_release_decision_flip_probe", None, None, None),
]
