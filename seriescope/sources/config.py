"""The screening configuration: one JSON file, checked when it is read."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from seriescope.operators.retrieval import POLICIES


@dataclass(frozen=True)
class ScreeningConfig:
    """What a screening run needs to know."""

    scales: tuple[int, ...] = (224, 448, 672)
    steps: int = 4
    policy: str = "non_overlap"
    gap: int = 0
    top_k: int = 16
    retained: int = 4
    weights: Mapping[int, float] = field(default_factory=dict)
    alphas: tuple[float, ...] = (0.1, 0.01, 0.001)
    method: str = "mean"
    smoothing: bool = True
    sliding: bool = False
    padding: int = 0

    def __post_init__(self) -> None:
        if not self.scales or any(type(s) is not int or s <= 0 for s in self.scales) or len(set(self.scales)) != len(self.scales):
            raise ValueError("scales must be distinct positive integers")
        if not self.alphas or any(not 0 < a < 1 for a in self.alphas):
            raise ValueError("alphas must lie between 0 and 1")
        if self.weights and (set(self.weights) != set(self.scales) or min(self.weights.values()) < 0 or not sum(self.weights.values()) > 0):
            raise ValueError("weights must match the scales and have a positive sum")
        if self.policy not in POLICIES or self.method not in ("mean", "median"):
            raise ValueError("unknown policy or method")
        if min(self.steps, self.top_k, self.retained) < 1 or min(self.gap, self.padding) < 0:
            raise ValueError("counts must be positive")


def parse_config(got: Mapping) -> ScreeningConfig:
    """A configuration from its nested JSON form; what is missing has its default."""
    refs, trim, fusion, decision = (got.get(k, {}) for k in ("reference_selection", "reference_trim", "scale_fusion", "decision"))
    if got.get("retrieval_mode", "raw-only") != "raw-only" or got.get("patch_matching", {}).get("row_wise", False):
        raise ValueError("only raw references and universal matching are supported")
    base = ScreeningConfig()
    return ScreeningConfig(
        scales=tuple(got.get("scales", base.scales)), steps=int(got.get("windowing", {}).get("step_ratio", base.steps)),
        policy=refs.get("validity_policy", base.policy), gap=refs.get("temporal_gap", base.gap), top_k=refs.get("top_k", base.top_k),
        retained=trim.get("retained_count", base.retained), weights={int(k): float(v) for k, v in fusion.get("weights", {}).items()},
        alphas=tuple(decision.get("alpha_candidates", base.alphas)), method=decision.get("method", base.method), smoothing=decision.get("smoothing", base.smoothing),
        sliding=decision.get("sliding", base.sliding), padding=decision.get("anomaly_padding", base.padding),
    )


def read_config(path: str) -> ScreeningConfig:
    with open(path, encoding="utf-8") as f:
        return parse_config(json.load(f))
