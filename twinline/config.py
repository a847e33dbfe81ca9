"""Settings of a corpus run as plain dataclasses."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ModelSpec:
    key: str
    name: str


@dataclass(frozen=True)
class CorpusConfig:
    """One run's settings; defaults are the published ones."""

    seed: int = 42
    train_split: float = 0.8
    validation_split: float = 0.1
    test_split: float = 0.1
    dev_subset: int | None = None
    min_tokens: int = 3
    max_tokens: int = 256
    max_input_length: int = 128
    max_target_length: int = 128

    near_dup_method: str | None = None  # None, "exact" or "lsh"
    near_dup_min_similarity: float = 0.95

    synonym_prob: float = 0.10
    swap_prob: float = 0.05
    deletion_prob: float = 0.05
    min_tokens_after_aug: int = 3
    use_augmented_train: bool = False

    vocab_size: int = 32_000
    models: tuple[ModelSpec, ...] = field(
        default=(
            ModelSpec("mt5_lora", "google/mt5-small"),
            ModelSpec("mt5_baseline", "google/mt5-small"),
        )
    )

    def __post_init__(self):
        ratios = (self.train_split, self.validation_split, self.test_split)
        if min(ratios) < 0 or abs(sum(ratios) - 1.0) > 1e-6:
            raise ValueError(f"split ratios must be non-negative and sum to 1: {ratios}")
        if not 0 < self.min_tokens <= self.max_tokens:
            raise ValueError("need 0 < min_tokens <= max_tokens")
        if self.near_dup_method not in (None, "exact", "lsh"):
            raise ValueError(f"unknown near_dup_method: {self.near_dup_method}")
        if not 1 / 3 < self.near_dup_min_similarity <= 1:
            raise ValueError("near_dup_min_similarity must lie above 1/3, at most at 1")

    def model(self, key: str) -> ModelSpec:
        for spec in self.models:
            if spec.key == key:
                return spec
        raise ValueError(f"no model is called {key!r}")

    def fingerprint(self) -> str:
        """Digest that changes whenever a setting does."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()
