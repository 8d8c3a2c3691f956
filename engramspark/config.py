"""Limits and defaults."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import ValidationError

# Fixed values.
DEFAULT_LIMIT, MAX_LIMIT = 100, 1_000
DEFAULT_DEPTH, MAX_DEPTH = 5, 255
DEFAULT_TIMEOUT_MS, MAX_TIMEOUT_MS = 5_000, 30_000
DEFAULT_VECTOR = "default"
RESPONSE_ITEMS, STREAM_ITEMS, STREAM_BYTES = 1_024, 2_048, 2 << 20


@dataclass(frozen=True)
class VectorConfig:
    """backend "ivf" searches approximately in spaces of more than exact_threshold vectors; "exact" never does."""

    backend: str = "ivf"
    exact_threshold: int = 50_000
    semantic_top_k: int = 100
    lists: int = 64
    probes: int = 8
    sample: int = 20_000

    def __post_init__(self) -> None:
        if self.backend not in ("ivf", "exact"):
            raise ValidationError(f"unknown vector backend: {self.backend}")
        if min(self.semantic_top_k, self.lists, self.probes, self.sample) < 1 or self.exact_threshold < 0:
            raise ValidationError("vector settings must be positive")


@dataclass(frozen=True)
class MaintenanceBudget:
    max_nodes: int = 5_000_000
    max_edges: int = 10_000_000


def result_limit(limit: int | None) -> int:
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 1 <= limit <= MAX_LIMIT:
        raise ValidationError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def timeout_ms(timeout: int | None) -> int:
    timeout = DEFAULT_TIMEOUT_MS if timeout is None else timeout
    if not 1 <= timeout <= MAX_TIMEOUT_MS:
        raise ValidationError(f"timeout_ms must be between 1 and {MAX_TIMEOUT_MS}")
    return timeout


def depth(value: int | None) -> int:
    value = DEFAULT_DEPTH if value is None else value
    if not 1 <= value <= MAX_DEPTH:
        raise ValidationError(f"depth must be between 1 and {MAX_DEPTH}")
    return value
