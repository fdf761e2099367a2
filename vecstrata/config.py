"""Index configuration, search options and budgets, all checked on construction."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, fields

from .errors import InvalidArgumentError

METRICS = ("l2", "cosine", "inner_product")
#: While a graph is built, lists may grow to this multiple of ``max_neighbors``.
SLACK = 1.3


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidArgumentError(message)


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


@dataclass(frozen=True)
class Quantizer:
    """Statistical binary quantization: bits for each dimension, and whether means are the thresholds."""

    bits: int = 1
    use_mean: bool = True

    def __post_init__(self) -> None:
        _need(_whole(self.bits) and 1 <= self.bits <= 32, "bits must be in 1..=32")


@dataclass(frozen=True)
class IndexConfig:
    dimensions: int
    routing_dimensions: int | None = None
    distance: str = "l2"
    max_neighbors: int = 50
    build_search_list_size: int = 100
    max_alpha: float = 1.2
    quantizer: Quantizer | None = None
    has_labels: bool = False
    #: Graphs built side by side; node n belongs to graph (n - 1) % shards.  One graph is the parity mode.
    shards: int = 1
    #: Rows that are wired together while a graph is built; 1 wires one after the other, each seeing all before it.
    build_round: int = 64

    def __post_init__(self) -> None:
        _need(_whole(self.dimensions) and self.dimensions > 0, "dimensions must be positive")
        if self.routing_dimensions is None:
            object.__setattr__(self, "routing_dimensions", self.dimensions)
        _need(_whole(self.routing_dimensions) and 1 <= self.routing_dimensions <= self.dimensions, "routing_dimensions must be in 1..=dimensions")
        _need(self.distance in METRICS, f"distance must be one of {METRICS}")
        _need(_whole(self.max_neighbors) and self.max_neighbors > 0, "max_neighbors must be positive")
        _need(_whole(self.build_search_list_size) and self.build_search_list_size > 0, "build_search_list_size must be positive")
        _need(math.isfinite(self.max_alpha) and self.max_alpha >= 1.0, "max_alpha must be finite and at least 1")
        _need(_whole(self.shards) and self.shards > 0, "shards must be positive")
        _need(_whole(self.build_round) and self.build_round > 0, "build_round must be positive")

    @property
    def max_neighbors_during_build(self) -> int:
        return math.ceil(self.max_neighbors * SLACK)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> IndexConfig:
        return cls(**{**d, "quantizer": Quantizer(**d["quantizer"]) if d.get("quantizer") else None})

    def differences(self, other: IndexConfig) -> list[str]:
        """Names of the fields in which the two differ."""
        return [f.name for f in fields(self) if getattr(self, f.name) != getattr(other, f.name)]


@dataclass(frozen=True)
class QueryBudget:
    """Limits of a query; going beyond one is an error, never a shorter answer."""

    max_visited: int = 10_000
    max_candidates: int = 20_000
    max_read_batch: int = 256
    max_rescore: int = 1_000
    max_full_vector_bytes: int = 64 << 20
    max_query_bytes: int = 8 << 20

    def __post_init__(self) -> None:
        for f in fields(self):
            _need(_whole(getattr(self, f.name)) and getattr(self, f.name) > 0, f"{f.name} must be positive")


@dataclass(frozen=True)
class SearchOptions:
    limit: int
    search_list_size: int
    filter: tuple[int, ...] | None = None
    rescore: bool = True
    budget: QueryBudget = field(default_factory=QueryBudget)

    def __post_init__(self) -> None:
        _need(_whole(self.limit) and self.limit > 0, "limit must be positive")
        _need(_whole(self.search_list_size) and self.search_list_size >= self.limit, "search_list_size must be at least limit")
        if self.filter is not None:
            object.__setattr__(self, "filter", label_set(self.filter))


def label_set(labels) -> tuple[int, ...]:
    """Sorted, distinct labels, each within 16 bits."""
    out = tuple(sorted(set(labels)))
    _need(all(_whole(x) and -(1 << 15) <= x < 1 << 15 for x in out), "a label must fit in 16 bits")
    return out
