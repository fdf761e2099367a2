"""A vector similarity engine on Spark DataFrames."""

from .config import IndexConfig, Quantizer, QueryBudget, SearchOptions
from .index import Snapshot, VectorIndex

__all__ = ["IndexConfig", "QueryBudget", "Quantizer", "SearchOptions", "Snapshot", "VectorIndex"]
