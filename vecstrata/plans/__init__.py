"""Query plans over vector tables."""

from .exact import exact_topk, rescore, two_phase_topk
from .visibility import fold_mutations, node_reads, visible_nodes

__all__ = ["exact_topk", "fold_mutations", "node_reads", "rescore", "two_phase_topk", "visible_nodes"]
