"""Column functions; ``register`` makes them callable from SQL."""

from .quantize import bit_words, hamming, sbq_bits, sbq_ones, train_statistics
from .vectors import (
    contains_intersection,
    cosine_distance,
    cosine_norm,
    distance,
    dot,
    is_valid_vector,
    l2_squared,
    label_set,
    labels_match,
    neg_inner_product,
    normalised,
    prefix,
    register,
    valid_node,
)

__all__ = [
    "bit_words", "contains_intersection", "cosine_distance", "cosine_norm", "distance", "dot", "hamming", "is_valid_vector", "l2_squared", "label_set",
    "labels_match", "neg_inner_product", "normalised", "prefix", "register", "sbq_bits", "sbq_ones", "train_statistics", "valid_node",
]
