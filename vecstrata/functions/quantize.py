"""Statistical binary quantization as aggregates and columns.

Training gives each dimension's count, mean and sum of squared deviations (m2).
With one bit a dimension, the bit says whether the value is above the mean.
With more, the value's distance from the mean in standard deviations, from -2
to 2, is written in unary.  Without means the bit says whether the value is
positive, one bit a dimension whatever the bits.
Words hold 64 bits, the lowest first; as ``bigint`` only their bits count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.0**-23


def words_for(dimensions: int, bits: int) -> int:
    return -(-dimensions * bits // 64)


def code_bytes(dimensions: int, bits: int) -> int:
    """Bytes of a code: whole words."""
    return 8 * words_for(dimensions, bits)


def train_statistics(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """(dim, count, mean, m2) of each dimension, dimensions from 0."""
    flat = vectors.select(F.posexplode(column).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    stats = flat.groupBy("dim").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    return stats.select("dim", "count", "mean", (F.col("var") * F.col("count")).alias("m2"))


def thresholds(stats: DataFrame) -> tuple[int, list[float], list[float]]:
    """(count, means, m2) on the driver: as many numbers as dimensions."""
    rows = sorted(stats.collect(), key=lambda r: r.dim)
    return (rows[0]["count"] if rows else 0), [r["mean"] for r in rows], [r["m2"] for r in rows]


def _doubles(xs: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def sbq_ones(v: Column, bits: int, count: int, mean: list[float], m2: list[float]) -> Column:
    """For each dimension how many ones its unary code has."""
    std = [(max(x, 0.0) / count) ** 0.5 if count else 0.0 for x in m2]
    z = F.zip_with(
        v, F.arrays_zip(_doubles(mean).alias("m"), _doubles(std).alias("s")), lambda x, t: F.when(t["s"] <= EPSILON, 0.0).otherwise((x.cast("double") - t["m"]) / t["s"])
    )
    return F.transform(z, lambda x: F.greatest(F.lit(0), F.least(F.lit(bits), F.floor((x + 2.0) / (4.0 / (bits + 1))).cast("int"))))


def sbq_bits(v: Column, bits: int = 1, use_mean: bool = True, count: int = 0, mean: list[float] = (), m2: list[float] = ()) -> Column:
    """The code's bits in order, as an array of 0 and 1 of length dimensions * bits."""
    if not use_mean:
        own = F.transform(v, lambda x: (x > 0).cast("int"))
        return own if bits == 1 else F.concat(own, F.array_repeat(F.lit(0), F.size(v) * (bits - 1)))
    if bits == 1:
        return F.zip_with(v, _doubles(mean), lambda x, m: (x.cast("double") > m).cast("int"))
    unary = F.transform(sbq_ones(v, bits, count, mean, m2), lambda n: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: (k < n).cast("int")))
    return F.flatten(unary)


def bit_words(bits: Column, length: int) -> Column:
    """Bits packed into 64-bit words, the lowest first."""

    def word(k: int) -> Column:
        part = F.slice(bits, 64 * k + 1, min(64, length - 64 * k))
        shifted = F.transform(part, lambda b, i: F.call_function("shiftleft", b.cast("bigint"), i.cast("int")))
        return F.aggregate(shifted, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return F.array(*[word(k) for k in range(-(-length // 64))])


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def encode_matrix(v: np.ndarray, bits: int, use_mean: bool, count: int, mean: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """The same codes for the rows of a matrix, as unsigned words; for use inside workers."""
    n, d = v.shape
    flags = np.zeros((n, words_for(d, bits) * 64), np.uint8)
    if not use_mean:
        flags[:, :d] = v > 0
    elif bits == 1:
        flags[:, :d] = v > mean
    else:
        std = np.sqrt(np.maximum(m2, 0) / max(count, 1))
        z = np.where(std <= EPSILON, 0.0, (v - mean) / np.where(std <= EPSILON, 1.0, std))
        ones = np.clip(np.floor((z + 2) / (4 / (bits + 1))), 0, bits).astype(int)
        flags[:, : d * bits] = (np.arange(bits) < ones[:, :, None]).reshape(n, -1)
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")
