"""Column functions against numpy and hand-computed values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata.functions import bit_words, contains_intersection, cosine_distance, cosine_norm, dot, hamming, is_valid_vector, l2_squared, label_set, labels_match, neg_inner_product, normalised, register, sbq_bits, sbq_ones, valid_node
from vecstrata.functions.quantize import encode_matrix, words_for


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_distances(spark):
    r = one(spark, l2=l2_squared(vec(1, 2, 3), vec(1, 4, 0)), dot=dot(vec(1, 2), vec(3, 4)), ip=neg_inner_product(vec(1, 2), vec(3, 4)), cos=cosine_distance(normalised(vec(3, 4)), normalised(vec(0, 5))))
    assert r["l2"] == 13 and r["dot"] == 11 and r["ip"] == -11 and r["cos"] == pytest.approx(0.2)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 16, 31, 64, 100])
def test_distances_against_numpy(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.normal(size=n)
    r = one(spark, l2=l2_squared(vec(*a), vec(*b)), dot=dot(vec(*a), vec(*b)))
    assert r["l2"] == pytest.approx(((a - b) ** 2).sum()) and r["dot"] == pytest.approx(a @ b)


def test_norms(spark):
    r = one(spark, some=cosine_norm(vec(3, 4)), zero=cosine_norm(vec(0, 0)), unit=cosine_norm(vec(1, 0)), kept=normalised(vec(0, 0)), far=cosine_distance(vec(0, 0), vec(1, 0)))
    assert r["some"] == 5 and r["zero"] is None and r["unit"] is None and r["kept"] == [0, 0] and r["far"] == 1


def test_labels(spark):
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<smallint>")
    r = one(
        spark, set=label_set(ints(3, 1, 3)), none=label_set(F.lit(None).cast("array<smallint>")), hit=labels_match(ints(1, 2), ints(2)), miss=labels_match(ints(1, 2), ints(3)), empty=labels_match(ints(1), ints()),
        inside=contains_intersection(ints(1, 2), ints(1, 5), ints(1, 6)), outside=contains_intersection(ints(2), ints(1, 5), ints(1, 6)),
    )
    assert r == {"set": [1, 3], "none": [], "hit": True, "miss": False, "empty": True, "inside": True, "outside": False}


def test_validation(spark):
    r = one(
        spark, ok=is_valid_vector(vec(1, 2), 2), short=is_valid_vector(vec(1), 2), nan=is_valid_vector(vec(1, float("nan")), 2), inf=is_valid_vector(vec(1, float("-inf")), 2), null=is_valid_vector(F.lit(None).cast("array<double>"), 2),
        hole=is_valid_vector(F.array(F.lit(1.0), F.lit(None).cast("double")), 2), node=valid_node(F.lit(1), F.array(F.lit(2), F.lit(3)), 2), own=valid_node(F.lit(2), F.array(F.lit(2)), 2), twice=valid_node(F.lit(1), F.array(F.lit(2), F.lit(2)), 2),
    )
    assert [k for k, v in r.items() if v] == ["ok", "node"]


def test_quantizer(spark):
    mean = [1.0, 3.0, 5.0, 7.0]
    r = one(spark, mean=sbq_bits(vec(2, 2, 8, 7), 1, True, 2, mean, [0.0] * 4), none=sbq_bits(vec(-1, 0, 0.1, 2), 1, False), unary=sbq_ones(vec(-3, -0.5, 0.5, 3), 3, 4, [0.0] * 4, [4.0] * 4), wide=sbq_bits(vec(-1, 2), 2, False))
    assert r["mean"] == [1, 0, 1, 0] and r["none"] == [0, 0, 1, 1] and r["unary"] == [0, 1, 2, 3] and r["wide"] == [0, 1, 0, 0]


@pytest.mark.parametrize("bits,use_mean", [(1, True), (1, False), (3, True), (2, False)])
def test_words_match_numpy(spark, bits, use_mean):
    rng = np.random.default_rng(bits)
    v, mean, m2 = rng.normal(size=(5, 70)), rng.normal(size=70) / 5, rng.uniform(5, 9, size=70)
    want = encode_matrix(v, bits, use_mean, 8, mean, m2).view(np.int64)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k int, v array<double>")
    got = df.select("k", bit_words(sbq_bits(F.col("v"), bits, use_mean, 8, mean.tolist(), m2.tolist()), 70 * bits).alias("w")).orderBy("k").collect()
    assert [r.w for r in got] == want.tolist() and want.shape[1] == words_for(70, bits)
    h = one(spark, h=hamming(F.array(*[F.lit(int(x)) for x in want[0]]), F.array(*[F.lit(int(x)) for x in want[1]])))["h"]
    assert h == int(np.bitwise_count((want[0] ^ want[1]).view(np.uint64)).sum())


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select l2_squared(array(1, 2), array(3, 5)) a, neg_inner_product(array(1, 2), array(3, 4)) b, hamming(array(-1L), array(0L)) c, labels_match(array(1s), array()) d").first()
    assert tuple(r) == (13.0, -11.0, 64, True)
