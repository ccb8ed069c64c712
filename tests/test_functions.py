from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartoquill.functions import bloom, geo, numeric, text

GOLDEN = {("a", 2, 8192): [5447, 12580], ("a", 4, 8192): [5447, 12580, 19608, 31982], ("a", 2, 16384): [5447, 28964], ("ca", 2, 8192): [3145, 9539], ("cafe", 4, 8192): [3906, 15526, 19237, 27557], ("museum with", 2, 8192): [162, 14999], ("中", 4, 8192): [5210, 13444, 17870, 26236], ("中河", 2, 16384): [738, 23918]}


@pytest.mark.parametrize(("key", "bits"), GOLDEN.items())
def test_salted_bits_golden(key, bits):
    assert bloom.salted_bits(*key) == bits


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first()["r"]


def test_salted_bits_udf(spark):
    assert one(spark, bloom.salted_bits_udf()(F.col("t")), t=["a", "cafe"]) == sorted([5447, 12580, 3906, 15526])


def test_md5_bit_golden(spark):
    assert one(spark, bloom.md5_bits(F.col("t")), t="中")[0] == 3793


def test_larger_hashes():
    assert len(bloom.salted_bits("x", 10, 8192)) == 10 and len(bloom.salted_bits("x", 3, 1 << 16)) == 3


def test_ngrams(spark):
    assert set(one(spark, text.char_ngrams(F.col("t")), t="cafe")) == {"c", "a", "f", "e", "ca", "af", "fe"}
    assert one(spark, text.char_ngrams(F.col("t")), t="a") == ["a"]
    assert one(spark, text.char_ngrams(F.col("t")), t="") == []
    assert set(one(spark, text.char_ngrams(F.col("t"), 3), t="中河路")) == {"中", "河", "路", "中河", "河路", "中河路"}


def test_hybrid_and_query_tokens(spark):
    assert set(one(spark, text.hybrid_tokens(F.col("t")), t="Ab, cd e,fg")) == {"a", "b", "ab", "c", "d", " ", "e", "cd", "d ", " e", "fg", "cd"}
    assert set(one(spark, text.query_tokens(F.col("t")), t="Ab c")) == {"a", "b", " ", "c", "ab", "b ", " c"}


def test_token_offsets_and_entities(spark):
    got = one(spark, text.token_offsets(F.col("t")), t="to be, to")
    assert [(r["token"], r["start"], r["end"]) for r in got] == [("to", 0, 2), ("be", 3, 5), (",", 5, 6), ("to", 7, 9)]
    tagged = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(g).alias("tag")) for t, g in (("New", "LOC"), ("York", "LOC"), ("is", "O"), ("Ann", "PER"))])
    assert [tuple(r) for r in one(spark, text.entity_groups(tagged), t="")] == [("New York", "LOC"), ("Ann", "PER")]


def test_normal_document_truths_duration(spark):
    assert one(spark, text.normal_document(F.col("t")), t='"it’s\nso"') == "it's so"
    assert one(spark, text.truth_list(F.col("t")), t="3, 4") == [3, 4]
    assert one(spark, text.truth_list(F.col("t")), t="") == []
    assert one(spark, text.duration(F.col("s")), s=7311.99) == "2h01m51.99s"
    assert one(spark, text.truncated(F.col("t"), 2), t=["a", "b", "c"]) == ["a", "b"]


def test_dense_filters(spark):
    rows = spark.createDataFrame([(1, 0), (1, 9), (1, 8191), (2, 3)], "id int, bit int")
    packed = bloom.packed(rows, "id", 8192)
    got = {r["id"]: tuple(r)[1:] for r in packed.select("id", *[bloom.packed_bit(F.col("bitmap"), F.lit(b)).alias(f"b{b}") for b in (0, 3, 9, 8191)]).collect()}
    assert got == {1: (True, False, True, True), 2: (False, True, False, False)}


def test_fusion_golden(spark):
    rows = spark.createDataFrame([(4.0, 100.0), (2.0, 10.0), (0.0, 0.0)], "o double, d double")
    got = rows.select(numeric.fuse(numeric.z_score(F.col("o"), F.lit(2.0), F.lit(2.0)), numeric.closeness(F.col("d"))).alias("s")).collect()
    assert [round(r["s"], 7) for r in got] == [-1.5101385, -1.6989476, -0.7310586]


def test_quantise_and_bytes(spark):
    assert [one(spark, numeric.quantise(F.col("x"), 2.0, -3, 3), x=x) for x in (0.25, 0.75, 1.25, 9.0, -9.0)] == [0, 2, 2, 3, -3]
    assert one(spark, numeric.as_byte(F.col("x")), x=257.9) == 1


def test_circle(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 6.0, 8.0)], "g int, x double, y double")
    r = geo.boxes(rows, "g").first()
    assert (r["cx"], r["cy"], r["radius"]) == (3, 4, 5)


points = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None)
@given(a=points, b=points, k=st.integers(1, 4))
def test_knn_and_range_join_against_brute_force(spark, a, b, k):
    make = lambda p: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    dist = lambda i, j: math.hypot(a[i][0] - b[j][0], a[i][1] - b[j][1])
    want = {(i, r + 1, j) for i in range(len(a)) for r, j in enumerate(sorted(range(len(b)), key=lambda j: (round(dist(i, j), 9), j))[:k])}
    assert {(r["a_id"], r["rank"], r["b_id"]) for r in geo.knn_join(make(a), make(b), k, per_cell=1).collect()} == want
    near = {(i, j) for i in range(len(a)) for j in range(len(b)) if dist(i, j) <= 20}
    assert {(r["a_id"], r["b_id"]) for r in geo.range_join(make(a), make(b), 20.0).collect()} == near


def test_range_join_of_many_points_at_few_locations(spark, monkeypatch):
    """Two locations of 300 and 200 points meet as a few rows, with two ids in each; distances are not computed by pairs of points."""
    monkeypatch.setattr(geo, "TOGETHER", 50)
    monkeypatch.setattr(geo, "MEET", 2)
    a = spark.range(300).select("id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    b = spark.range(200).select("id", (F.col("id") % 4).cast("double").alias("x"), F.lit(0.5).alias("y"))
    out = geo.range_join(a, b, 2.0, digits=3)
    assert out.count() == out.distinct().count() == 300 * 150
    assert {(r["b"], r["dist"]) for r in out.select((F.col("b_id") % 4).alias("b"), "dist").distinct().collect()} == {(0, 0.5), (1, 0.5), (2, 1.5)}
    assert "collect_list" in out._jdf.queryExecution().optimizedPlan().toString()


def test_empty_points(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    some = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert geo.knn_join(some, none, 2).count() == 0 and geo.knn_join(none, some, 2).count() == 0 and geo.range_join(none, some, 1.0).count() == 0
