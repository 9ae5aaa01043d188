import math

import pytest
from pyspark.sql import functions as F

from ternspark.functions import cols, moments, quantiles, tails
from ternspark.functions.quantiles import exact_quantiles, quantile_values

NAMES = ["SiO2.(Wt%)", "Al2O3.(Wt%)", "Fe2O3.(Wt%)"]


def test_names():
    assert cols.clean_names(NAMES) == ["SiO2", "Al2O3", "Fe2O3"]
    assert cols.clean_names(["aspect.ratio_x"]) == ["Aspect Ratio X"]
    assert cols.safe_names(NAMES) == ["SiO2", "Al2O3", "Fe2O3"]
    assert cols.safe_names(["a b(%)"]) == ["a_b___"]
    with pytest.raises(ValueError):
        cols.safe_names(["a b", "a_b"])


def test_to_number(spark):
    text = [" 12 ", "1e3", "abc", "", "NA", "1d", None, "-.5", "0x1A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    got = [r.x for r in cols.as_numeric(df.withColumnRenamed("t", "x"), ["x"]).orderBy("i").collect()]
    assert got == [12.0, 1000.0, None, None, None, None, None, -0.5, None]


def test_to_number_judges_what_a_cast_would_take(spark):
    text = ["0x1p3", "-0X1p3", "\t1", "1\t", "1f", "1.", "1.e5", "+.5e-2", "1e400", "-Infinity", "inf", "INF", "+Inf", "NaN", "1_0", "--1", ".", "1e5.", "٣"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, x string")
    got = [r.x for r in cols.as_numeric(df, ["x"]).orderBy("i").collect()]
    assert got == [None, None, None, None, None, 1.0, 100000.0, 0.005, math.inf, -math.inf, math.inf, None, math.inf, None, None, None, None, None, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "`x.y` double")
    assert [r[0] for r in df.select(cols.num("x.y")).collect()] == [1.0, None, None, math.inf]


def test_kinds(spark):
    df = spark.createDataFrame([("a", 1.0, True)], "s string, x double, b boolean")
    assert cols.numeric_columns(df) == ["x"]
    assert cols.categorical_columns(df) == ["s", "b"]


def test_min_max_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    assert [(r.x_norm, r.k_norm) for r in cols.min_max(df, ["x", "k"]).orderBy("x").collect()] == [(0.0, None), (1.0, None)]


@pytest.mark.parametrize("most", [10_000, 3])
def test_quantiles_of_few_values(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST", most)
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 100, 5, 6, 7, 8, 9, 10)], "x double")
    assert quantile_values(df, ["x"], [0.25, 0.5, 0.75])["x"] == pytest.approx([3.5, 6.5, 8.75])
    assert quantile_values(df, ["x"], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])["x"] == pytest.approx([1, 2.8, 5.6, 7.4, 9.2, 100])


def test_bracketed_quantiles_by_group(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.rand(5).alias("x"), F.when(F.col("id") % 7 > 0, F.round(F.rand(6), 1)).alias("y"))
    df.cache()
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    key = lambda r: (r["g"], r["column"], r["prob"])
    a = {key(r): r["value"] for r in exact_quantiles(df, ["x", "y"], probs, ["g"]).collect()}
    b = {key(r): r["value"] for r in exact_quantiles(df, ["x", "y"], probs, ["g"], direct_rows=0).collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v) for k, v in a.items())


def test_quantiles_are_narrowed_until_few_values_are_left(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST", 50)
    monkeypatch.setattr(quantiles, "BRACKET", 0.02)
    df = spark.range(30_000).select(F.rand(5).alias("x"), F.floor(F.rand(6) * 40).cast("double").alias("y"), F.exp(F.randn(7) * 4).alias("z")).cache()
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    got = quantile_values(df, ["x", "y", "z"], probs)
    want = df.agg(*[F.percentile(n, probs).alias(n) for n in "xyz"]).first()
    assert all(got[n] == pytest.approx(want[n]) for n in "xyz")
    df.unpersist()


def test_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantile_values(df, ["x"], [0.5]) == {"x": [None]}


def test_gram_matches_expressions(spark):
    df = spark.range(500).select((F.rand(1) + 1e6).alias("a"), F.rand(2).alias("b"), F.when(F.col("id") % 5 > 0, F.rand(3)).alias("c"))
    df.cache()
    n, mean, cov = moments.covariance(df, ["a", "b", "c"])
    m, mean2, cov2 = moments._gram(df, ["a", "b", "c"])
    assert n == m == 400 and mean == pytest.approx(mean2) and cov == pytest.approx(cov2, abs=1e-8)


def test_tails():
    assert tails.chi_square_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-6)
    assert tails.chi_square_quantile(0.99, 2) == pytest.approx(9.210340, abs=1e-6)
    assert tails.chi_square_upper(3.0, 2) == pytest.approx(math.exp(-1.5))
    w, p = tails.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.05


def test_ranks_in_ranges(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") * 7919 % 501).cast("double").alias("x"))
    one = sorted(map(tuple, moments.average_ranks(df, ["x"], ["r"]).collect()))
    monkeypatch.setattr(moments, "RANGES", 8)
    assert sorted(map(tuple, moments.average_ranks(df, ["x"], ["r"]).collect())) == one
    assert one[0][1] == pytest.approx((1 + sum(1 for v in one if v[0] == 0)) / 2)
