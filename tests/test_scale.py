"""Operators that must not see all rows, or a group, in one task: forced small bounds against brute force."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import ternspark
from ternspark.functions import ranges
from ternspark.operators import stats, ternary


def test_numbered_in_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1.0, 2.0, 2.0, 2.0, rng.random()]), rng.choice([None, "a", "b", f"n{rng.randrange(50)}"]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "x double, s string, k long").repartition(5)
    got = ranges.numbered(df, [F.col("x"), F.col("s")], "at", range_rows=100).collect()
    assert sorted(r["at"] for r in got) == list(range(1, 3001))
    key = lambda r: (r["x"] is not None, r["x"] or 0.0, r["s"] is not None, r["s"] or "")
    assert [key(r) for r in sorted(got, key=lambda r: r["at"])] == sorted(key(r) for r in got)
    whole = {r["k"]: r["at"] for r in ranges.numbered(df, [F.col("x"), F.col("s")], "at").collect()}
    assert {r["k"]: r["at"] for r in got} == whole
    assert ranges.numbered(df.limit(0), [F.col("x")], "at").count() == 0


def test_a_colour_index_for_every_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 7, None).otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"), F.explode(F.expr("sequence(1, 1 + cast(id % 3 as int))")).alias("k"))
    got = ternary.group_colours(df, "g").collect()
    assert sorted(r["colour_index"] for r in got) == list(range(1, 5001))
    want = sorted(got, key=lambda r: (-r["samples"], r["group"] is not None, r["group"] or ""))
    assert [r["colour_index"] for r in want] == list(range(1, 5001))


def test_a_column_of_any_name_may_hold_the_places(spark):
    df = spark.range(2000).selectExpr("id * 37 % 2000 as __key", "id % 7 as __range", "id as __size")
    for out in ("__place", "__before", "at"):
        got = ranges.numbered(df, [F.col("__range"), F.col("__key")], out, range_rows=100).collect()
        assert set(got[0].asDict()) == {"__key", "__range", "__size", out}
        assert [r[out] for r in sorted(got, key=lambda r: (r["__range"], r["__key"]))] == list(range(1, 2001))


@pytest.mark.parametrize("range_rows", [1 << 20, 300, 40])
def test_colours_of_many_files_in_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ternary, "numbered", lambda df, order, out, **kw: ranges.numbered(df, order, out, range_rows, **kw))
    df = spark.range(9000).selectExpr("case when id % 10 < 6 then 'big' when id % 10 = 6 then null else concat('f', id % 83) end as f", "if(id % 900 = 0, null, id * id % 1201) as g")
    got = ternary.group_colours_by(df, "g", "f").collect()
    files = {}
    for r in got:
        files.setdefault(r["f"], []).append(r)
    assert len(got) == df.distinct().count() > 2000 and len(files) == 85 and len(files["big"]) > 300
    for own in files.values():
        want = sorted(own, key=lambda r: (-r["samples"], r["group"] is not None, r["group"] or 0))
        assert [r["colour_index"] for r in want] == list(range(1, len(own) + 1))


def brute_tau(x, y):
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    tied = [sum(n * n for n in np.unique(v, return_counts=True)[1]) for v in (x, y)]
    whole = (len(x) ** 2 - tied[0]) * (len(x) ** 2 - tied[1])
    return 2 * s / math.sqrt(whole) if whole else None


@pytest.mark.parametrize(("kind", "cell"), [("smooth", 40), ("ties", 10), ("hot", 20), ("hot", 1 << 17), ("constant", 5)])
def test_kendall_in_ranges(spark, kind, cell):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = x * 0.5 + rng.normal(size=400)
    if kind == "ties":
        x, y = np.round(x), np.round(y * 2)
    if kind == "hot":
        x[:250], y[100:300] = 0.25, -0.5
        x[399] = np.inf
    if kind == "constant":
        y[:] = 3.0
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": y})).union(spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "a double, b double"))
    r = stats.kendall(df, "a", "b", cell_pairs=cell).first()
    want = brute_tau(x, y)
    assert r["n"] == 400 and (r["r"] is None if want is None else r["r"] == pytest.approx(want, abs=1e-12))


def test_kendall_of_no_rows_and_of_all_pairs(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert tuple(stats.kendall(none, "a", "b").first()) == ("a", "b", None, 0)
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 4.0), (3.0, 3.0, 4.0)], "a double, b double, c double")
    table = {(r["var1"], r["var2"]): r["r"] for r in stats.correlations(df, method="kendall").collect()}
    assert len(table) == 9 and table["a", "b"] == table["b", "a"] == pytest.approx(1 / 3) and table["a", "a"] == pytest.approx(1)


FRESH = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
"""


def in_new_session(code):
    """What ``code`` prints last, with a ``spark`` of its own: its plans depend on the columns that a session has numbered."""
    root = os.path.dirname(os.path.dirname(ternspark.__file__))
    done = subprocess.run([sys.executable, "-c", FRESH + code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout.strip().splitlines()[-1]


def test_kendall_in_ranges_of_a_new_session():
    got = in_new_session("""
from ternspark.operators import stats
df = spark.range(2000).selectExpr("round(pow(id * 7919 % 2003, 1.3), 1) as a", "id * 31 % 701 as b", "1 as c", "2 as d", "3 as e")  # y is the session's column 7
print(stats.kendall(df, "a", "b", cell_pairs=300).first()["r"])
""")
    n = np.arange(2000)
    x, y = np.round((n * 7919 % 2003) ** 1.3, 1), n * 31 % 701
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert float(got) == pytest.approx((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()), abs=1e-12)


def test_concordance_of_many_points():
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 40, (900, 2)), axis=0)
    w = rng.integers(1, 5, len(points))
    x, y = points[:, 0], points[:, 1]
    want = sum(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    assert stats.concordance(x, y, w) == want
    assert stats.concordance(x[:0], y[:0], w[:0]) == 0


def brute_loess(x, y, span, points):
    out = []
    for g in np.linspace(x.min(), x.max(), points):
        d = np.abs(x - g)
        h = np.sort(d)[max(1, math.floor(span * len(x) + 1e-9)) - 1]
        if h == 0:
            out.append((g, y[d == 0].mean()))
            continue
        u = (x - g) / h
        w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
        m = np.array([[(w * u ** (i + j)).sum() for j in range(3)] for i in range(3)])
        out.append((g, np.linalg.lstsq(m, np.array([(w * y * u**i).sum() for i in range(3)]), rcond=1e-12)[0][0]))
    return np.array(out)


@pytest.mark.parametrize(("kind", "near"), [("smooth", 10_000), ("smooth", 50), ("discrete", 50), ("skewed", 200), ("hot", 50)])
def test_loess_on_its_nearest_rows(spark, monkeypatch, kind, near):
    monkeypatch.setattr(stats, "NEAR_ROWS", near)
    rng = np.random.default_rng(7)
    x = {"smooth": rng.normal(size=3000), "discrete": rng.integers(0, 40, 3000).astype(float), "skewed": rng.lognormal(sigma=2, size=3000), "hot": np.where(rng.random(3000) < 0.8, 1.5, rng.random(3000) * 4)}[kind]
    y = np.sin(x) * 10 + rng.normal(size=3000) + 1000
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).union(spark.createDataFrame([(None, 1.0), (float("inf"), 2.0), (1.0, float("nan"))], "x double, y double"))
    got = np.array([tuple(r) for r in stats.loess(df, "x", "y", 0.5 if kind != "hot" else 0.3, 20).collect()])
    want = brute_loess(x, y, 0.5 if kind != "hot" else 0.3, 20)
    assert np.abs(got[:, 0] - want[:, 0]).max() < 1e-12
    fine = np.isfinite(want[:, 1])
    assert np.abs(got[fine, 1] / want[fine, 1] - 1).max() < 1e-9


def test_paired_by_position_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(9)
    a, b = (pd.DataFrame({"k": rng.permutation(500), "v": rng.normal(size=500)}) for _ in range(2))
    one = stats.paired_by_position(spark.createDataFrame(a), spark.createDataFrame(b), ["v"], ["k"]).first()
    monkeypatch.setattr(stats, "numbered", lambda df, order, out: ranges.numbered(df, order, out, 50))
    two = stats.paired_by_position(spark.createDataFrame(a), spark.createDataFrame(b), ["v"], ["k"]).first()
    want = np.corrcoef(a.sort_values("k")["v"], b.sort_values("k")["v"])[0, 1]
    assert one["r"] == pytest.approx(want) and two["r"] == pytest.approx(want) and two["n"] == 500


def values_with(kind, n=4000):
    rng = np.random.default_rng(11)
    x = rng.lognormal(sigma=3, size=n) if kind != "steps" else np.repeat(rng.integers(0, 7, n // 8).astype(float), 8)
    if kind == "infinite":
        x[:40], x[40:90] = -np.inf, np.inf
    if kind == "spike":
        x[: n // 2] = 2.0
    if kind == "far":
        x[:3] = [-1.7e308, 1.7e308, 1e-300]
    return x


def type7(x, p):
    x = np.sort(x)
    h = (len(x) - 1) * p
    a, b = x[math.floor(h)], x[math.ceil(h)]
    return a if a == b else a + (h - math.floor(h)) * (b - a)


@pytest.mark.parametrize("kind", ["plain", "steps", "infinite", "spike", "far"])
@pytest.mark.parametrize("grouped", [False, True])
def test_narrowed_quantiles(spark, monkeypatch, kind, grouped):
    from ternspark.functions import quantiles

    monkeypatch.setattr(quantiles, "MOST", 20)
    probs = [0.0, 0.001, 0.2, 0.25, 0.5, 0.75, 0.999, 1.0]
    x = values_with(kind)
    g = ["hot" if k % 10 else [None, "b"][k // 10 % 2] for k in range(len(x))]  # one group holds nine tenths
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": -x})).union(spark.createDataFrame([("hot", None, float("nan")), ("empty", None, None)], "g string, x double, y double")).repartition(3)
    if not grouped:
        got = quantiles.quantile_values(df, ["x", "y"], probs)
        for n, v in (("x", x), ("y", -x)):
            assert got[n] == pytest.approx([type7(v, p) for p in probs], rel=1e-12)
        return
    rows = quantiles.exact_quantiles(df, ["x", "y"], probs, ["g"], direct_rows=1000).collect()
    found = {(r["g"], r["column"], r["prob"]): r["value"] for r in rows}
    assert len(rows) == len(found) == 4 * 2 * len(probs) and found["empty", "x", 0.5] is None
    names = np.array([k or "" for k in g])
    for key in ("hot", None, "b"):
        for n, v in (("x", x), ("y", -x)):
            for p in probs:
                want = type7(v[names == (key or "")], p)
                assert found[key, n, p] == want or found[key, n, p] == pytest.approx(want, rel=1e-12)


def test_few_values_reach_the_driver(spark, monkeypatch):
    from ternspark.functions import quantiles

    df = spark.range(200_000).select(F.when(F.col("id") == 5, -math.inf).when(F.col("id") == 6, math.inf).otherwise(F.col("id") * 1.0).alias("x"))
    met = []
    settle = quantiles._Target.settle
    monkeypatch.setattr(quantiles._Target, "settle", lambda self, values: (met.append(len(values)), settle(self, values))[1])
    monkeypatch.setattr(quantiles, "MOST", 300)
    got = quantiles.quantile_values(df, ["x"], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])["x"]
    assert got[0] == -math.inf and got[-1] == math.inf and max(met) <= 300


# forest, robust distance, tails, normality


def test_chi_square_tails_as_columns(spark):
    from ternspark.functions import tails

    x = [0.0, 1e-9, 0.3, 1.0, 3.9, 4.1, 7.9, 8.1, 20.0, 90.0, 700.0, 5000.0, math.inf, None, float("nan"), -1.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for p in (1, 2, 3, 4, 5, 8, 13, 40):
        got = [r[0] for r in df.select(tails.chi_square_upper_column(F.col("x"), p)).collect()]
        for v, g in zip(x, got, strict=True):
            if v is None or v != v:
                assert g is None
            else:
                want = 0.0 if v == math.inf else tails.chi_square_upper(v, p)
                assert g == pytest.approx(want, rel=1e-9, abs=1e-300 if v < 700 else 1e-150)


def test_forest_is_grown_on_executors_and_walked_as_one(spark):
    from ternspark.operators import iforest

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(3000, 2)), np.repeat([[0.5, 0.5]], 2000, axis=0), [[9.0, 9.0]]])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    forest = iforest.train(df, ["a", "b"], trees=40, sample_size=64)
    assert forest.column.shape == (40, 127) and (forest.column[:, 0] >= 0).all()
    again = iforest.train(df.repartition(7), ["a", "b"], trees=40, sample_size=64)
    assert (again.column == forest.column).all() and (again.value == forest.value).all()
    assert len({tuple(v) for v in forest.value}) == 40  # every tree has rows of its own
    got = iforest.score_batch(forest, x)

    def walk(row):
        total = 0.0
        for c, v, n in zip(forest.column, forest.value, forest.length, strict=True):
            at = 0
            while c[at] >= 0:
                at = 2 * at + 1 + int(row[c[at]] >= v[at])
            total += n[at]
        return 2 ** (-total / 40 / forest.norm)

    assert got[::97] == pytest.approx([walk(r) for r in x[::97]])
    assert got.argmax() == len(x) - 1
    few = iforest.train(df.limit(3), ["a", "b"], trees=5)
    assert few.column.shape[0] == 5
    same = iforest.train(spark.createDataFrame([(1.0, 2.0)] * 5000, "a double, b double"), ["a", "b"], trees=5, sample_size=32)
    assert (same.column == -1).all()


def test_robust_centre_is_the_best_of_all_subsets(spark):
    from itertools import combinations

    from ternspark.operators import mahalanobis

    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(12, 2))
        x[:3] += 6
        got = mahalanobis.robust_centre(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"])
        best = min(combinations(range(12), 9), key=lambda k: np.linalg.det(np.cov(x[list(k)].T)))
        assert got.mean == pytest.approx(x[list(best)].mean(axis=0), abs=1e-9)


def test_robust_centre_of_many_rows(spark):
    from ternspark.operators import mahalanobis

    n = 1_000_000
    df = spark.range(n).select(*[(F.randn(k) + F.when(F.col("id") % 10 < 3, 7.0 if k < 2 else 0.0).otherwise(0.0)).alias(c) for k, c in enumerate("abc")])
    centre = mahalanobis.robust_centre(df, ["a", "b", "c"], support=0.6)
    assert np.abs(centre.mean).max() < 0.05
    flagged = df.withColumn("bad", (F.col("a") + F.col("b")) / 2 > 3.5).withColumn("d", mahalanobis.distance(centre))
    rates = flagged.groupBy("bad").agg(F.avg((F.col("d") > 9.35).cast("int")).alias("r")).collect()  # the 97.5 % quantile
    assert {r["bad"]: r["r"] > 0.9 for r in rates} == {True: True, False: False}


def test_normality_by_group(spark):
    from ternspark.functions import tails
    from ternspark.operators import quality

    rng = np.random.default_rng(3)
    parts = {"normal": rng.normal(5, 2, 800), "skewed": rng.lognormal(size=800), "few": np.array([1.0, 2.0]), "flat": np.full(50, 3.0), "many": rng.normal(size=5001), None: rng.normal(size=60)}
    frame = pd.concat([pd.DataFrame({"g": [k] * len(v), "x": v, "y": -v}) for k, v in parts.items()])
    frame["g"] = frame["g"].astype(object).where(frame["g"].notna(), None)
    df = spark.createDataFrame(frame.values.tolist(), "g string, x double, y double").union(spark.createDataFrame([("normal", None, float("nan"))], "g string, x double, y double"))
    got = {(r["g"], r["column"]): r for r in quality.normality_by_group(df, ["g"]).collect()}
    assert len(got) == 12
    assert {k: got[k, "x"]["status"] for k in parts} == {"normal": "ok", "skewed": "ok", "few": "too few values", "flat": "constant", "many": "too many values", None: "ok"}
    assert got["normal", "x"]["normal"] and not got["skewed", "x"]["normal"] and got["many", "x"]["normal"] is None
    for k in ("normal", "skewed", None):
        assert (got[k, "x"]["statistic"], got[k, "x"]["p_value"]) == pytest.approx(tails.shapiro_wilk(parts[k]))
    whole = quality.normality(df.where("g = 'skewed'"), ["x"]).first()
    assert (got["skewed", "x"]["jarque_bera"], got["skewed", "x"]["jb_p"]) == pytest.approx((whole["jarque_bera"], whole["jb_p"]))


def test_forest_of_every_file_is_that_of_the_file_alone(spark):
    from ternspark.operators import iforest

    names = ["x", "y", "z"]
    rows = [(f, float(i * 37 % 101 + (500 if i == 7 else 0)), float(i * i % 53), 3.0 if f == "b" else float(i % 7), i) for f, n in (("a", 900), ("b", 300), (None, 60)) for i in range(n)]
    rows += [("flat", 1.0, 2.0, 3.0, i) for i in range(30)] + [("a", None, 1.0, 1.0, 5000)]
    df = spark.createDataFrame(rows, "f string, x double, y double, z double, i int")
    got = {(r.f, r.i): (r.if_score, r.is_outlier) for r in iforest.isolation_forest_by(df, names, "f", trees=20, sample_size=64).collect()}
    assert len(got) == len(rows)
    for f in ("a", "b", None):
        own = df.where(F.col("f").eqNullSafe(F.lit(f)))
        for r in iforest.isolation_forest(own, own, names, trees=20, sample_size=64).collect():
            score, flag = got[(f, r.i)]
            assert flag == r.is_outlier and (score == r.if_score or abs(score - r.if_score) < 1e-12)
    assert {got[("flat", i)] for i in range(30)} | {got[("a", 5000)]} == {(None, False)}
    assert iforest.isolation_forest_by(df.limit(0), names, "f", trees=5).isEmpty()


def test_points_of_a_file_are_scored_in_blocks(spark, monkeypatch):
    from ternspark.operators import iforest

    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') as f", "double(id % 211) as x", "double(id % 17) as y")
    forests = iforest.train_by(df, ["x", "y"], "f", trees=10, sample_size=32)
    whole = sorted(map(tuple, iforest.score_by(df, forests, ["x", "y"], "f").collect()))
    monkeypatch.setattr(iforest, "BLOCK_ROWS", 100)
    assert sorted(map(tuple, iforest.score_by(df, forests, ["x", "y"], "f").collect())) == whole and len(whole) == 3000


def test_points_of_files_are_scored_once(spark, tmp_path):
    from ternspark.operators import iforest

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'a', null) as f", "double(id % 211) as x", "double(id % 17) as y")
    marked = iforest.isolation_forest_by(df, ["x", "y"], "f", trees=10, sample_size=32)
    assert "CoGroups" not in marked._jdf.queryExecution().executedPlan().toString()  # kept, not made anew by every pass
    flags = {(r.f, r.is_outlier): r["count"] for r in marked.groupBy("f", "is_outlier").count().collect()}
    assert sum(flags.values()) == 2000 and 60 <= flags["a", True] <= 110 and 130 <= flags[None, True] <= 220


def test_every_file_of_a_batch_has_its_own_forest_bins_and_colours(spark):
    from ternspark.operators import ternary
    from ternspark.operators.filters import Element
    from ternspark.plans import jobs

    df = spark.range(900).selectExpr("if(id % 3 = 0, 'one', 'two') as f", "1 + double(id * 7 % 89) as p", "1 + double(id % 23) + if(id % 3 = 0, 1000, 0) as q", "2D as r", "string(id % 5) as kind")
    s = jobs.Settings(Element(["p"]), Element(["q"]), Element(["r"]), colour_by="q", methods=["isolation_forest"], method_columns=["p", "q"], options={"trees": 10, "sample_size": 32})
    points, status = jobs.batch_ternary(df, s, "f")
    told = {r.file: r for r in status.collect()}
    for f in ("one", "two"):
        alone = jobs.ternary_points(df.where(F.col("f") == f), s)
        own = points.where(F.col("f") == f)
        assert sorted(map(tuple, own.select(*df.columns, "A", "colour").collect())) == sorted(map(tuple, alone.select(*df.columns, "A", "colour").collect()))
        assert told[f].status == "ok" and 0 < told[f].points < told[f].rows
        assert own.select("colour").distinct().count() == 5
        index = ternary.colour_rows(df.where("f <> 'two' or kind <> '4'"), "kind", by="f").where(F.col("f") == f)
        assert sorted(r[0] for r in index.select("colour_index").distinct().collect()) == list(range(1, 6 if f == "one" else 5))
