import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternspark.functions.cols import c
from ternspark.operators import charts, combine, filters, iforest, mahalanobis, outliers, quality, sampling, stats, ternary
from ternspark.operators.filters import Element
from ternspark.plans import jobs
from ternspark.sources import files

X = [1, 2, 3, 100, 5, 6, 7, 8, 9, 10]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(float(x), float(11 + i)) for i, x in enumerate(X)], "x double, y double")


def test_filters(frame):
    for text, n in ((">5", 6), ("< 5", 3), (">= 5", 7), ("<=5", 4), ("== 5", 1), ("!= 5", 9)):
        assert filters.apply_filter(frame, "x", text).count() == n
    assert filters.apply_filter(frame, "x", None).count() == 10
    for bad in ("> abc", "~ 5", "5"):
        with pytest.raises(ValueError):
            filters.apply_filter(frame, "x", bad)
    assert filters.filter_optional(frame, ["x"], "many").count() == 10
    assert filters.parse_filter("> 10%", lenient=True) == (">", 10.0)


def test_element_filters(frame):
    assert filters.filter_elements(frame, [Element(["x", "y"], "> 12")]).count() == 1
    assert filters.filter_elements(frame, [Element(["x", "y"], "> 1000", {"x": "> 7", "z": "> 9"})]).count() == 4


def test_filter_on_text_and_missing(spark):
    df = spark.createDataFrame([("12",), ("abc",), (None,), ("1d",)], "`a.(%)` string")
    assert [r[0] for r in filters.apply_filter(df, "a.(%)", "> 1").collect()] == ["12"]


def test_groups(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    assert filters.keep_groups(df, "g", ["a (12 samples)"]).count() == 1
    assert filters.keep_groups(df, "g", ["nothing"]).count() == 3


def test_funnel_and_complete_cases(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (float("nan"), 2.0)], "a double, b double")
    assert [(r.rows, r.percent) for r in filters.funnel(df, [("a", F.col("a") < 5)]).orderBy("step").collect()] == [(3, 100.0), (2, 66.67)]
    assert filters.complete_cases(df, ["a", "b"]).first()["complete"] == 1


def test_outlier_rules(frame):
    assert [r.x for r in outliers.apply_iqr_filter(frame, ["x"], keep_outliers=True).collect()] == [100.0]
    assert [r.x for r in outliers.apply_mad_filter(frame, ["x"], keep_outliers=True).collect()] == [100.0]
    assert outliers.apply_zscore_filter(frame, ["x"]).count() == 10  # 2.83 standard deviations
    assert outliers.apply_zscore_filter(frame, ["x"], 2.5).count() == 9
    for method in ("iqr", "zscore", "mad"):
        with pytest.raises(ValueError):
            outliers.outlier_filter(frame, ["x"], method, -1)


def test_outliers_of_constant_missing_and_text(spark):
    df = spark.createDataFrame([(1.0, "a", None)] * 5, "k double, t string, n double")
    for method in ("iqr", "zscore", "mad"):
        assert outliers.outlier_flag(df, ["k", "t", "n"], method).where("is_outlier").count() == 0
    assert outliers.apply_iqr_filter(df.limit(0), ["k"]).count() == 0


def test_two_sided_and_by_group(spark):
    rows = [("a", float(x)) for x in [-100, *X]] + [("b", 1000.0 + x) for x in X] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert sorted(r.x for r in outliers.outlier_filter(df.where("g = 'a'"), ["x"], "iqr", keep_outliers=True, side="both").collect()) == [-100.0, 100.0]
    for method in ("iqr", "mad"):
        assert sorted(r.x for r in outliers.outlier_filter(df, ["x"], method, keep_outliers=True, by=["g"]).collect()) == [100.0, 1100.0]


def test_one_method_wins():
    with pytest.warns(UserWarning):
        assert outliers.pick_method(["mad", "iqr"]) == "iqr"
    assert outliers.pick_method([]) is None
    with pytest.raises(ValueError):
        outliers.pick_method(["magic"])


def test_ternary(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (0.0, 0.0, 0.0), (None, None, None), (3.0, None, 1.0)], "a double, b double, c double")
    rows = ternary.coordinates(df, ["a"], ["b"], ["c"]).orderBy("A", "B").collect()
    assert all(r.A + r.B + r.C == pytest.approx(1) for r in ternary.coordinates(df.toDF("p", "q", "r"), ["p"], ["q"], ["r"]).collect())
    assert len(rows) == 2
    assert ternary.percentages(df.toDF("p", "q", "r"), ["p"], ["q"], ["r"]).where("A_pct is null").count() == 2


def test_quintiles(frame):
    got = ternary.quintile_types(frame, "x").orderBy("y").collect()
    assert [r.bin for r in got] == [1, 1, 2, 5, 2, 3, 3, 4, 4, 5]
    assert {r.bin: r.point_type for r in got} == {1: 16, 2: 17, 3: 15, 4: 18, 5: 19}
    flat = frame.withColumn("k", F.lit(1.0))
    assert ternary.quintile_types(flat, "k").select("bin", "point_type").distinct().collect() == [(1, 16)]


def test_hexagon(spark):
    df = spark.createDataFrame([(1.0,) * 7, (1.0, 1.0, None, 1.0, 1.0, 1.0, 1.0)], ", ".join(f"e{k} double" for k in range(1, 8)))
    h = jobs.hex_ternary(df, [f"e{k}" for k in range(1, 8)])
    assert {r.panel: r["count"] for r in h.groupBy("panel").count().collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2 if 3 not in ternary.PANELS[5] else 1}
    assert all(math.hypot(r.x, r.y) == pytest.approx(1.5 / math.sqrt(3)) for r in h.collect())
    with pytest.raises(ValueError):
        ternary.hexagon(df, ["e1"])


def test_groups_and_legends(spark):
    df = spark.createDataFrame([(f"g{k % 12:02d}", float(k)) for k in range(30)] + [(None, 0.0)], "g string, v double")
    s = ternary.group_summary(df, "g").orderBy("rank").collect()
    assert len(s) == 11 and s[-1]["group"] == "(other)" and sum(r.samples for r in s) == 31
    assert [r.value for r in ternary.size_legend(df, "v").orderBy("entry").collect()] == [29.0, 21.75, 14.5, 7.25, 0.0]
    assert ternary.point_sizes(df, ["v"]).agg(F.max("point_size")).first()[0] == pytest.approx(2.5)
    assert ternary.aspect_bins(df.withColumnRenamed("v", "Aspect.Ratio")).where("aspect_bin is null").count() == 2


def test_mahalanobis(frame):
    rows, s = mahalanobis.mahalanobis(frame, ["x", "y"])
    got = [r.md2 for r in rows.orderBy("y").collect()]
    assert got == pytest.approx([2.55, 1.6125, 0.9, 8.1, 0.15, 0.1125, 0.3, 0.7125, 1.35, 2.2125])
    assert (s["mean"], s["sd"], s["threshold"]) == pytest.approx((1.8, 2.368148, 4.156395), abs=1e-5)
    assert (s["over_95"], s["over_99"]) == (1, 0)
    assert [r.x for r in mahalanobis.mahalanobis_filter(frame, ["x", "y"], keep_outliers=True).collect()] == [100.0]


def test_mahalanobis_singular_and_missing(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(10)] + [(None, 1.0)], "a double, b double")
    rows, _ = mahalanobis.mahalanobis(df, ["a", "b"])
    assert rows.where("md2 is null").count() == 1
    assert mahalanobis.mahalanobis_filter(df, ["a", "b"]).where("a is null").count() == 0
    assert mahalanobis.mahalanobis_flag(df, ["a", "b"]).count() == 11
    for kw in ({"lam": -1}, {"threshold": -2.0}):
        with pytest.raises(ValueError):
            mahalanobis.mahalanobis(df, ["a", "b"], **kw)
    with pytest.raises(ValueError):
        mahalanobis.check_inputs(["a"])


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 4))
    return spark.createDataFrame([(*map(float, r), 0) for r in x] + [(*map(float, r + 8), 1) for r in x[:10]], "a double, b double, c double, d double, bad int")


def test_isolation_forest(planted):
    names = ["a", "b", "c", "d"]
    got = iforest.isolation_forest(planted, planted, names, contamination=0.05)
    assert got.where("bad = 1 and is_outlier").count() == 10
    assert got.where("is_outlier").count() == pytest.approx(51, abs=3)
    again = iforest.isolation_forest(planted.repartition(7), planted.repartition(3), names, contamination=0.05)
    key = lambda d: sorted((r.a, r.is_outlier) for r in d.collect())
    assert key(got) == key(again)


def test_robust_distance(planted):
    got = mahalanobis.robust_flag(planted, ["a", "b", "c", "d"])
    assert got.where("bad = 1 and is_outlier").count() == 10
    assert got.where("bad = 0 and is_outlier").count() < 60


def test_combined_methods(planted):
    rows, flags = combine.multivariate_analysis(planted, ["a", "b", "c", "d"], ["mahalanobis", "iqr"])
    assert rows.where("is_outlier and bad = 1").count() == 10
    table = {(r.method1, r.method2): r.agreement for r in combine.agreement(rows, flags).collect()}
    assert table["iqr", "iqr"] == 100 and table["iqr", "mahalanobis"] == table["mahalanobis", "iqr"]
    with pytest.raises(ValueError):
        combine.multivariate_analysis(planted, ["a", "b"], ["iqr"])


def test_correlations(spark, frame):
    table = {(r.var1, r.var2): r.r for r in stats.correlations(frame).collect()}
    assert table["x", "y"] == pytest.approx(-0.075284, abs=1e-6) and table["x", "x"] == pytest.approx(1)
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, None, 5.0), (3.0, 2.0, 5.0), (4.0, 9.0, 5.0)], "a double, b double, k double")
    t = {(r.var1, r.var2): (r.r, r.n) for r in stats.correlations(df, pairwise=True).collect()}
    assert t["a", "a"][1] == 4 and t["a", "b"][1] == 3 and t["a", "k"][0] is None
    ranks = {(r.var1, r.var2): r.r for r in stats.correlations(df, ["a", "b"], method="spearman").collect()}
    assert ranks["a", "b"] == pytest.approx(1)
    assert stats.kendall(df, "a", "b").first()["r"] == pytest.approx(1)


def test_paired_by_position(spark):
    a = spark.createDataFrame([(k, float(k)) for k in range(5)], "k int, v double")
    b = spark.createDataFrame([(k, 2.0 * k) for k in range(5)], "k int, v double")
    assert stats.paired_by_position(a, b, ["v"], ["k"]).first()["r"] == pytest.approx(1)
    assert stats.paired_correlation(a.limit(1), b, ["v"], ["k"]).first()["r"] is None


def test_quality(spark, frame):
    assert quality.quality_score(frame).first() == (99.0, "A")
    d = {r["column"]: r for r in quality.distribution(frame).collect()}
    assert (d["x"].skewness, d["x"].kurtosis) == pytest.approx((2.617204, 7.958390), abs=1e-5)
    assert {r["column"]: r.outliers for r in quality.column_quality(frame).collect()} == {"x": 1, "y": 0}
    odd = spark.createDataFrame([(None, 1.0, math.inf), (float("nan"), 1.0, 1.0)], "m double, k double, i double")
    q = {r["column"]: r for r in quality.column_quality(odd).collect()}
    assert q["m"].missing == 2 and q["m"].zero_variance is None and q["k"].zero_variance and q["i"].infinite == 1
    found = {(r.check, r["column"]) for r in quality.issues(odd, ["m", "k", "i", "gone"]).collect()}
    assert {("over half missing", "m"), ("zero variance", "k"), ("infinite values", "i"), ("missing column", "gone")} <= found
    assert not quality.is_valid(frame.limit(0))


def test_duplicates_and_normality(spark, frame):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (3, "c"), (4, "d"), (5, "e")], "a int, b string")
    assert quality.duplicates(df).first() == (8, 3, 37.5)
    assert quality.duplicate_names(["a", "b", "a"]) == ["a"]
    n = {r["column"]: r for r in quality.normality(frame).collect()}
    assert n["x"].p_value < 0.001 and n["y"].normal
    assert quality.normality(frame.limit(2)).first()["status"] == "too few values"


def test_charts(spark, frame):
    h = charts.histogram(frame, "x", 3).orderBy("bin").collect()
    assert [(r.bin, r["count"]) for r in h] == [(0, 9), (2, 1)]
    assert charts.histogram(frame.withColumn("k", F.lit(2.0)), "k").first()["count"] == 10
    b = charts.box_stats(frame, ["x"]).first()
    assert (b.whisker_low, b.whisker_high, b.outliers) == (1.0, 10.0, 1)
    assert [r.x for r in charts.box_outliers(frame, "x").collect()] == [100.0]
    area = charts.density(frame, "y").agg(F.avg("density") * (F.max("x") - F.min("x"))).first()[0]
    assert 0.5 < area <= 1.01
    assert charts.scatter(frame, ["x", "y"]).count() == 10
    assert charts.connected(frame, "x", "y", "y").orderBy("place").first()["next_x"] == 2.0
    with pytest.raises(ValueError):
        charts.build_chart(frame, {"type": "pie"})
    t = stats.linear_trend(spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(9)], "x double, y double"), "x", "y").first()
    assert (t.slope, t.intercept, t.r2) == pytest.approx((2, 1, 1))
    curve = stats.loess(spark.createDataFrame([(float(k), float(k * k)) for k in range(40)], "x double, y double"), "x", "y").collect()
    assert all(r.fit == pytest.approx(r.x**2, abs=1e-6) for r in curve)


def test_samples_and_functions(spark):
    df = spark.range(15_000).select("id", (F.col("id") * 1.0).alias("y"))
    assert sampling.bounded_sample(df, ["id"]).count() == 15_000
    a = {r.id for r in sampling.bounded_sample(df, ["id"], 1000).collect()}
    assert len(a) == 1000 and a == {r.id for r in sampling.bounded_sample(df.repartition(5), ["id"], 1000).collect()}
    assert sampling.map_chunks(df, lambda p: p[["id"]], "id long", 1000).count() == 15_000

    def fails(p):
        raise RuntimeError

    assert {r["__failed"] for r in sampling.map_chunks(df, fails, "id long", skip_failures=True).collect()} == {"RuntimeError"}


def test_files(spark, tmp_path):
    a = spark.createDataFrame([(1, 1.0)], "k int, v double")
    b = spark.createDataFrame([(2,)], "k int")
    files.write_table(a, f"{tmp_path}/one.csv")
    files.write_table(b, f"{tmp_path}/two.parquet", "parquet")
    assert {r.file_source for r in files.read_many(spark, [f"{tmp_path}/one.csv", f"{tmp_path}/two.parquet", f"{tmp_path}/gone.csv"]).collect()} == {"one", "two"}
    assert files.read_many(spark, [f"{tmp_path}/one.csv", f"{tmp_path}/two.parquet"], ["v"]).count() == 1
    assert files.read_common(spark, [f"{tmp_path}/one.csv", f"{tmp_path}/two.parquet"]).columns == ["k", "source_file"]
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        files.union_common([])
    paths = files.export_tables({"a": a, "none": None, "empty": a.limit(0)}, f"{tmp_path}/out", spark)
    assert [spark.read.parquet(p).columns for p in paths] == [["k", "v"], ["message"], ["message"]]
    assert files.bind_datasets(a, a, ["v"]).count() == 2


@pytest.mark.parametrize("label", ["f", "group", "samples"])
def test_colour_rows_where_the_file_is_the_group(spark, label):
    df = spark.createDataFrame([("p", 1), ("q", 2), ("q", 3), (None, 4)], f"`{label}` string, x long")
    got = ternary.colour_rows(df, label, by=label)
    assert got.columns == [label, "x", "colour_index"] and sorted(r.x for r in got.where("colour_index = 1").collect()) == [1, 2, 3, 4]
    other = ternary.colour_rows(df.withColumn("g", c("x") % 2), "g", by=label)
    assert {r.x: r.colour_index for r in other.collect()} == {1: 1, 2: 1, 3: 2, 4: 1}


def test_batch_coloured_by_a_number_that_labels_the_files(spark, frame):
    df = frame.withColumn("z", F.lit(3.0)).withColumn("f", F.when(c("y") > 15, 1.0).otherwise(2.0))
    made, status = jobs.batch_ternary(df, jobs.Settings(Element(["x"]), Element(["y"]), Element(["z"]), colour_by="f"), "f")
    assert {r.file: r.status for r in status.collect()} == {1.0: "ok", 2.0: "ok"} and made.where("colour is null").count() == 0


def test_jobs(spark, frame, tmp_path):
    df = frame.withColumn("z", F.lit(3.0)).withColumn("f", F.when(c("y") > 15, "p").otherwise("q"))
    s = jobs.Settings(Element(["x"]), Element(["y"]), Element(["z"]), size_by=["y"], colour_by="f", methods=["iqr"], method_columns=["x", "y"])
    points = jobs.ternary_points(df, s)
    assert points.count() == 9 and {"A", "B", "C", "point_size", "colour_index"} <= set(points.columns)
    made, status = jobs.batch_ternary(df, s, "f")
    assert {r.file: r.status for r in status.collect()} == {"p": "ok", "q": "ok"}
    out = jobs.comprehensive_analysis(df.select("x", "y"), df.select("x", "y"), f"{tmp_path}/report")
    assert {"quality", "mahalanobis", "isolation_forest", "heatmap1"} <= set(out)
    assert set(jobs.compare_job(df, df, ["y"])) >= {"summaries", "paired"}
    with pytest.raises(ValueError):
        jobs.ternary_points(df, jobs.Settings(Element(["nope"]), Element(["y"]), Element(["z"])))


def test_files_are_told_apart_once(spark, tmp_path, monkeypatch):
    for name, text in (("a b%c+d.csv/p 1.csv", "x,y\n1,2\n 3 ,4\n"), ("a b%c+d.csv/p 2.csv", "x,y\n5,0x1p3\n"), ("ü one.csv", "x,y\n7,8\n9,1d\n"), ("gone.csv", "x\n1\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = [f"{tmp_path}/{n}" for n in ("a b%c+d.csv", "ü one.csv", "gone.csv")]
    rows, status = files.scan_files(spark, paths, ["x", "y"])
    want = {("a b%c+d", 1.0, 2.0), ("a b%c+d", 3.0, 4.0), ("a b%c+d", 5.0, None), ("ü one", 7.0, 8.0), ("ü one", 9.0, None)}
    assert {(r.file_source, r.x, r.y) for r in rows.collect()} == want
    assert {tuple(r) for r in status.collect()} == {("a b%c+d", 3, "ok"), ("ü one", 2, "ok"), ("gone", 0, "failed: no column y")}
    assert not status.inputFiles()  # found, and not found anew by all that reads the rows
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    read = spark.read.csv(paths[:2], header=True).withColumn(files._PATH, F.col("_metadata.file_path"))
    labels = {files._plain(spark, p): files.label_of(p) for p in paths}
    monkeypatch.setattr(files, "_label_column", lambda labels: F.lit(None).cast("string"))  # what rows don't need
    found = read.select(files._label_of_row(labels, read.inputFiles()).alias("l")).groupBy("l").count().collect()
    assert {tuple(r) for r in found} == {("a b%c+d", 3), ("ü one", 2)}
