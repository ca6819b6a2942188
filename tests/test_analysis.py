from datetime import datetime, timedelta

import numpy as np
import pytest

from tabsight.config import Config
from tabsight.operators import charts, model, stats, trend
from tabsight.operators.insights import insights
from tabsight.operators.outliers import outliers
from tabsight.operators.profile import column_types, profile
from tabsight.operators.quality import quality, with_dataset


def test_summary_takes_the_floor_index(numbered):
    df = numbered("v:double", [(float(2**i),) for i in range(6)])
    row = stats.summary(df, {"v": "numeric"}).first()
    assert (row["q1"], row["median"], row["q3"], row["count"]) == (2.0, 6.0, 8.0, 6)


def test_constant_columns(spark):
    df = spark.range(100_000).selectExpr("id + 2 AS _row", "0.1D AS c", "cast(id AS double) AS x").repartition(8)
    types = {"c": "numeric", "x": "numeric"}
    assert stats.correlations(df, types).count() == 0
    row = stats.summary(df, types, ["c"]).first()
    assert (row["mean"], row["stddev"]) == (0.1, 0.0)


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(5)
    x, y, z = rng.normal(1e6, 1, 400), rng.normal(0, 1, 400), rng.normal(5, 2, 400)
    rows = [(i + 2, float(x[i]), float(x[i] + y[i]) if i % 3 else None, float(z[i]) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "_row long, x double, y double, z double").repartition(4)
    found = {(r["column_a"], r["column_b"]): r for r in stats.correlations(df, dict.fromkeys("xyz", "numeric")).collect()}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        i, j = "_xyz".index(a), "_xyz".index(b)
        pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        assert found[a, b]["pair_count"] == len(pairs)
        assert found[a, b]["correlation"] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-9)


def test_wide_correlations_cover_every_pair(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 20))
    names = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame([(i + 2, *map(float, r)) for i, r in enumerate(data)], ["_row", *names])
    found = stats.correlations(df, dict.fromkeys(names, "numeric")).collect()
    assert len(found) == 190
    assert all(abs(a["correlation"]) >= abs(b["correlation"]) for a, b in zip(found, found[1:]))
    expected = np.corrcoef(data.T)
    assert all(r["correlation"] == pytest.approx(expected[int(r["column_a"][1:]), int(r["column_b"][1:])]) for r in found)


def test_segments(numbered):
    rows = [("a", "1", True), ("b", "2", True), ("a", "3", False), (None, "100", True), ("a", "8", True), ("b", None, True)]
    df = numbered("k x b:boolean", rows)
    types = {"k": "categorical", "x": "numeric", "b": "boolean"}
    found = stats.segments(df, types, small_group=1).collect()
    assert [(r["dimension"], r["value"], r["row_count"]) for r in found] == [
        ("k", "a", 3), ("k", "b", 2), ("b", "True", 5), ("b", "False", 1),
    ]
    assert found[0]["numeric_aggregates"] == {"mean_x": 4.0, "median_x": 3.0} and found[0]["share"] == 0.5
    assert stats.segments(numbered("k", [("a",), ("a",)]), {"k": "categorical"}).count() == 0


def test_trend_line_with_a_spike(spark):
    start = datetime(2026, 1, 1, 15, 30)
    rows = [(i + 2, start + timedelta(days=i), 2.0 * i + (500 if i == 30 else (i % 3) * 0.1)) for i in range(60)]
    df = spark.createDataFrame(rows, "_row long, d timestamp, v double").repartition(3)
    types = {"d": "date", "v": "numeric"}
    fits = trend.fit_trends(df, types)
    anomalies = trend.trend_anomalies(df, types, fits).collect()
    assert [a["row_number"] for a in anomalies] == [32]
    assert anomalies[0]["actual"] - anomalies[0]["predicted"] > 400
    row = trend.trends(df, types, fits=fits).first()
    assert (row["direction"], row["anomaly_count"]) == ("increasing", 1)
    x = np.array([(r[1].date().toordinal()) for r in rows], float)
    slope, intercept = np.polyfit(x - x.mean(), [r[2] for r in rows], 1)
    assert row["slope"] == pytest.approx(slope)
    assert fits[0].intercept == pytest.approx(intercept - slope * x.mean())
    assert trend.anomaly_findings(trend.trend_anomalies(df, types, fits)).first()["code"] == "trend_anomaly"


def test_trend_edges(spark):
    day = datetime(2026, 1, 1)
    same_day = spark.createDataFrame([(i + 2, day, float(i)) for i in range(5)], "_row long, d timestamp, v double")
    types = {"d": "date", "v": "numeric"}
    assert trend.trends(same_day, types).count() == 0
    flat = spark.createDataFrame([(i + 2, day + timedelta(days=i), 0.1) for i in range(5)], "_row long, d timestamp, v double")
    row = trend.trends(flat, types).first()
    assert (row["slope"], row["direction"], row["r_squared"]) == (0.0, "flat", 1.0)
    assert trend.trends(flat.limit(2), types).count() == 0


def test_regression(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=50), rng.normal(size=50)
    rows = [(i + 2, float(3 + 2 * a[i] - b[i]), float(a[i]), float(b[i])) for i in range(50)] + [(99, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "_row long, y double, x1 double, x2 double")
    types = {"y": "numeric", "x1": "numeric", "x2": "numeric"}
    row = model.model(df, types).first()
    assert row["intercept"] == pytest.approx(3, abs=1e-5)
    assert row["coefficients"]["x1"] == pytest.approx(2, abs=1e-5)
    assert row["metrics"]["observations"] == 50 and row["metrics"]["r_squared"] == pytest.approx(1)
    fit = model.fit_regression(df, "y", ["x1", "x2"])
    last = model.predict(df, fit).filter("_row = 99").first()
    assert last["prediction"] == pytest.approx(4, abs=1e-4)
    assert model.model(df.limit(3), types).count() == 0
    assert model.model(df, types, Config(model_enabled=False)).count() == 0
    assert model.choose_model_columns(types, Config(target_column="x2", feature_columns=["x1", "x2"])) == ("x2", ["x1"])
    with pytest.raises(ValueError, match="'z'"):
        model.choose_model_columns(types, Config(feature_columns=["x1", "z"]))


def test_named_features_are_all_used(spark):
    names = [f"x{i}" for i in range(6)]
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 6))
    df = spark.createDataFrame([(i + 2, float(1 + r @ np.arange(1, 7)), *map(float, r)) for i, r in enumerate(x)], "_row long, y double, " + ", ".join(f"{n} double" for n in names))
    types = dict.fromkeys(["y", *names], "numeric")
    row = model.model(df, types, Config(target_column="y", feature_columns=names)).first()
    assert [row["coefficients"][n] for n in names] == pytest.approx(range(1, 7), abs=1e-4)
    assert model.choose_model_columns(types, Config())[1] == names[:4]


def test_collinear_columns_survive_by_the_ridge(spark):
    df = spark.range(30).selectExpr("id + 2 AS _row", "id * 2.0D AS y", "id * 1.0D AS x1", "id * 1.0D AS x2")
    fit = model.fit_regression(df, "y", ["x1", "x2"])
    assert fit.weights[0] + fit.weights[1] == pytest.approx(2, abs=1e-3)


@pytest.mark.parametrize(
    "values, counts",
    [([4.0], [1]), ([2.0, 2.0], [2]), ([0.0, 1.0, 2.0, 9.0], [3, 0, 1]), ([], [])],
)
def test_histogram(numbered, values, counts):
    df = numbered("v:double", [(v,) for v in values])
    assert [r["count"] for r in charts.histogram(df, "v").orderBy("bin").collect()] == counts


def test_chart_series_and_plan(numbered):
    rows = [("2026-01-02", "1", "b"), ("2026-01-01", "2", "a"), ("bad", "3", "a"), ("2026-01-01", "40", None)]
    df = numbered("d v c", rows)
    assert [tuple(r) for r in charts.trend_series(df, "d", "v").collect()] == [
        ("2026-01-01", 2.0), ("2026-01-01", 40.0), ("2026-01-02", 1.0),
    ]
    assert [tuple(r) for r in charts.trend_series(df, "d", "v", bucket="day").collect()] == [("2026-01-01", 21.0), ("2026-01-02", 1.0)]
    assert [tuple(r) for r in charts.value_counts(df, "c").collect()] == [("a", 2, 1), ("b", 1, 2)]
    assert charts.scatter_points(df, "v", "v").count() == 4
    types = {"d": "date", "v": "numeric", "c": "categorical"}
    plan = charts.chart_plan(df, types, stats.summary(df, types), trend.trends(df, types), stats.correlations(df, types))
    assert [r["kind"] for r in plan.collect()] == ["histogram", "bar", "line"]
    assert [r["kind"] for r in charts.chart_plan(df, types, stats.summary(df, types), trend.trends(df, types), stats.correlations(df, types), 1).collect()] == ["histogram"]


def report_tables(df, name):
    found = profile(df)
    types = column_types(found)
    return [
        with_dataset(t, name)
        for t in (
            quality(df), found, outliers(df, types), stats.correlations(df, types), trend.trends(df, types), model.model(df, types),
        )
    ]


def test_insights_for_several_datasets_at_once(numbered):
    rows = [(str(i), str(2 * i + (i % 2)), None if i % 4 else "k") for i in range(20)]
    first = report_tables(numbered("a b gap", rows), "first")
    second = report_tables(numbered("v", [("1",), ("1",), ("900",)]), "second")
    empty = report_tables(numbered("v", []), "empty")
    both = [a.unionByName(b).unionByName(c) for a, b, c in zip(first, second, empty)]
    found = {r["dataset"]: r for r in insights(*both).collect()}
    one, two, none = found["first"], found["second"], found["empty"]
    assert one["key_drivers"][0] == "a and b move together with correlation 1.00 across 20 paired observations."
    assert one["key_drivers"][1].startswith("Basic regression on a explains 1.00")
    assert one["risks"] == ["Missing values are concentrated in gap; imputation or source cleanup is likely needed."]
    assert one["executive_summary"].startswith("Processed 20 row(s) across 3 column(s). The quality report found 15 missing cell(s)")
    assert two["key_drivers"] == ["No strong correlations or trends crossed the reporting threshold, so the data appears relatively flat."]
    assert two["risks"][0] == "The dataset contains 1 duplicate record(s)." and len(two["risks"]) == 3
    assert len(two["recommended_actions"]) == 5
    assert none["key_drivers"] == [] and len(none["risks"]) == 1


def test_correlations_of_many_columns_equal_the_pairs(spark, monkeypatch):
    """90 columns with gaps, constants and a column that is constant where another one is there."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 90)) * 10.0 ** rng.integers(-3, 6, 90) + 10.0 ** rng.integers(0, 6, 90)
    x[:, 3] = x[:, 4] * -2
    x[:, 7] = 5.0
    x[:80, 8], x[80:, 9] = 1e6, np.nan
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"n {k}" for k in range(90)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(7)
    types = dict.fromkeys(names, "numeric")
    monkeypatch.setattr(stats, "_MATRIX", 32)
    monkeypatch.setattr(stats, "_MET_BLOCKS", 3)
    wide = {(r["column_a"], r["column_b"]): (r["correlation"], r["pair_count"]) for r in stats.correlations(df, types).collect()}
    monkeypatch.setattr(stats, "_BLOCK", 100)
    some = names[:12]
    pairs = {(r["column_a"], r["column_b"]): (r["correlation"], r["pair_count"]) for r in stats.correlations(df, types, some).collect()}
    assert {k: v[1] for k, v in wide.items() if k[0] in some and k[1] in some} == {k: v[1] for k, v in pairs.items()}
    assert all(wide[k][0] == pytest.approx(v[0], abs=1e-9) for k, v in pairs.items())
    assert ("n 8", "n 9") not in wide and wide["n 3", "n 4"][0] == pytest.approx(-1)
    both = ~np.isnan(x[:, 40]) & ~np.isnan(x[:, 77])
    assert wide["n 40", "n 77"] == (pytest.approx(np.corrcoef(x[both, 40], x[both, 77])[0, 1], abs=1e-9), both.sum())
