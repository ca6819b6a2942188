import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabsight.config import Config
from tabsight.operators.cleaning import clean
from tabsight.operators.fills import fill_columns
from tabsight.operators.profile import column_types, profile


def rows_of(result, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in result.rows.orderBy("_row").collect()]


def test_missing_fill(numbered):
    df = numbered("crop tons", [("Rye", "4"), ("rye", "8.5"), (None, None), ("Oats", "1")])
    types = {"crop": "categorical", "tons": "numeric"}
    result = clean(df, types, Config(missing_value_overrides={"crop": "mode", "tons": "mean"}))
    assert rows_of(result, "crop", "tons")[2] == ("rye", 4.5)
    assert tuple(result.report.first()) == (4, 4, 0, 2, 3, 2)
    log = {(r["row_number"], r["column"]): r for r in result.change_log.collect()}
    assert log[4, "crop"]["operation"] == "fill_missing" and log[4, "tons"]["after"] == "4.5"
    assert (3, "crop") not in log and log[2, "crop"]["before"] == "Rye"


@pytest.mark.parametrize("bucket_rows", [2, 1000])
def test_forward_and_back_fill(numbered, bucket_rows):
    df = numbered("v", [("5",), ("NA",), ("x",), ("NA",), ("7",)])
    types = {"v": "numeric"}
    forward = clean(df, types, Config(missing_value_overrides={"v": "forward_fill"}), bucket_rows=bucket_rows)
    assert rows_of(forward, "v") == [5.0, 5.0, None, None, 7.0]
    back = clean(df, types, Config(missing_value_overrides={"v": "back_fill"}), bucket_rows=bucket_rows)
    assert rows_of(back, "v") == [5.0, 7.0, None, 7.0, 7.0]
    assert forward.report.first()["filled_cells"] == 2


def test_fills_match_a_row_at_a_time_model(numbered):
    cells = [None if (i * 7) % 5 < 3 or 40 < i < 90 else str(i) for i in range(150)]
    df = numbered("v", [(c,) for c in cells], 5)
    config = lambda s: Config(missing_value_overrides={"v": s})
    last, forward = None, []
    for c in cells:
        last = float(c) if c else last
        forward.append(last)
    following, back = None, []
    for c in reversed(cells):
        following = float(c) if c else following
        back.append(following)
    types = {"v": "numeric"}
    assert rows_of(clean(df, types, config("forward_fill"), bucket_rows=7), "v") == forward
    assert rows_of(clean(df, types, config("back_fill"), bucket_rows=7), "v") == back[::-1]


def test_drop_row_counts_only_cells_at_its_left(numbered):
    df = numbered("a b c", [("1", "x", "1"), (None, None, None), ("2", "y", None), (None, "z", "3"), ("5", None, "7")])
    types = {"a": "numeric", "b": "text", "c": "numeric"}
    overrides = {"a": "constant", "b": "drop_row", "c": "constant"}
    result = clean(df, types, Config(missing_value_overrides=overrides))
    report = result.report.first()
    assert (report["rows_in"], report["rows_out"], report["dropped_rows"]) == (5, 3, 2)
    assert report["filled_cells"] == 3  # a in rows 3 and 5, c in row 4
    assert report["standardized_numeric_cells"] == 5
    log = [(r["row_number"], r["column"], r["operation"]) for r in result.change_log.collect()]
    assert (3, "b", "drop_row") in log and (3, "c", "fill_missing") not in log and (6, "a", "standardize_numeric") in log


def test_two_drop_columns_and_forward_fill(numbered):
    rows = [("1", "p", "q"), ("2", None, "q"), (None, "p", None), (None, "p", "q")]
    overrides = {"a": "forward_fill", "b": "drop_row", "c": "drop_row"}
    result = clean(numbered("a b c", rows), {"a": "numeric", "b": "text", "c": "text"}, Config(missing_value_overrides=overrides))
    assert rows_of(result, "a") == [1.0, 2.0]  # the dropped row still feeds the fill
    drops = sorted((r["row_number"], r["column"]) for r in result.change_log.filter("operation = 'drop_row'").collect())
    assert drops == [(3, "b"), (4, "c")]


@pytest.mark.parametrize(
    "strategy, fill_values, value, filled",
    [("mode", {}, "", 3), ("leave_as_null", {}, None, 0), ("leave_as_null", {"v": "k"}, "k", 3), ("constant", {"v": "k"}, "k", 3)],
)
def test_empty_column(numbered, strategy, fill_values, value, filled):
    df = numbered("v", [("NA",), (None,), ("",)])
    result = clean(df, {"v": "text"}, Config(missing_value_overrides={"v": strategy}, fill_values=fill_values))
    assert rows_of(result, "v") == [value] * 3
    assert result.report.first()["filled_cells"] == filled


def test_date_median_is_the_upper_middle_and_mode_ties_go_to_the_first(numbered):
    df = numbered("d c", [("2026-01-04", "b"), ("2026-01-01", "A"), ("2026-01-03", "a"), ("2026-01-02", "B"), (None, None)])
    types = {"d": "date", "c": "categorical"}
    result = clean(df, types, Config(missing_value_overrides={"d": "median"}))
    assert rows_of(result, "d", "c")[4] == (datetime(2026, 1, 3), "b")


def test_boolean_strategies_and_unknown_names(numbered):
    df = numbered("f", [("yes",), ("no",), (None,), ("y",)])
    assert rows_of(clean(df, {"f": "boolean"}), "f") == [True, False, True, True]
    with pytest.raises(ValueError):
        clean(df, {"f": "boolean"}, Config(missing_value_overrides={"f": "mean"}))
    with pytest.raises(ValueError):
        Config(missing_value_overrides={"f": "guess"})


def test_typed_values_that_do_not_change_are_not_logged(spark):
    df = spark.createDataFrame([(2, 1, 1.5), (3, 0, None), (4, 1, 2.5), (5, 1, 4.0)], "_row long, flag int, x double")
    types = column_types(profile(df))
    assert types == {"flag": "boolean", "x": "numeric"}
    log = clean(df, types).change_log.collect()
    assert [(r["row_number"], r["operation"], r["after"]) for r in log] == [(3, "fill_missing", "2.5")]


@pytest.mark.parametrize("bucket_rows", [10, 64, 10_000])
def test_fills_within_keys(spark, bucket_rows):
    """One key with nine tenths of the rows, a null key, and keys of a few rows; small buckets cut the large key."""
    rng = random.Random(7)
    rows = [(i + 2, rng.choice(["hot"] * 18 + [None, f"k{i % 9}"]), rng.choice([None, None, None, i])) for i in range(600)]
    df = spark.createDataFrame(rows, "_row long, key string, v int").repartition(5)
    source = F.col("v")
    got = fill_columns(df, {"up": source}, {"down": source}, bucket_rows, ["key"])
    seen, want = {}, {}
    for row, key, v in rows:
        want[row] = [seen.get(key), None]
        seen[key] = v if v is not None else seen.get(key)
    seen = {}
    for row, key, v in reversed(rows):
        seen[key] = v if v is not None else seen.get(key)
        want[row][1] = seen[key]
    assert {r["_row"]: [r["up"], r["down"]] for r in got.collect()} == want
    assert got.columns == ["_row", "key", "v", "up", "down"]


@pytest.mark.parametrize("strategies", [{"amount": "mean", "region": "mode"}, {"amount": "forward_fill", "region": "drop_row"}])
def test_one_scan_gives_rows_log_and_counters(numbered, tmp_path, strategies):
    rows = [(str(i) if i % 4 else "n/a", ["North ", "SOUTH", None][i % 3], f"x{i}") for i in range(200)]
    df = numbered("amount region kept", rows, partitions=5)
    lazy = clean(df, {"amount": "numeric", "region": "categorical"}, Config(missing_value_overrides=strategies))
    once = lazy.written(str(tmp_path / "cleaned"))
    for name in ("rows", "change_log", "report"):
        a, b = getattr(lazy, name), getattr(once, name)
        assert a.columns == b.columns
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    plan = once.report._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "LocalTableScan" in plan


def test_one_scan_of_no_rows(numbered, tmp_path):
    once = clean(numbered("amount", []), {"amount": "numeric"}, Config()).written(str(tmp_path / "none"))
    assert once.rows.count() == 0 and once.report.first()["rows_in"] == 0
