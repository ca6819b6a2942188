from pyspark.sql import functions as F
import random
import pytest

from tabsight.operators.outliers import outliers
from tabsight.operators.profile import cell_counts, column_types, distinct_estimates, distinct_sketches, merge_sketches, profile
from tabsight.operators.profile_many import profile_datasets
from tabsight.operators.quality import duplicate_rows, findings, missing_cells, quality
from tabsight.operators.order_stats import MEDIAN, floor_index, linear, order_statistics, upper_middle


def records(df):
    return {r["column"]: r for r in df.collect()}


def test_schema_detection(numbered):
    df = numbered(
        "no river seen depth",
        [("7", "Elbe", "2024-05-30", "3.25"), ("8", "Oder", "2024-06-02", "1"), ("9", "Elbe", "2024-06-01", "8.75"), ("11", "elbe ", "2024-05-31", "2")],
    )
    found = profile(df)
    assert column_types(found) == {"no": "numeric", "river": "categorical", "seen": "date", "depth": "numeric"}
    rows = records(found)
    assert rows["depth"]["numeric_median"] == 2.625
    assert rows["seen"]["date_max"] == "2024-06-02T00:00:00"
    assert [tuple(t) for t in rows["river"]["top_values"]] == [("elbe", 3), ("oder", 1)]
    assert rows["river"]["sample_values"] == ["Elbe", "Oder", "Elbe", "elbe "]


def test_type_edges(numbered):
    rows = []
    for i in range(100):
        rows.append(
            (
                "n/a",
                str(i % 2),
                "5" if i < 2 else None,
                str(i) if i < 80 else "word",
                str(i) if i < 79 else "word",
                f"2026/01/{i % 28 + 1:02d}",
                f"k{'x' * (i % 45)}",
                f"unique text number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} " + "z" * 40,
            )
        )
    found = profile(numbered("none flag two num80 num79 slash short long", rows))
    assert column_types(found) == {
        "none": "text", "flag": "boolean", "two": "categorical", "num80": "numeric", "num79": "text",
        "slash": "numeric", "short": "categorical", "long": "text",
    }
    by_name = records(found)
    assert by_name["num80"]["invalid_count"] == 20 and by_name["num80"]["confidence"] == 0.8
    assert by_name["none"]["confidence"] == 0.0 and by_name["none"]["missing_count"] == 100
    strict = column_types(profile(numbered("slash", [(r[5],) for r in rows]), strict_numbers=True))
    assert strict == {"slash": "date"}


@pytest.mark.parametrize("sample_rows", [5_000, 0])
def test_ties_and_samples_do_not_depend_on_partitions(numbered, sample_rows):
    data = [("b", " X "), ("a", None), ("a", "x"), ("b", "- "), ("c", "y" * 100), ("c", "Y" * 100), ("d", "z")]
    for partitions in (1, 4):
        rows = records(profile(numbered("v w", data, partitions), sample_rows=sample_rows))
        assert [tuple(t) for t in rows["v"]["top_values"]] == [("b", 2), ("a", 2), ("c", 2), ("d", 1)]
        assert [tuple(t) for t in rows["w"]["top_values"]] == [("x", 2), ("y" * 100, 2), ("z", 1)]
        assert rows["w"]["sample_values"] == [" X ", "x", "y" * 100, "Y" * 100, "z"]
        assert rows["w"]["distinct_count"] == 3 and rows["w"]["missing_count"] == 2


def test_sample_limit_and_late_samples(numbered):
    rows = [(None, "1")] * 1500 + [(str(i), "x") for i in range(10)]
    df = numbered("late num", rows)
    head = records(profile(df, sample_rows=1500))
    assert head["late"]["detected_type"] == "text" and head["num"]["detected_type"] == "boolean"
    full = records(profile(df, sample_rows=0, small_group=4))
    assert full["late"]["sample_values"] == ["0", "1", "2", "3", "4"]
    assert full["late"]["numeric_median"] == 4.5


def test_equal_cells_are_read_once(numbered, spark):
    """What a profile reads of cells comes from one row for each distinct cell, and counts every one of them."""
    cells = [" 12 ", "12", "N/A", None, "x" * 70, "X" * 70, "2024-01-05", "yes", "12 ", "1e400"]
    df = numbered("a b", [(cells[i % len(cells)], str(i % 3)) for i in range(3_000)]).withColumn("k", (F.col("_row") % 4).cast("double"))
    counts = cell_counts(df, ["a", "b", "k"])
    assert counts.count() == len(cells) - 1 + 3 + 4  # the long texts are one value
    sums = {r["position"]: r for r in counts.groupBy("position").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("present").cast("int")).alias("m")).collect()}
    assert [(sums[i]["n"], sums[i]["m"]) for i in range(3)] == [(3_000, 2_400), (3_000, 3_000), (3_000, 3_000)]
    rows = records(profile(df, small_group=2))
    assert (rows["a"]["non_missing_count"], rows["a"]["missing_count"], rows["a"]["distinct_count"]) == (2_400, 600, 5)
    assert [tuple(t) for t in rows["a"]["top_values"]][:2] == [("12", 900), ("x" * 70, 600)]
    plain = df.agg(*[f(c) for c in ("b", "k") for f in (F.avg, F.stddev_samp, F.median)]).first()
    for at, c in enumerate(("b", "k")):
        found = [rows[c][f"numeric_{n}"] for n in ("mean", "stddev", "median")]
        assert found == pytest.approx(plain[3 * at : 3 * at + 3], rel=1e-12)


def test_numbers_whose_sum_no_double_holds(spark):
    df = spark.createDataFrame([(1e308, 2.0), (1.1e308, 2.0), (1.2e308, None), (None, float("nan"))], "a double, b double")
    rows = records(profile(df))
    plain = df.agg(F.stddev_samp("a")).first()[0]
    assert rows["a"]["numeric_median"] == 1.1e308 and rows["a"]["numeric_stddev"] == pytest.approx(plain, nan_ok=True)
    assert rows["b"]["non_missing_count"] == 3 and rows["b"]["distinct_count"] == 2


def test_weighted_order_statistics(spark):
    """A row that counts w times is w rows, with wide and narrow searches."""
    rng = random.Random(5)
    rows = [(g, float(rng.choice([1, 2, 2.5, 7, 1e6, -3])) if g else 4.0, rng.randint(1, 9)) for g in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, v double, w int")
    each = spark.createDataFrame([(g, v) for g, v, w in rows for _ in range(w)], "g int, v double")
    wanted = {"median": MEDIAN, "q1": linear(0.25), "q9": floor_index(0.9), "up": upper_middle}
    plain = order_statistics(each, ["g"], "v", wanted)
    assert order_statistics(df, ["g"], "v", wanted, weight="w") == plain
    assert order_statistics(df, ["g"], "v", wanted, small_group=3, bins=4, weight="w") == plain


def test_sketches_make_no_row_for_a_cell(spark):
    df = spark.range(300).select(*[(F.col("id") % (i + 1)).cast("string" if i % 2 else "long").alias(f"c{i}") for i in range(40)])
    sketches = distinct_sketches(df)
    assert "Expand" not in sketches._jdf.queryExecution().optimizedPlan().toString()
    found = {r["column"]: (r["position"], r["distinct_estimate"]) for r in distinct_estimates(sketches).collect()}
    assert found == {f"c{i}": (i, i + 1) for i in range(40)}
    none = distinct_sketches(df.filter("c0 < 0"), ["c3"])
    assert [r["distinct_estimate"] for r in distinct_estimates(merge_sketches(none, distinct_sketches(df, ["c3"]))).collect()] == [4]


def test_empty_table(numbered):
    rows = records(profile(numbered("a b", [])))
    assert rows["a"]["detected_type"] == "text" and rows["b"]["non_missing_count"] == 0


def test_quality_counters(numbered):
    df = numbered("a b", [("x", "1"), ("x", "1"), ("X", "1"), (None, None), (None, None), ("", "NA")])
    row = quality(df).first()
    assert tuple(row) == (6, 2, 0, 2, 6)
    assert duplicate_rows(df, ["a"]).first()[0] == 2
    assert missing_cells(df, ["b"]).first()["missing_cell_count"] == 3


def test_duplicates_keep_cell_borders_apart(numbered):
    df = numbered("a b", [("1:x", "y"), ("1", ":xy"), ("~", None), (None, "~")])
    assert duplicate_rows(df).first()[0] == 0


def test_outliers(numbered, spark):
    df = numbered("value", [("10",), ("11",), ("12",), ("10",), ("100",)])
    found = outliers(df, {"value": "numeric"}).collect()
    assert [(r["row_number"], r["value"], r["method"]) for r in found] == [(6, 100.0, "iqr")]
    assert found[0]["lower_bound"] == 7.0 and found[0]["upper_bound"] == 15.0
    assert found[0]["score"] == pytest.approx(100 - 28.6)
    constant = spark.range(100_000).selectExpr("id + 2 AS _row", "0.1D AS v").repartition(8)
    assert outliers(constant, {"v": "numeric"}).count() == 0
    centered = numbered("v:double", [(-1.0,), (0.0,), (0.0,), (0.0,), (0.0,), (1.0,)])
    assert {r["score"] for r in outliers(centered, {"v": "numeric"}).collect()} == {0.0}


def test_findings_order_and_text(numbered):
    rows = [("1", "a", None)] * 3 + [("2", "b", "x"), ("bad", "c", "y"), ("4", "d", "n/a"), ("500", "e", "z")] + [("3", "f", "q")] * 4
    df = numbered("n c m", rows)
    found = profile(df)
    issues = findings(found, quality(df), outliers(df, column_types(found))).collect()
    assert [(r["code"], r["column"]) for r in issues] == [
        ("duplicate_rows", None), ("inconsistent_values", "n"), ("missing_values", "m"), ("outliers_detected", "n"),
    ]
    assert issues[0]["message"] == "Detected 5 duplicate record(s)."
    assert issues[2]["message"] == "Column 'm' contains 4 missing value(s) out of 11 row(s)."
    assert issues[2]["severity"] == "warning" and issues[2]["details"]["missing_count"] == "4"


def test_order_statistics_with_hot_values_and_tiny_groups(spark):
    values = [("a", float(i * i)) for i in range(1000)] + [("b", 7.0)] * 700 + [("b", float(i)) for i in range(300)]
    values += [("c", v) for v in (1e308, -1e308, 5e-324, 0.0, float("inf"), 1e-320) * 30]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    wanted = {"q1": linear(0.25), "median": MEDIAN, "q3": floor_index(0.75), "upper": upper_middle}
    direct = order_statistics(df, ["g"], "v", wanted)
    narrowed = order_statistics(df, ["g"], "v", wanted, small_group=3, bins=4)
    assert narrowed == direct
    for g in "abc":
        ordered = sorted(v for k, v in values if k == g)
        n = len(ordered)
        assert direct[(g,)]["q3"] == ordered[int((n - 1) * 0.75)] and direct[(g,)]["upper"] == ordered[n // 2]
        assert direct[(g,)]["median"] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_many_tables_have_the_profiles_of_each(spark):
    """Tables of one schema, one with most rows: each one's profile is that of the table alone, in as many jobs as for two."""
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        table = "hot" if rng.random() < 0.6 else rng.choice([None, *(f"t{k}" for k in range(12))])
        rows.append((i + 2, table, rng.choice(["1", "2.5", "x", None, "n/a", str(i)]), rng.choice(["A ", "a", "b", None]), rng.choice([1.5, None, float(i)]), f"long text {'y' * 70} {i % 9}", f"2026-01-{i % 28 + 1:02d}"))
    df = spark.createDataFrame(rows, "_row long, name string, num string, cat string, size double, note string, day string").repartition(5)

    def jobs(frame):
        group = f"profile-{id(frame)}"
        spark.sparkContext.setJobGroup(group, "")
        out = profile_datasets(frame, "name", small_group=50).collect()
        spark.sparkContext.setJobGroup("others", "")
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    found, many = jobs(df)
    _, two = jobs(df.filter("name IN ('hot', 't1')"))
    assert many <= two + 4
    for table in ("hot", "t3", ""):
        own = df.filter(F.coalesce("name", F.lit("")) == table).drop("name")
        alone = {r["column"]: r.asDict(recursive=True) for r in profile(own).collect()}
        for r in found:
            if r["dataset"] == table:
                got, want = r.asDict(recursive=True), alone[r["column"]]
                assert got.pop("dataset") == table
                assert got.keys() == want.keys()
                for key, value in want.items():
                    assert got[key] == (pytest.approx(value) if isinstance(value, float) else value), (table, r["column"], key)
