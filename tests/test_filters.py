import pytest

from tabsight.config import FilterSpec
from tabsight.functions.filters import slice_rows

ROWS = [(2, "london", 5.0, True), (3, "boston", 20.0, False), (4, None, None, None), (5, "paris", 10.0, True)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "_row long, s string, x double, b boolean")


@pytest.mark.parametrize(
    "spec, rows",
    [
        (("s", "equals", "boston"), [3]),
        (("s", "equals", None), [4]),
        (("x", "equals", 5), [2]),
        (("x", "equals", "5"), []),
        (("b", "equals", 1), [2, 5]),
        (("s", "not_equals", "boston"), [2, 4, 5]),
        (("x", "not_equals", "5"), [2, 3, 4, 5]),
        (("s", "contains", "ON"), [2, 3, 4]),
        (("s", "contains", None), []),
        (("x", "greater_than", "$5"), [3, 5]),
        (("x", "greater_equal", 10), [3, 5]),
        (("x", "less_than", 10), [2]),
        (("x", "less_equal", "10"), [2, 5]),
        (("x", "greater_than", "n/a"), []),
        (("x", "between", 5, 10), [2, 5]),
        (("s", "in", ["paris", None]), [4, 5]),
        (("s", "in", "paris"), [5]),
        (("absent", "equals", None), [2, 3, 4, 5]),
        (("absent", "equals", "x"), []),
    ],
)
def test_operations(frame, spec, rows):
    kept = slice_rows(frame, [FilterSpec(*spec)])
    assert sorted(r["_row"] for r in kept.collect()) == rows


def test_conjunction_and_empty(frame):
    both = [FilterSpec("b", "equals", True), FilterSpec("x", "greater_than", 5)]
    assert [r["_row"] for r in slice_rows(frame, both).collect()] == [5]
    assert slice_rows(frame, []).count() == 4


def test_unknown_operation(frame):
    with pytest.raises(ValueError):
        slice_rows(frame, [FilterSpec("s", "like", "x")])
