"""The same results in plain SQL over the same tables."""

from __future__ import annotations

GAPPY = """gappy AS (
  SELECT event_id,
         CASE WHEN event_id % 5 = 0 THEN ' - ' WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN event_id % 13 = 0 THEN 'broken' ELSE CAST(value AS VARCHAR) END AS value
  FROM events),
std AS (
  SELECT event_id + 2 AS _row, CAST(event_id AS DOUBLE) AS event_id,
         CASE WHEN event_id % 5 <> 0 THEN lower(event_type) END AS event_type,
         CASE WHEN event_id % 7 <> 0 AND event_id % 13 <> 0 THEN value END AS value,
         event_id % 5 = 0 AS type_missing, event_id % 7 = 0 AS value_missing
  FROM events)"""


def _profile(table: str, columns: list[tuple[str, str, str]], source: str | None = None) -> str:
    """One row per column; each is (name, detected type, expression of its typed value)."""
    parts = []
    for name, kind, expr in columns:
        if kind == "numeric":
            numbers = (
                f"round(min({expr}), 4) AS numeric_min, round(max({expr}), 4) AS numeric_max, "
                f"round(avg({expr}), 4) AS numeric_mean, round(median({expr}), 4) AS numeric_median, "
                f"round(stddev_samp({expr}), 4) AS numeric_stddev"
            )
        else:
            numbers = ", ".join(
                f"CAST(NULL AS DOUBLE) AS numeric_{n}" for n in ("min", "max", "mean", "median", "stddev")
            )
        if kind == "date":
            iso = (
                "strftime({0}, '%Y-%m-%dT%H:%M:%S') || "
                "CASE WHEN microsecond({0}) % 1000000 <> 0 THEN strftime({0}, '.%f') ELSE '' END"
            )
            dates = f"{iso.format(f'min({expr})')} AS date_min, {iso.format(f'max({expr})')} AS date_max"
        else:
            dates = "CAST(NULL AS VARCHAR) AS date_min, CAST(NULL AS VARCHAR) AS date_max"
        folded = rf"lower(trim(regexp_replace({name}, '\s+', ' ', 'g')))" if kind in ("categorical", "text") else name
        m, u = f"count({name})", f"count(DISTINCT {folded})"
        if kind == "categorical":
            confidence = f"greatest(0.5, least(1.0, 1.5 - {u} / {m}::DOUBLE))"
        elif kind == "text":
            confidence = expr
        else:
            confidence = f"count({expr}) / {m}::DOUBLE"
        invalid = "0" if kind in ("categorical", "text") else f"{m} - count({expr})"
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS detected_type, round(CAST({confidence} AS DOUBLE), 4) AS confidence, "
            f"{m} AS non_missing_count, count(*) - {m} AS missing_count, {u} AS distinct_count, "
            f"CAST({invalid} AS BIGINT) AS invalid_count, {numbers}, {dates} FROM {source or table}"
        )
    return "\nUNION ALL ".join(parts)


def _digits(column: str) -> str:
    return f"CAST(regexp_extract({column}, '[0-9]+') AS DOUBLE)"


def _same(kind: str, *names: str) -> list[tuple[str, str, str]]:
    return [(n, kind, n) for n in names]


LINEITEM = (
    _same("numeric", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    + _same("categorical", "l_returnflag", "l_linestatus")
    + _same("date", "l_shipdate")
)
ORDERS = (
    _same("numeric", "o_orderkey", "o_custkey", "o_totalprice")
    + _same("categorical", "o_orderstatus", "o_orderpriority")
    + _same("date", "o_orderdate")
)
EVENTS = (
    _same("numeric", "event_id", "user_id", "value")
    + [("props", "numeric", _digits("props"))]
    + _same("categorical", "event_type")
    + _same("date", "ts")
)
PART = (
    _same("numeric", "p_partkey", "p_size", "p_retailprice")
    + [("p_brand", "numeric", _digits("p_brand"))]
    + _same("categorical", "p_name", "p_type")
)
CUSTOMER = (
    _same("numeric", "c_custkey", "c_nationkey", "c_acctbal")
    + _same("categorical", "c_mktsegment")
    + [("c_name", "text", "0.0")]
)
LABELS = _same("numeric", "doc_id") + _same("boolean", "quality", "toxic")
DOCUMENTS = (
    _same("numeric", "doc_id", "n_chars")
    + [("source", "numeric", _digits("source"))]
    + _same("categorical", "lang")
    + [("text", "text", "0.0")]
)


def _filter(condition: str) -> str:
    return f"WITH {GAPPY} SELECT event_id, event_type, value FROM std WHERE {condition}"


def _outliers(table: str, key: str, column: str, iqr: float = 1.5, z: float = 3.0) -> str:
    return f"""
WITH s AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3,
                  avg({column}) AS mean, stddev_samp({column}) AS sd FROM {table}),
f AS (SELECT {key} + 2 AS row_number, {column} AS value, q1 - {iqr} * (q3 - q1) AS lo, q3 + {iqr} * (q3 - q1) AS hi,
             mean, abs(({column} - mean) / sd) AS z FROM {table}, s),
g AS (SELECT *, value < lo OR value > hi AS by_iqr, z >= {z} AS by_z FROM f)
SELECT '{column}' AS "column", row_number, value,
       CASE WHEN by_iqr AND by_z THEN 'both' WHEN by_iqr THEN 'iqr' ELSE 'zscore' END AS method,
       round(CASE WHEN by_z THEN z ELSE abs(value - mean) END, 6) AS score,
       round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound
FROM g WHERE by_iqr OR by_z"""


def _fill(value: str = "value", event_type: str = "event_type", extra: str = "", where: str = "true") -> str:
    return (
        f"WITH {GAPPY}{extra} SELECT _row, event_id, {event_type} AS event_type, round({value}, 6) AS value "
        f"FROM std WHERE {where}"
    )


_FIRST_SEEN = "(SELECT {c} FROM std WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, min(_row) LIMIT 1)"
_BACK = (
    "CASE WHEN {m} THEN first_value({c} IGNORE NULLS) "
    "OVER (ORDER BY _row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE {c} END"
)


def _last_row(missing: str) -> str:
    """Row number of the last earlier cell that was there."""
    return (
        f"last_value(CASE WHEN NOT {missing} THEN _row END IGNORE NULLS) "
        "OVER (ORDER BY _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


FORWARD = f"""WITH {GAPPY},
prev AS (SELECT *, {_last_row("value_missing")} AS vrow, {_last_row("type_missing")} AS trow FROM std)
SELECT p._row, p.event_id,
       CASE WHEN p.type_missing THEN t.event_type ELSE p.event_type END AS event_type,
       round(CASE WHEN p.value_missing THEN v.value ELSE p.value END, 6) AS value
FROM prev p LEFT JOIN std v ON p.vrow = v._row LEFT JOIN std t ON p.trow = t._row"""

CHANGE_LOG = f"""WITH {GAPPY},
prev AS (SELECT *, {_last_row("value_missing")} AS vrow FROM std),
raw AS (SELECT event_id + 2 AS _row, event_type AS raw_type, value AS raw_value FROM gappy),
mode AS (SELECT {_FIRST_SEEN.format(c="event_type")} AS best)
SELECT _row AS row_number, 'event_type' AS "column", 'fill_missing' AS operation, raw_type AS before, best AS after,
       'Applied mode strategy.' AS reason
FROM std JOIN raw USING (_row), mode WHERE type_missing
UNION ALL
SELECT _row, 'event_type', 'normalize_categorical', raw_type, event_type,
       'Normalized categorical text for consistent grouping and reporting.'
FROM std JOIN raw USING (_row) WHERE NOT type_missing AND raw_type <> event_type
UNION ALL
SELECT p._row, 'value', 'fill_missing', raw_value, CAST(v.value AS VARCHAR), 'Applied forward_fill strategy.'
FROM prev p JOIN raw USING (_row) LEFT JOIN std v ON p.vrow = v._row WHERE p.value_missing
UNION ALL
SELECT _row, 'value', 'standardize_numeric', raw_value, CAST(value AS VARCHAR), 'Normalized numeric text into a numeric value.'
FROM std JOIN raw USING (_row) WHERE value IS NOT NULL"""


def _summary() -> str:
    def nth(c: str, q: float) -> str:
        return f"list_sort(list({c}))[CAST(floor((count({c}) - 1) * {q}) AS BIGINT) + 1]"

    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, "
        f"round(stddev_samp({c}), 4) AS stddev, round(min({c}), 4) AS min, round({nth(c, 0.25)}, 4) AS q1, "
        f"round({nth(c, 0.75)}, 4) AS q3, round(max({c}), 4) AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )


def _correlations(table: str, columns: list[str], prefix: str = "") -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return prefix + "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({b}, {a}), 6) AS correlation, "
        f"count({a} + {b}) AS pair_count FROM {table}"
        for a, b in pairs
    )


def _segments(table: str, columns: list[str], measure: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS row_count, "
        f"round(count(*) / (SELECT count(*) FROM {table})::DOUBLE, 6) AS share, "
        f"round(avg({measure}), 4) AS mean, round(median({measure}), 4) AS median FROM {table} GROUP BY {c}"
        for c in columns
    )


def _fit(table: str, date: str, value: str) -> str:
    x = f"(date_diff('day', DATE '1970-01-01', CAST({date} AS DATE)) + 719163)::DOUBLE"
    return f"""(SELECT '{date}' AS date_column, '{value}' AS value_column,
  regr_slope({value}, {x}) AS slope, regr_intercept({value}, {x}) AS icpt, regr_r2({value}, {x}) AS r2 FROM {table})"""


def _residuals(table: str, key: str, date: str, value: str) -> str:
    x = f"(date_diff('day', DATE '1970-01-01', CAST({date} AS DATE)) + 719163)"
    return f"""SELECT date_column, value_column, {key} + 2 AS row_number, CAST({x} AS INTEGER) AS day_number,
  icpt + slope * {x} AS predicted, CAST({value} AS DOUBLE) AS actual,
  {value} - (icpt + slope * {x}) AS residual, slope, r2 FROM {table}, {_fit(table, date, value)}"""


def _trends(table: str, key: str, date: str, values: list[str], z: float) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT any_value(date_column) AS date_column, any_value(value_column) AS value_column,
  round(any_value(slope), 6) AS slope,
  CASE WHEN any_value(slope) > 0 THEN 'increasing' WHEN any_value(slope) < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  round(any_value(r2), 6) AS r_squared, count(*) FILTER (abs(residual / sd) >= {z}) AS anomaly_count
FROM (SELECT *, stddev_samp(residual) OVER () AS sd FROM ({_residuals(table, key, date, v)}))"""
        for v in values
    )


_REGRESSION = """
WITH m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
s AS (SELECT sum((l_quantity - m1) ^ 2) AS s11, sum((l_discount - m2) ^ 2) AS s22,
             sum((l_quantity - m1) * (l_discount - m2)) AS s12,
             sum((l_quantity - m1) * (l_extendedprice - my)) AS s1y,
             sum((l_discount - m2) * (l_extendedprice - my)) AS s2y,
             sum((l_extendedprice - my) ^ 2) AS tss FROM lineitem, m),
w AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS w1,
             (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS w2, tss FROM s),
fit AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS w0, tss FROM w, m)"""

_CHARTS = """
WITH p AS (SELECT * FROM (VALUES
  (0, 'histogram', 'o_orderkey'), (1, 'histogram', 'o_custkey'), (2, 'histogram', 'o_totalprice'),
  (3, 'bar', 'o_orderstatus'), (4, 'bar', 'o_orderpriority'), (5, 'line', 'o_orderkey')) v(position, kind, c))
SELECT position, kind,
  CASE kind WHEN 'histogram' THEN 'Distribution of ' || c WHEN 'bar' THEN 'Top values for ' || c
            ELSE 'Trend: ' || c || ' by o_orderdate' END AS title,
  CASE kind WHEN 'histogram' THEN 'Histogram for numeric column ''' || c || '''.'
            WHEN 'bar' THEN 'Category frequency chart for ''' || c || '''.'
            ELSE 'Time-series trend for ''' || c || ''' over ''o_orderdate''.' END AS description
FROM p WHERE (SELECT count(*) FROM orders) >= 3"""

_ORDER_OUTLIERS = " + ".join(
    f"(SELECT count(*) FROM orders, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
    f"avg({c}) AS mean, stddev_samp({c}) AS sd FROM orders) WHERE {c} < q1 - 1.5 * (q3 - q1) "
    f"OR {c} > q3 + 1.5 * (q3 - q1) OR abs(({c} - mean) / sd) >= 3)"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)

_INSIGHTS = f"""
WITH f AS (SELECT count(*) AS n, regr_slope(o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS slope,
    regr_r2(o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS r2,
    corr(o_orderkey, o_custkey) AS a, corr(o_orderkey, o_totalprice) AS b, corr(o_custkey, o_totalprice) AS c,
    count(*) - count(DISTINCT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS copies
  FROM orders),
d AS (SELECT *, 'o_orderkey shows a ' || CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END ||
    ' trend over o_orderdate with R² of ' || printf('%.2f', r2) || '.' AS trend,
    (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS fit, {_ORDER_OUTLIERS} AS outliers FROM f)
SELECT 'Processed ' || format('{{:,}}', n) || ' row(s) across 6 column(s). The quality report found 0 missing cell(s), ' ||
    format('{{:,}}', copies) || ' duplicate record(s), and ' || format('{{:,}}', outliers) ||
    ' potential outlier(s). Strongest analytical signals include ' || trend || '.' AS executive_summary,
  trend || ' | Basic regression on o_orderkey explains ' || printf('%.2f', fit) ||
    ' of observed variance using 2 feature(s).' AS key_drivers,
  '' AS risks,
  'Review the top missing-value columns and choose a fill strategy that matches the business meaning of each field. | ' ||
  'Validate the outlier rows against source systems before treating them as true anomalies. | ' ||
  'Promote the strongest correlated dimensions into monitored KPIs or downstream feature engineering.' ||
  CASE WHEN fit < 0.4 THEN ' | Treat the current predictive model as exploratory only; more features or more rows may be needed.' ELSE '' END
    AS recommended_actions
FROM d"""

_DATE_LAYOUTS = """CASE o_orderkey % 12
  WHEN 3 THEN CASE WHEN day(o_orderdate) <= 12
                   THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0.0)
                   ELSE o_orderdate END
  WHEN 8 THEN o_orderdate - INTERVAL 330 MINUTE
  WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE o_orderdate END"""

ORACLE: dict[str, str] = {
    "profile_lineitem": _profile("lineitem", LINEITEM),
    "profile_orders": _profile("orders", ORDERS),
    "profile_events": _profile("events", EVENTS),
    "profile_part": _profile("part", PART),
    "profile_customer": _profile("customer", CUSTOMER),
    "profile_labels": _profile("labels", LABELS),
    "profile_documents": _profile("documents", DOCUMENTS),
    "profile_sample_events": _profile("events", EVENTS, "(SELECT * FROM events ORDER BY event_id LIMIT 5000)"),
    "top_values_orders": "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) - 1 AS rank, "
        f"lower(CAST({c} AS VARCHAR)) AS value, count(*) AS n FROM orders GROUP BY {c} "
        f"QUALIFY row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) <= 5"
        for c in ("o_custkey", "o_orderstatus", "o_orderpriority")
    ),
    "top_values_typed": "\nUNION ALL ".join(
        f"SELECT {n} AS rows_asked, '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) - 1 AS rank, "
        f"CAST({value} AS VARCHAR) AS value, count(*) AS n FROM orders WHERE {n} = 0 OR o_orderkey < {n} GROUP BY {value} "
        f"QUALIFY row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) <= 5"
        for n in (0, 5_000)
        for c, value in (("day", "CAST(o_orderdate AS DATE)"), ("tenth", "CAST((o_orderkey % 7) / 10.0 AS FLOAT)"))
    ),
    "profile_aggregated_orders": _profile(
        "orders",
        [("bucket", "numeric", "bucket"), ("orders", "numeric", "orders"), ("largest", "numeric", "largest"), ("latest", "date", "latest")],
        "(SELECT o_custkey % 500 AS bucket, count(*) AS orders, max(o_totalprice) AS largest, max(o_orderdate) AS latest FROM orders GROUP BY 1)",
    ),
    "sample_values_events": f"WITH {GAPPY} "
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY event_id) - 1 AS rank, CAST({c} AS VARCHAR) AS value "
        f"FROM gappy WHERE {c} NOT IN (' - ', 'N/A') QUALIFY row_number() OVER (ORDER BY event_id) <= 5"
        if c != "event_id"
        else "SELECT 'event_id' AS \"column\", row_number() OVER (ORDER BY event_id) - 1 AS rank, "
        "CAST(event_id AS VARCHAR) AS value FROM gappy QUALIFY row_number() OVER (ORDER BY event_id) <= 5"
        for c in ("event_id", "event_type", "value")
    ),
    "missing_cells_events": "SELECT count(*) AS row_count, "
    "sum((event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT)::BIGINT AS missing_cell_count FROM events",
    "missing_tokens_events": "SELECT event_id, (event_id % 5 = 0)::INT AS type_missing, "
    "(event_id % 7 = 0)::INT AS value_missing FROM events",
    "quality_events": f"WITH {GAPPY} SELECT count(*) AS row_count, 2 AS column_count, 0 AS malformed_row_count, "
    "count(*) - count(DISTINCT (event_type, value)) AS duplicate_row_count, "
    "sum((event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT)::BIGINT AS missing_cell_count FROM gappy",
    "quality_findings_events": f"""WITH {GAPPY},
c AS (SELECT count(*) AS n, count(*) FILTER (type_missing) AS t, count(*) FILTER (value_missing) AS v,
             count(*) FILTER (NOT value_missing AND value IS NULL) AS bad FROM std),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean,
             stddev_samp(value) AS sd FROM std),
o AS (SELECT count(*) AS k FROM std, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
             OR abs((value - mean) / sd) >= 3)
SELECT CASE WHEN t / n::DOUBLE < 0.1 THEN 'info' ELSE 'warning' END AS severity, 'missing_values' AS code, 'event_type' AS "column",
  'Column ''event_type'' contains ' || t || ' missing value(s) out of ' || n || ' row(s).' AS message FROM c
UNION ALL SELECT CASE WHEN v / n::DOUBLE < 0.1 THEN 'info' ELSE 'warning' END, 'missing_values', 'value',
  'Column ''value'' contains ' || v || ' missing value(s) out of ' || n || ' row(s).' FROM c
UNION ALL SELECT 'warning', 'inconsistent_values', 'value',
  'Column ''value'' has ' || bad || ' value(s) that do not fit the inferred numeric schema.' FROM c
UNION ALL SELECT 'warning', 'outliers_detected', 'value', 'Detected ' || k || ' potential outlier(s) in ''value''.' FROM o""",
    "duplicate_rows_lineitem": "SELECT count(*) - count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS duplicate_row_count FROM lineitem",
    "duplicate_documents": "SELECT count(*) - count(DISTINCT text) AS duplicate_row_count FROM documents",
    "parse_number_cells": "SELECT o_orderkey, round(CASE o_orderkey % 8 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice "
    "WHEN 2 THEN o_totalprice / 100 WHEN 3 THEN o_totalprice WHEN 6 THEN o_totalprice * 100 END, 4) AS number FROM orders",
    "parse_number_brands": f"SELECT p_partkey, {_digits('p_brand')} AS number FROM part",
    "parse_boolean_cells": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 2, 4) THEN 1 "
    "WHEN o_orderkey % 8 IN (1, 3, 5) THEN 0 END AS flag FROM orders",
    "parse_date_cells": f"SELECT o_orderkey, {_DATE_LAYOUTS} AS parsed FROM orders",
    "normalize_text_cells": "SELECT c_custkey, lower(t) AS lowered, upper(t) AS uppered, "
    "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Of ' || upper(left(c_name, 1)) || lower(substr(c_name, 2)) AS titled, "
    "lower(t) AS folded, t AS collapsed FROM (SELECT *, c_mktsegment || ' of ' || lower(c_name) AS t FROM customer)",
    "standardize_events": f"WITH {GAPPY} SELECT _row, event_id, event_type, value FROM std",
    "filter_equals": _filter("event_type = 'click'"),
    "filter_not_equals": _filter("event_type IS DISTINCT FROM 'click'"),
    "filter_contains": _filter("coalesce(event_type, 'none') LIKE '%on%'"),
    "filter_greater_than": _filter("value > 50"),
    "filter_greater_equal": _filter("value >= 50"),
    "filter_less_than": _filter("value < 10"),
    "filter_less_equal": _filter("value <= 10"),
    "filter_between": _filter("value BETWEEN 10 AND 20"),
    "filter_in": _filter("event_type IN ('view', 'error') OR event_type IS NULL"),
    "filter_conjunction": _filter("event_type = 'view' AND value > 20"),
    "outliers_both": _outliers("events", "event_id", "value"),
    "outliers_iqr": _outliers("events", "event_id", "value", z=1e9),
    "outliers_zscore": _outliers("events", "event_id", "value", iqr=1e9, z=2.0),
    "outliers_customer": _outliers("customer", "c_custkey", "c_acctbal", iqr=0.2, z=1.5),
    "fill_mean": _fill("CASE WHEN value_missing THEN (SELECT avg(value) FROM std) ELSE value END"),
    "fill_median": _fill("CASE WHEN value_missing THEN (SELECT median(value) FROM std) ELSE value END"),
    "fill_mode": _fill(
        event_type=f"CASE WHEN type_missing THEN {_FIRST_SEEN.format(c='event_type')} ELSE event_type END"
    ),
    "fill_mode_first_seen": _fill(f"CASE WHEN value_missing THEN {_FIRST_SEEN.format(c='value')} ELSE value END"),
    "fill_constant": _fill(
        "CASE WHEN value_missing THEN -1.0 ELSE value END", "CASE WHEN type_missing THEN '' ELSE event_type END"
    ),
    "fill_date_median": "WITH d AS (SELECT list_sort(list(ts)) AS s FROM events WHERE event_id % 4 <> 0) "
    "SELECT CAST(event_id AS DOUBLE) AS event_id, CASE WHEN event_id % 4 = 0 THEN s[len(s) // 2 + 1] ELSE ts END AS ts FROM events, d",
    "drop_missing_rows": _fill(where="NOT type_missing"),
    "forward_fill": FORWARD,
    "back_fill": _fill(_BACK.format(m="value_missing", c="value"), _BACK.format(m="type_missing", c="event_type")),
    "change_log": CHANGE_LOG,
    "clean_report": """SELECT count(*) AS rows_in, count(*) FILTER (event_id % 5 <> 0) AS rows_out,
  count(*) FILTER (event_id % 5 = 0) AS dropped_rows,
  count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 = 0) AS filled_cells,
  count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 13 <> 0) AS standardized_numeric_cells,
  count(*) FILTER (event_id % 5 <> 0 AND event_id % 3 = 0) AS normalized_categorical_cells FROM events""",
    "summary_statistics": _summary(),
    "correlations": _correlations("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "correlations_gappy": _correlations(
        "j",
        ["event_id", "value", "user_id"],
        f"WITH {GAPPY}, j AS (SELECT s.event_id, s.value, CASE WHEN e.user_id % 9 <> 0 THEN e.user_id END AS user_id "
        "FROM std s JOIN events e ON s.event_id = e.event_id) ",
    ),
    "segments": _segments("lineitem", ["l_returnflag", "l_linestatus"], "l_extendedprice"),
    "segments_orders": _segments("orders", ["o_orderstatus", "o_orderpriority"], "o_totalprice"),
    "trends": _trends("orders", "o_orderkey", "o_orderdate", ["o_totalprice", "o_custkey"], 1.5),
    "trends_events": _trends("events", "event_id", "ts", ["value", "user_id"], 3.0),
    "trend_anomalies": "SELECT date_column, value_column, row_number, day_number, round(predicted, 4) AS predicted, "
    "round(actual, 4) AS actual, round(abs(residual / sd), 4) AS zscore FROM (SELECT *, stddev_samp(residual) OVER () AS sd "
    f"FROM ({_residuals('events', 'event_id', 'ts', 'value')})) WHERE abs(residual / sd) >= 3",
    "regression_fit": _REGRESSION
    + " SELECT 'l_extendedprice' AS target_column, round(w0, 2) AS intercept, round(w1, 2) AS w_l_quantity, "
    "round(w2, 2) AS w_l_discount FROM fit",
    "regression_metrics": _REGRESSION
    + """, r AS (SELECT l_extendedprice - (w0 + w1 * l_quantity + w2 * l_discount) AS e, tss FROM lineitem, fit)
SELECT round(1 - sum(e * e) / any_value(tss), 6) AS r_squared, round(sqrt(avg(e * e)), 3) AS rmse,
       round(avg(abs(e)), 3) AS mae, count(*) AS observations FROM r""",
    "predictions": "WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM orders) "
    "SELECT o_orderkey, round(b + a * o_custkey, 0) AS prediction FROM orders, f",
    "histogram": """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi,
                  CAST(least(12, greatest(3, ceil(log2(count(value))) + 1)) AS INT) AS k FROM events),
w AS (SELECT lo, hi, k, (hi - lo) / k AS width FROM s),
c AS (SELECT CASE WHEN value = hi THEN k - 1 ELSE least(CAST(floor((value - lo) / width) AS INT), k - 1) END AS bin, count(*) AS n
      FROM events, w GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * width, 4) AS start, round(lo + i * width + width, 4) AS "end",
       coalesce(n, 0) AS count
FROM w, range(0, 12) r(i) LEFT JOIN c ON c.bin = i WHERE i < k""",
    "value_counts": "SELECT o_orderpriority AS value, count(*) AS n, "
    "row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) AS rank FROM orders GROUP BY 1",
    "value_counts_parts": "SELECT p_name AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS rank "
    "FROM part GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) <= 10",
    "trend_series": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS value FROM orders",
    "trend_series_by_day": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1",
    "scatter_points": "SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem",
    "chart_plan": _CHARTS,
    "insights": _INSIGHTS,
    "scan_csv": "SELECT o_orderkey + 2 AS row_number, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority, "
    "round(o_totalprice, 2) AS o_totalprice FROM orders",
    "malformed_rows": "SELECT 3 AS expected_fields, CASE o_orderkey % 10 WHEN 3 THEN 2 ELSE 4 END AS actual_fields, "
    "CASE o_orderkey % 10 WHEN 3 THEN o_orderkey || ',' || o_orderstatus "
    "ELSE o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority || ',extra' END AS raw_preview "
    "FROM orders WHERE o_orderkey % 10 IN (3, 7)",
    "audit_files": "SELECT DISTINCT d AS delimiter, 'utf-8' AS encoding, 'c_custkey c_name c_mktsegment' AS header, false AS multi_line "
    "FROM customer, (VALUES (','), (';'), (chr(9)), ('|')) v(d)",
    "row_numbers": "SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) + 1 AS row_number FROM events",
    "report_values": """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"name":' ||
  CASE WHEN c_nationkey % 5 = 0 THEN 'null' ELSE '"' || c_name || '"' END || '}' AS payload FROM customer""",
}
