"""More operators applied to the given tables, each with the same result in SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.config import ROW, Config, FilterSpec
from tabsight.functions import cells as C
from tabsight.functions.filters import slice_rows
from tabsight.operators import charts, cleaning, outliers, quality, stats, trend
from tabsight.operators import model as models
from tabsight.operators.insights import insights
from tabsight.operators.profile import column_types, distinct_estimates, distinct_sketches, merge_sketches, profile
from tabsight.operators.profile_many import profile_datasets
from tabsight.plans.queries import Query, _scratch, events, lineitem, orders, rounded, table
from tabsight.sources.csv import audit_files, scan_csv

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(function: Query) -> Query:
        QUERIES[function.__name__], ORACLE[function.__name__] = function, sql
        return function

    return register


def _csv_lines(df: DataFrame, header: str, line: Column, path: str, encoding: str = "UTF-8", by: str | None = None) -> str:
    """Lines as they are under a header line in every file; ``by`` gives each of its values files of its own."""
    writer = df.select(line.alias(header), *([by] if by else [])).write.option("header", "true").option("sep", "\u0001")
    writer = writer.partitionBy(by) if by else writer
    space = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    writer.options(quote="", escape="", emptyValue="", encoding=encoding, **space).csv(path)
    return path


# Sources -------------------------------------------------------------------------------------------


@query("""
  SELECT row_number() OVER (ORDER BY doc_id) + 1 AS row_number, CAST(doc_id AS VARCHAR) AS doc_id, nullif(source, '') AS source,
         length(nullif(text, '')) AS n_chars, md5(nullif(text, '')) AS text_md5 FROM documents""")
def scan_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as quoted cells, with the delimiters, quotes and line ends that they hold, over many splits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").orderBy("doc_id")
    path = _scratch(spark, "quoted-csv")
    space = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    docs.write.options(header="true", escape='"', quoteAll="true", **space).csv(path)
    rows = scan_csv(spark, path, delimiter=",", encoding="utf-8").rows
    return rows.select(F.col(ROW).alias("row_number"), "doc_id", "source", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("""
  SELECT part, line_number, 3 AS expected_fields, CASE k % 10 WHEN 3 THEN 2 ELSE 4 END AS actual_fields FROM (
    SELECT o_orderkey AS k, o_orderkey % 4 AS part, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) + 1 AS line_number FROM orders)
  WHERE k % 10 IN (3, 7)""")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where malformed records lie: files of four classes of orders, records counted with the header and blank ones."""
    k = F.col("o_orderkey")
    short, long = F.concat_ws(",", k, "o_orderstatus"), F.concat_ws(",", k, "o_orderstatus", "o_orderpriority", F.lit("extra"))
    blank = F.lit(" , ,")
    line = F.when(k % 10 == 3, short).when(k % 10 == 7, long).when(k % 10 == 5, blank).otherwise(F.concat_ws(",", k, "o_orderstatus", "o_orderpriority"))
    placed = orders(spark, sf_dir).withColumn("part", k % 4).repartition(4, "part").sortWithinPartitions("part", "o_orderkey")
    path = _csv_lines(placed, "o_orderkey,o_orderstatus,o_orderpriority", line, _scratch(spark, "malformed"), by="part")
    part = F.regexp_extract("dataset", "part=([0-9])", 1).cast("long")
    return scan_csv(spark, path).malformed.select(part.alias("part"), "line_number", "expected_fields", "actual_fields")


@query("""
  SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS row_number, CAST(c_custkey AS VARCHAR) AS c_custkey,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || ' é' END AS c_name, c_mktsegment,
         'cp1252' AS encoding FROM customer WHERE c_custkey % 7 <> 0""")
def scan_csv_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is no UTF-8, with blank records and empty cells."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "").otherwise(F.concat("c_name", F.lit(" é")))
    line = F.when(k % 7 == 0, F.when(k % 2 == 0, "  ").otherwise(";;")).otherwise(F.concat_ws(";", k, name, "c_mktsegment"))
    path = _csv_lines(table(spark, sf_dir, "customer").orderBy(k), "c_custkey;c_name;c_mktsegment", line, _scratch(spark, "latin"), "ISO-8859-1")
    scan = scan_csv(spark, path, delimiter=";")
    encoding = scan.audit.select("encoding").distinct()
    return scan.rows.withColumnRenamed(ROW, "row_number").join(F.broadcast(encoding), F.lit(True))


@query("""
  SELECT DISTINCT severity, code, message, line_number FROM customer, (VALUES
    ('warning', 'duplicate_header', 'Header ''name'' appears 2 times; later copies were renamed.', 1),
    ('warning', 'blank_header', '1 blank header name(s) were replaced.', 1),
    ('info', 'encoding_warning', 'Detected encoding ''cp1252''.', NULL)) v(severity, code, message, line_number)
  UNION ALL SELECT 'names', NULL, 'key name name__2 column_4', count(*) FROM customer""")
def ingest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan says of its headers and encoding, and the column names it gives."""
    line = F.concat_ws("|", "c_custkey", F.lit("é"), "c_name", F.lit("x"))
    path = _csv_lines(table(spark, sf_dir, "customer"), "key|name|name|", line, _scratch(spark, "findings"), "ISO-8859-1")
    scan = scan_csv(spark, path)
    names = scan.rows.agg(F.count(F.lit(1)).alias("line_number")).select(
        F.lit("names").alias("severity"), F.lit(None).cast("string").alias("code"), F.lit(" ".join(scan.headers)).alias("message"), "line_number"
    )
    return scan.findings.select("severity", "code", "message", "line_number").distinct().unionByName(names)


@query("""
  SELECT DISTINCT v.kind, v.error, v.delimiter, length(n_name) > 0 AS has_bytes FROM nation, (VALUES
    ('txt', 'Unsupported file type ''.txt''. Only .csv files are accepted.', NULL),
    ('json', 'Unsupported file type ''.json''. Only .csv files are accepted.', NULL), ('csv', NULL, '|')) v(kind, error, delimiter)""")
def audit_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of other types beside CSV files are named and not read."""
    nations, root = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _scratch(spark, "refused")
    line = F.concat_ws("|", "n_nationkey", "n_name")
    paths = [_csv_lines(nations, "n_nationkey|n_name", line, f"{root}/csv"), f"{root}/txt", f"{root}/json"]
    nations.select(line.alias("value")).write.text(paths[1])
    nations.write.json(paths[2])
    kind = F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind")
    return audit_files(spark, paths).select(kind, "error", "delimiter", (F.col("length") > 0).alias("has_bytes")).distinct()


# Cells, filters, cleaning --------------------------------------------------------------------------


@query("""
  SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN CAST(d AS TIMESTAMP) WHEN 1 THEN CAST(date_trunc('week', d) AS TIMESTAMP)
    WHEN 2 THEN CAST(d AS TIMESTAMP) + INTERVAL '3 hours 4 minutes' + INTERVAL 20 HOUR
    WHEN 3 THEN CAST(d AS TIMESTAMP) + INTERVAL '3 hours 4 minutes 5 seconds' - INTERVAL '23 hours 30 minutes'
    WHEN 4 THEN CAST(d AS TIMESTAMP) + INTERVAL 10 HOUR END AS parsed
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def parse_week_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO week dates, offsets beyond 18 hours, times of an hour alone, and weeks that a year hasn't."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    year, week = F.extract(F.lit("YEAROFWEEK"), d), F.lpad(F.weekofyear(d).cast("string"), 2, "0")
    day = F.date_format(d, "yyyy-MM-dd")
    text = (
        F.when(k % 6 == 0, F.concat(year, F.lit("-W"), week, F.lit("-"), F.weekday(d) + 1))
        .when(k % 6 == 1, F.concat(year, F.lit("W"), week))
        .when(k % 6 == 2, F.concat(year, F.lit("-W"), week, F.lit("-"), F.weekday(d) + 1, F.lit("T03:04-20:00")))
        .when(k % 6 == 3, F.concat(day, F.lit("T03:04:05+23:30")))
        .when(k % 6 == 4, F.concat(day, F.lit("T10")))
        .otherwise(F.concat(year, F.lit("-W54")))
    )
    return orders(spark, sf_dir).select("o_orderkey", C.parse_date(text).alias("parsed"))


@query("""
  SELECT v.operation, CASE WHEN v.kept THEN count(*) ELSE 0 END AS rows FROM events, (VALUES ('equals', true), ('not_equals', true),
    ('contains', true), ('in', false), ('greater_than', false), ('between', false)) v(operation, kept) GROUP BY v.operation, v.kept""")
def filter_absent_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that isn't there reads as missing in every row."""
    specs = [("equals", None), ("not_equals", "x"), ("contains", "NON"), ("in", ["a", 1]), ("greater_than", 0), ("between", 0, 9)]
    df = events(spark, sf_dir)
    counts = [
        slice_rows(df, [FilterSpec("nowhere", *spec)]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(spec[0]).alias("operation"), "rows")
        for spec in specs
    ]
    found = counts[0]
    for other in counts[1:]:
        found = found.unionByName(other)
    return found


DEFAULT_TYPES = {"amount": "numeric", "status": "categorical", "day": "date", "flag": "boolean", "note": "text", "none": "categorical", "gone": "numeric"}


def _dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text with gaps of every kind, a column without a value, and one without a number."""
    k = F.col("o_orderkey")
    return orders(spark, sf_dir).select(
        ROW, "o_orderkey",
        F.when(k % 9 == 0, "n/a").otherwise(F.format_string("%d", k % 1000)).alias("amount"),
        F.when(k % 7 == 0, "-").otherwise(F.concat(F.lit("  "), F.upper("o_orderstatus"))).alias("status"),
        F.when(k % 11 == 0, "").otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("day"),
        F.when(k % 5 == 0, None).when(k % 3 == 0, "Yes").otherwise("n").alias("flag"),
        F.when(k % 13 == 0, " NULL ").otherwise(F.concat(F.lit(" a\t"), F.col("o_orderpriority"), F.lit("  b "))).alias("note"),
        F.lit("--").alias("none"), F.lit("none").alias("gone"),
    )


@query("""
  WITH d AS (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS amount,
           CASE WHEN o_orderkey % 7 <> 0 THEN lower(o_orderstatus) END AS status,
           CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS flag,
           CASE WHEN o_orderkey % 13 <> 0 THEN 'a ' || o_orderpriority || ' b' END AS note FROM orders)
  SELECT k AS o_orderkey, coalesce(amount, (SELECT median(amount) FROM d)) AS amount,
         coalesce(status, (SELECT status FROM d WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, min(k) LIMIT 1)) AS status,
         coalesce(day, (SELECT day FROM d WHERE day IS NOT NULL GROUP BY day ORDER BY count(*) DESC, min(k) LIMIT 1)) AS day,
         CAST(coalesce(flag, (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, min(k) LIMIT 1)) AS INTEGER) AS flag,
         note, '' AS none, CAST(NULL AS DOUBLE) AS gone FROM d""")
def clean_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies that are taken where none is named, one column of every type, and columns without any value."""
    rows = cleaning.clean(_dirty_orders(spark, sf_dir), DEFAULT_TYPES).rows.drop(ROW)
    return rows.withColumn("flag", F.col("flag").cast("int"))


@query("""
  WITH o AS (SELECT o_orderkey AS k, * FROM orders)
  SELECT operation, "column", count(*) AS n FROM (
    SELECT unnest([
      CASE WHEN k % 9 = 0 THEN 'fill_missing/amount' ELSE 'standardize_numeric/amount' END,
      CASE WHEN k % 7 = 0 THEN 'fill_missing/status' ELSE 'normalize_categorical/status' END,
      CASE WHEN k % 11 = 0 THEN 'fill_missing/day' ELSE 'standardize_date/day' END,
      CASE WHEN k % 5 = 0 THEN 'fill_missing/flag' ELSE 'standardize_boolean/flag' END,
      'fill_missing/none', 'fill_missing/gone']) AS change FROM o),
    LATERAL (SELECT split_part(change, '/', 1) AS operation, split_part(change, '/', 2) AS "column")
  GROUP BY ALL""")
def change_log_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cleaning.clean(_dirty_orders(spark, sf_dir), DEFAULT_TYPES).change_log
    return log.groupBy("operation", "column").agg(F.count(F.lit(1)).alias("n"))


@query("""
  WITH d AS (
    SELECT event_id, user_id % 20 = 0 AS hot, CASE WHEN user_id % 20 = 0 THEN NULL ELSE user_id END AS u,
           CASE WHEN event_id % 7 = 0 THEN 'gap' WHEN event_id % 13 = 0 THEN 'broken' ELSE 'value' END AS kind, value,
           CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events)
  SELECT event_id, u AS user_id,
         round(CASE kind WHEN 'value' THEN value WHEN 'gap' THEN
           last_value(CASE WHEN kind <> 'gap' THEN {'v': CASE WHEN kind = 'value' THEN value END} END IGNORE NULLS)
             OVER (PARTITION BY u ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).v END, 6) AS value,
         coalesce(event_type, first_value(event_type IGNORE NULLS) OVER (PARTITION BY u ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS event_type
  FROM d""")
def forward_fill_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that stay within a user; a twentieth of the users is one missing user, a key that is cut into segments."""
    k = F.col("event_id")
    df = events(spark, sf_dir).select(
        ROW, "event_id", F.when(F.col("user_id") % 20 != 0, F.col("user_id")).alias("user_id"),
        F.when(k % 7 == 0, "N/A").when(k % 13 == 0, "broken").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(k % 5 != 0, F.col("event_type")).alias("event_type"),
    )
    config = Config(missing_value_overrides={"value": "forward_fill", "event_type": "back_fill"})
    types = {"value": "numeric", "event_type": "categorical"}
    rows = cleaning.clean(df, types, config, bucket_rows=1_000, partition_by=["user_id"]).rows
    return rounded(rows.select("event_id", "user_id", "value", "event_type"), 6, "value")


# Findings and insights -----------------------------------------------------------------------------


def _doubtful_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is half numbers, half long texts, one with gaps, and repeated rows."""
    k = F.col("o_orderkey")
    return orders(spark, sf_dir).select(
        ROW,
        F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.repeat(F.lit("long text "), 5), k.cast("string"))).alias("mixed"),
        F.when(k % 4 == 0, None).otherwise((k % 50).cast("string")).alias("amount"),
    ).unionByName(orders(spark, sf_dir).filter(k % 10 == 0).select((F.col(ROW) + 10**12).alias(ROW), k.cast("string").alias("mixed"), F.when(k % 4 == 0, None).otherwise((k % 50).cast("string")).alias("amount")))


def _bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).filter("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("line_number"))


DOUBTFUL_SQL = """
  WITH d AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0),
  n AS (SELECT count(*) AS n, count(*) FILTER (k % 4 = 0) AS gaps, count(*) FILTER (k % 2 = 0) / count(*)::DOUBLE AS conf,
               (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 3) AS bad, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS copies FROM d)"""


@query(DOUBTFUL_SQL + """
  SELECT 'warning' AS severity, 'malformed_rows' AS code, 'Detected ' || bad || ' malformed row(s) during ingestion.' AS message, NULL AS "column", 'malformed_rows=' || bad AS details FROM n
  UNION ALL SELECT 'warning', 'duplicate_rows', 'Detected ' || copies || ' duplicate record(s).', NULL, 'duplicate_rows=' || copies FROM n
  UNION ALL SELECT CASE WHEN gaps / n::DOUBLE < 0.1 THEN 'info' ELSE 'warning' END, 'missing_values', 'Column ''amount'' contains ' || gaps || ' missing value(s) out of ' || n || ' row(s).', 'amount',
    'missing_count=' || gaps || ' missing_rate=' || round(gaps / n::DOUBLE, 6) FROM n
  UNION ALL SELECT 'info', 'low_schema_confidence', 'Schema confidence for ''mixed'' is only ' || printf('%.2f', conf) || '.', 'mixed', '' FROM n""")
def findings_dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed and repeated rows, gaps and a doubtful type, with the details of each finding."""
    df = _doubtful_orders(spark, sf_dir)
    found = profile(df)
    issues = quality.findings(found, quality.quality(df, _bad_lines(spark, sf_dir)), outliers.outliers(df, column_types(found)))
    rate = F.when(F.col("details")["missing_rate"].isNotNull(), F.round(F.col("details")["missing_rate"].cast("double"), 6).cast("string"))
    shown = F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), F.when(e["key"] == "missing_rate", rate).otherwise(e["value"])))
    return issues.select("severity", "code", "message", "column", F.array_join(shown, " ").alias("details"))


@query(DOUBTFUL_SQL + """
  SELECT unnest(['Missing values are concentrated in amount; imputation or source cleanup is likely needed.',
    'The dataset contains ' || copies || ' duplicate record(s).',
    'Schema confidence is weak for mixed, so those columns should be reviewed manually.',
    bad || ' malformed row(s) were repaired or truncated during ingestion.']) AS text, 'risks' AS section FROM n
  UNION ALL SELECT 'No strong correlations or trends crossed the reporting threshold, so the data appears relatively flat.', 'key_drivers' FROM n
  UNION ALL SELECT 'Add source-side validation to prevent malformed or duplicate rows from entering the pipeline.', 'recommended_actions' FROM n""")
def insights_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risks of a doubtful table, and the action that only such a table calls for."""
    df = _doubtful_orders(spark, sf_dir)
    return _sections(_insights(df, _bad_lines(spark, sf_dir)), skip=3)


def _insights(df: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    found = profile(df)
    types = column_types(found)
    return insights(
        quality.quality(df, malformed), found, outliers.outliers(df, types), stats.correlations(df, types), trend.trends(df, types), models.model(df, types)
    )


def _sections(report: DataFrame, skip: int = 0) -> DataFrame:
    """(text, section); the first ``skip`` actions, which stand in every report, are left out."""
    actions = F.slice("recommended_actions", skip + 1, F.greatest(F.size("recommended_actions") - skip, F.lit(0)))

    def named(section: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(section).alias("section")))

    every = F.concat(named("key_drivers", F.col("key_drivers")), named("risks", F.col("risks")), named("recommended_actions", actions))
    return report.select(F.explode(every).alias("own")).select("own.*")


@query("""
  WITH n AS (SELECT count(*) AS n, count(DISTINCT r_name) AS u FROM region WHERE r_regionkey <> 0)
  SELECT 'risks' AS section, unnest(['The dataset is very small, so correlations and models may be unstable.',
    'Single-column inputs limit correlation and segmentation analysis.']) AS text FROM n WHERE n < 10
  UNION ALL SELECT 'key_drivers', 'No strong correlations or trends crossed the reporting threshold, so the data appears relatively flat.' FROM n
  UNION ALL SELECT 'risks', 'Schema confidence is weak for r_name, so those columns should be reviewed manually.' FROM n WHERE greatest(0.5, 1.5 - u / n::DOUBLE) < 0.65
  UNION ALL SELECT 'recommended_actions', 'Collect more history before relying on trend or regression output for decisions.' FROM n WHERE n < 50""")
def insights_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of one column and a few rows."""
    df = table(spark, sf_dir, "region").filter("r_regionkey <> 0").select((F.col("r_regionkey") + 1).alias(ROW), "r_name")
    return _sections(_insights(df), skip=3)


@query("""
  SELECT 'executive_summary' AS section, 'The uploaded CSV contains no data rows, so no statistical insights can be generated.' AS text FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'risks', 'The file is empty or only contains a header row.' FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'recommended_actions', 'Provide at least one populated data row and rerun the pipeline.' FROM region WHERE r_regionkey = 0""")
def insights_no_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row of a table is left."""
    df = table(spark, sf_dir, "region").filter("r_regionkey < 0").select((F.col("r_regionkey") + 2).alias(ROW), "r_name")
    report = _insights(df)
    summary = report.select(F.col("executive_summary").alias("text"), F.lit("executive_summary").alias("section"))
    return _sections(report).unionByName(summary)


# Charts and sketches -------------------------------------------------------------------------------


@query("""
  SELECT o_totalprice AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders ORDER BY md5(CAST(o_orderkey + 2 AS VARCHAR)) LIMIT 500""")
def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred points that stand for all."""
    return charts.scatter_points(orders(spark, sf_dir), "o_totalprice", "o_custkey", max_points=500).select("a", "b")


@query("""
  WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b FROM lineitem),
  e AS (SELECT min(a) AS la, max(a) / 20 - min(a) / 20 AS wa, min(b) AS lb, max(b) / 20 - min(b) / 20 AS wb FROM p)
  SELECT CAST(least(floor((a - la) / wa), 19) AS INTEGER) AS bin_a, CAST(least(floor((b - lb) / wb), 19) AS INTEGER) AS bin_b,
         round(any_value(la + CAST(least(floor((a - la) / wa), 19) AS INTEGER) * wa), 4) AS a_start,
         round(any_value(lb + (CAST(least(floor((b - lb) / wb), 19) AS INTEGER) + 1) * wb), 4) AS b_end, count(*) AS n
  FROM p, e GROUP BY 1, 2""")
def scatter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points, counted in cells."""
    found = charts.scatter_grid(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(found, 4, "a_start", "b_end").select("bin_a", "bin_b", "a_start", "b_end", F.col("count").alias("n"))


SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 0 AS near, true AS merged_is_whole FROM lineitem" for c in SKETCHED))
def distinct_sketch_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates lie within 2 % of the exact counts, and those of two halves merged are those of the whole."""
    df = table(spark, sf_dir, "lineitem")
    even = F.col("l_orderkey") % 2 == 0
    whole = distinct_estimates(distinct_sketches(df, SKETCHED))
    halves = [distinct_sketches(df.filter(half), SKETCHED) for half in (even, ~even)]
    merged = distinct_estimates(merge_sketches(*halves)).select("column", F.col("distinct_estimate").alias("merged"))
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED]).unpivot([], SKETCHED, "column", "exact")
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) <= 0.02 * F.col("exact")
    # Merged sketches are unions of registers, which round a little differently.
    same = F.abs(F.col("merged") - F.col("distinct_estimate")) <= 0.02 * F.col("exact")
    return whole.join(merged, "column").join(exact, "column").select("column", near.alias("near"), same.alias("merged_is_whole"))


_MANY = [("c_custkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical")]


def _many_sql(column: str, kind: str) -> str:
    m, u = f"count({column})", f"count(DISTINCT {column})"
    facts = ("min", "max", "avg", "median", "stddev_samp")
    numbers = [f"round({f}({column}), 4)" if kind == "numeric" else "CAST(NULL AS DOUBLE)" for f in facts]
    confidence = "1.0" if kind == "numeric" else f"round(greatest(0.5, least(1.0, 1.5 - {u} / {m}::DOUBLE)), 4)"
    named = ", ".join(f"{sql} AS numeric_{name}" for sql, name in zip(numbers, ("min", "max", "mean", "median", "stddev")))
    return (
        f"SELECT CAST(c_nationkey AS VARCHAR) AS dataset, '{column}' AS \"column\", '{kind}' AS detected_type, {confidence} AS confidence, "
        f"{m} AS non_missing_count, {u} AS distinct_count, {named} FROM customer GROUP BY c_nationkey"
    )


@query(" UNION ALL ".join(_many_sql(*column) for column in _MANY))
def profile_many_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of every nation as a table of its own, profiled together."""
    found = profile_datasets(table(spark, sf_dir, "customer"), "c_nationkey", [c for c, _ in _MANY])
    numbers = ["numeric_min", "numeric_max", "numeric_mean", "numeric_median", "numeric_stddev"]
    found = rounded(found, 4, "confidence", *numbers)
    return found.select("dataset", "column", "detected_type", "confidence", "non_missing_count", "distinct_count", *numbers)
