import csv
import io
import os
import random

import pytest

from tabsight.config import Config, FilterSpec
from tabsight.plans.run import run
from tabsight.sources.csv import SourceError, audit_files, column_names, scan_csv
from tabsight.sources.staging import first_rows, number_rows


@pytest.fixture
def write(tmp_path):
    def make(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return make


def cells(scan):
    return [tuple(r[c] for c in scan.headers) for r in scan.rows.orderBy("_row").collect()]


def test_shapes_blank_records_and_malformed_rows(spark, write):
    text = 'a,b,c\n1,2,3\n\n   \n , , \n4,5\n6,7,8,9\n"x,y","q""r",""\n,,,z\n 7 ,8,9\n'
    scan = scan_csv(spark, write("shapes.csv", b"\xef\xbb\xbf" + text.encode()))
    assert cells(scan) == [
        ("1", "2", "3"), ("4", "5", None), ("6", "7", "8"), ("x,y", 'q"r', None), (None, None, None), (" 7 ", "8", "9"),
    ]
    assert [r["_row"] for r in scan.rows.orderBy("_row").collect()] == [2, 3, 4, 5, 6, 7]
    bad = [tuple(r)[1:] for r in scan.malformed.orderBy("line_number").collect()]
    assert bad == [(6, 3, 2, "4,5"), (7, 3, 4, "6,7,8,9"), (9, 3, 4, ",,,z")]
    assert scan.rows.select("a", "_row").join(scan.malformed).count() == 18  # a column subset hides nothing


def test_quoted_line_breaks(spark, write):
    scan = scan_csv(spark, write("multi.csv", 'a,b\n1,"line1\nline2"\n2,"x"\n3\n'))
    assert cells(scan) == [("1", "line1\nline2"), ("2", "x"), ("3", None)]
    assert scan.malformed.first()["actual_fields"] == 1


@pytest.mark.parametrize(
    "content, encoding, cell",
    [
        ("a;b\n1;é\n2;x\n".encode(), "utf-8", "é"),
        ("a;b\n1;é\n2;x\n".encode("cp1252"), "cp1252", "é"),
        (b"a;b\n1;\x81\n2;x\n", "latin-1", "\x81"),
        ("a;b\n1;é\n2;x\n".encode("utf-16"), "utf-16", "é"),
        ("a;b\n1;é\n2;x\n".encode("utf-32"), "utf-32", "é"),
    ],
)
def test_encodings(spark, write, content, encoding, cell):
    scan = scan_csv(spark, write("f.csv", content))
    assert scan.audit.first()["encoding"] == encoding
    assert cells(scan) == [("1", cell), ("2", "x")]


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_delimiters(spark, write, delimiter):
    path = write("f.csv", f"a{delimiter}b\n1{delimiter}2\n{delimiter}\n3{delimiter}4\n")
    scan = scan_csv(spark, path)
    assert scan.audit.first()["delimiter"] == delimiter
    assert cells(scan) == [("1", "2"), ("3", "4")]
    named = scan_csv(spark, path, delimiter=delimiter, encoding="utf-8", multi_line=False)
    assert cells(named) == cells(scan)


def test_headers(spark, write):
    scan = scan_csv(spark, write("h.csv", " a ,a,,b\n1,2,3,4\n"))
    assert scan.headers == ["a", "a__2", "column_3", "b"] and cells(scan) == [("1", "2", "3", "4")]
    assert {f["code"] for f in scan.findings.collect()} == {"duplicate_header", "blank_header"}
    assert column_names(["x", "x", "x"]) == ["x", "x__2", "x__3"]


@pytest.mark.parametrize(
    "name, content, message",
    [
        ("not_csv.txt", "name\nvalue\n", "Unsupported file type '.txt'"),
        ("empty.csv", "", "is empty"),
        ("blank.csv", " , \n1,2\n", "usable header"),
    ],
)
def test_refused_files(spark, write, name, content, message):
    with pytest.raises(SourceError, match=message):
        scan_csv(spark, write(name, content))


def test_missing_file_and_upper_case_suffix(spark, write, tmp_path):
    with pytest.raises(SourceError, match="not found"):
        scan_csv(spark, str(tmp_path / "none.csv"))
    assert audit_files(spark, write("f.CSV", "a\n1\n")).first()["error"] is None


@pytest.mark.parametrize("odd", ["\x85", "\u2028", "\x0b", "\x0c", "\x1c"])
def test_only_line_ends_end_records(spark, write, odd):
    """Breaks that are no line ends stay in header names, cells and malformed records."""
    scan = scan_csv(spark, write("odd.csv", f"id,na{odd}me,z\n1,x{odd}y,q\n2,x{odd}y\n3,a,b{odd}c,d\n"))
    assert scan.headers == ["id", f"na{odd}me", "z"]
    assert [tuple(r)[1:] for r in scan.rows.orderBy("_row").collect()][0] == ("1", f"x{odd}y", "q")
    found = [(r["line_number"], r["actual_fields"]) for r in scan.malformed.orderBy("line_number").collect()]
    assert found == [(3, 2), (4, 4)]


def test_numbers_hold_across_files_and_splits(spark, write, tmp_path):
    n = 0
    for f in range(3):
        lines = ["id,v"]
        for i in range(3000):
            if i % 7 == 0:
                lines.append(["", "  ", ","][i % 3])
            else:
                lines.append(f"{n},{i}")
                n += 1
        write(f"many/f{f}.csv", "\n".join(lines) + "\n")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        scan = scan_csv(spark, str(tmp_path / "many"))
        assert scan.rows.rdd.getNumPartitions() > 6
        wrong = scan.rows.filter("cast(id AS bigint) + 2 <> _row").count()
        assert (scan.rows.count(), wrong) == (n, 0)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_files_of_different_layout_union(spark, write, tmp_path):
    write("mix/a.csv", "x,y\n1,2\n3,4\n")
    write("mix/b.csv", "y;z\n5;é\n6;f\n".encode("cp1252"))
    scan = scan_csv(spark, str(tmp_path / "mix"))
    assert scan.headers == ["x", "y", "z"]
    assert cells(scan) == [("1", "2", None), ("3", "4", None), (None, "5", "é"), (None, "6", "f")]


def test_number_rows_by_keys(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k").repartition(7)
    numbered = number_rows(df, ["k"])
    assert numbered.filter("k + 2 <> _row").count() == 0


def test_run_writes_every_report(spark, write, tmp_path):
    rows = "".join(
        f"{i},{['North', 'south ', 'N/A'][i % 3]},{'' if i % 5 == 0 else '$' + str(i * 3)},2026-01-{i % 28 + 1:02d}\n"
        for i in range(60)
    )
    path = write("in/sales.csv", "id,region,amount,when\n" + rows + "1,2\n")
    config = Config(
        output_directory=str(tmp_path / "out"),
        missing_value_overrides={"region": "constant"},
        fill_values={"region": "unknown"},
        slice_filters=[FilterSpec("region", "not_equals", "south")],
    )
    result = run(spark, path, config)
    assert result.success, result.errors
    assert result.types == {"id": "numeric", "region": "categorical", "amount": "numeric", "when": "date"}
    assert result.cleaned.count() == 61 and result.cleaned.filter("region = 'unknown'").count() == 20
    assert result.tables["segments"].filter("value = 'south'").count() == 0
    assert result.tables["quality"].first()["malformed_row_count"] == 1
    assert [r["stage"] for r in result.tables["timings"].collect()] == [
        "ingestion", "validation", "cleaning", "analysis", "visualization", "insights", "reporting",
    ]
    for name in ("cleaned", "change_log", "quality", "insights", "run_summary", "chart_plan"):
        assert os.path.isdir(result.output_paths[name])
    assert spark.read.json(result.output_paths["run_summary"]).first()["success"] is True
    assert any("slice filter" in w for w in result.warnings)


def test_run_on_header_only_and_single_column(spark, write):
    empty = run(spark, write("e/empty.csv", "name,amount\n"))
    assert empty.success, empty.errors
    assert empty.tables["quality"].first()["row_count"] == 0
    assert empty.tables["insights"].first()["risks"] == ["The file is empty or only contains a header row."]
    single = run(spark, write("s/single.csv", "amount\n10\n20\n30\n"))
    assert single.success and single.tables["correlations"].count() == 0
    assert single.tables["quality"].first()["column_count"] == 1


def test_run_reports_failure(spark, write, tmp_path):
    result = run(spark, write("x.txt", "a\n1\n"), Config(output_directory=str(tmp_path / "out")))
    assert not result.success and "Unsupported file type" in result.errors[0]
    assert result.timings[0][2] == "error"
    assert spark.read.json(result.output_paths["run_summary"]).first()["success"] is False


def plain_records(text, delimiter=","):
    """(record number, cells) of a well-formed text, blank ones left out, empty cells as None."""
    for number, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
        if any(cell.strip() for cell in row):
            yield number, tuple(cell or None for cell in row)


def quoted_file(seed, rows, end="\n"):
    """Quoted cells with line ends, delimiters and doubled quotes, stray quotes within plain cells, blank and short records."""
    rng = random.Random(seed)
    pieces = ["x", "y z", ",", '""', end, end + end, "5,5", "ä", "'", '""a,""' + end]
    lines = ['id,"no' + end + 'te",size']
    for i in range(rows):
        kind = rng.random()
        note = '"' + "".join(rng.choice(pieces) for _ in range(rng.randrange(9))) + '"' if kind < 0.6 else rng.choice(['5" pipe', "plain", "", "it's"])
        lines.append(rng.choice(["", "  ", f"{i},{note}", f"{i},{note},1,more"]) if rng.random() < 0.15 else f'{i},{note},{rng.randrange(99)}')
    return end.join(lines) + end


@pytest.mark.parametrize(("seed", "end", "size"), [(1, "\n", 150), (2, "\r\n", 400), (3, "\n", 37), (4, "\n", 10**6), (5, "\r", 10**6)])
def test_quoted_records_across_splits(spark, write, tmp_path, seed, end, size):
    texts = [quoted_file(10 * seed + k, 120, end) for k in range(3)]
    for k, text in enumerate(texts):
        write(f"q{seed}/f{k}.csv", text)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        scan = scan_csv(spark, str(tmp_path / f"q{seed}"))
        assert {r["multi_line"] for r in scan.audit.collect()} == {True}
        got = cells(scan)
        assert [r["_row"] for r in scan.rows.select("_row").orderBy("_row").collect()] == list(range(2, len(got) + 2))
        bad = sorted((r["dataset"][-6:], r["line_number"], r["actual_fields"]) for r in scan.malformed.collect())
        if size < 1000:
            assert scan.rows.rdd.getNumPartitions() > 3
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    want, wrong = [], []
    for k, text in enumerate(texts):
        records = list(plain_records(text))
        assert records[0][1] == ("id", f"no{end}te", "size")
        want += [(row + (None, None))[:3] for _, row in records[1:]]
        wrong += [(f"f{k}.csv", number, len(row)) for number, row in records[1:] if len(row) != 3]
    assert got == want and bad == wrong


def test_one_cell_over_many_splits_and_an_open_one(spark, write):
    long = "\n".join(f"line {i}, with a comma" for i in range(200))
    text = f'a,b\n1,"{long}"\n2,x\n3,"never closed\n4,y\n5,z'
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = cells(scan_csv(spark, write("long.csv", text)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert got[:2] == [("1", long), ("2", "x")] and got[2][0] == "3" and "never closed\n4,y\n5,z" in got[2][1] and len(got) == 3


def test_a_stray_quote_keeps_lines_apart(spark, write):
    scan = scan_csv(spark, write("stray.csv", 'id,what\n1,5" pipe\n2,an "odd" one\n3,x"\n'))
    assert scan.audit.first()["multi_line"] is False
    assert cells(scan) == [("1", '5" pipe'), ("2", 'an "odd" one'), ("3", 'x"')]


def test_the_audit_reads_the_text_once(spark, write):
    audit = audit_files(spark, write("one.csv", 'a,b\n1,"x\ny"\n'))
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_first_rows_read_only_their_files(spark, tmp_path):
    path = tmp_path / "my parts"
    for k in range(20):
        spark.range(k * 50, k * 50 + 50).repartition(1).write.parquet(str(path / f"p{k:02d}"))
    schema = spark.read.parquet(str(path / "p00")).schema
    paths = [str(p) for p in sorted(path.glob("p*/*.parquet"))]
    df = spark.read.schema(schema).parquet(*paths)
    # Files that a head does not need may be unreadable.
    for late in paths[8:]:
        os.chmod(late, 0o644)
        with open(late, "wb") as file:
            file.write(b"no parquet")
    head = first_rows(df, 120)
    assert sorted(tuple(r) for r in head.collect()) == [(i, i + 2) for i in range(120)]
    assert first_rows(spark.range(30).selectExpr("id * 2 AS x"), 5).count() == 5
    assert first_rows(df.limit(0).select("id"), 5).count() == 0
