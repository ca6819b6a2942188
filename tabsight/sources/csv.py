"""CSV audit and scan.

Records are read as lines (``spark.read.text``), which split across tasks,
keep blank lines countable and hand the raw bytes to the decoder; cells are
cut by Spark's own CSV parser (``from_csv``).

Records that span lines stay splittable. A line maps the state before it, outside or
inside a quoted cell, to the state after it; a split is the composition of its
lines' maps, and a running composition over the splits of a file gives every
split the state it begins in. Tasks then join the lines of their records; the
few pieces that cross a split's border are stitched by the table of splits.
Only UTF-16 and UTF-32, which have no line ends of one byte, go through the
multi-line CSV reader.
"""

from __future__ import annotations

import csv as _csv
import io
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.errors import AnalysisException

from tabsight.config import FIRST_ROW, INFO, ROW, WARNING, Config, field_names, fields
from tabsight.functions.cells import WHITESPACE, character_ranges, strip
from tabsight.sources.local import local_frame
from tabsight.sources.staging import POSITION_BITS, cut_lineage, prepare_session, split_table

AUDIT_SCHEMA = (
    "path string, length long, encoding string, delimiter string, quote string, skip_initial_space boolean, "
    "header array<string>, multi_line boolean, error string"
)
MALFORMED_SCHEMA = (
    "dataset string, line_number long, expected_fields int, actual_fields int, raw_preview string"
)
INGEST_SCHEMA = (
    "severity string, code string, message string, line_number long, details map<string,string>"
)

# Delimiters considered, characters sniffed, bytes cp1252 leaves undefined.
DELIMITERS = ",;\t|"
SNIFF_CHARS = 8_192
CP1252_GAPS = r"[\x81\x8d\x8f\x90\x9d]"

_PREVIEW_CELLS = 5
#: Files whose errors are named when a scan is refused.
MOST_ERRORS = 20
_JAVA_CHARSET = {"cp1252": "windows-1252", "latin-1": "ISO-8859-1"}


class SourceError(ValueError):
    """The input cannot be accepted as CSV."""


@dataclass(frozen=True)
class CsvScan:
    """Lazy results of :func:`scan_csv`."""

    rows: DataFrame
    malformed: DataFrame
    findings: DataFrame
    headers: list[str]
    audit: DataFrame


def list_files(spark: SparkSession, path) -> DataFrame:
    """(path, length) of every file; the content is not read."""
    paths = path if isinstance(path, list) else [path]
    try:
        return spark.read.format("binaryFile").load([str(p) for p in paths]).select("path", "length")
    except AnalysisException as exc:
        raise SourceError(f"File not found: {', '.join(map(str, paths))}") from exc


def _lines(spark: SparkSession, path, line_feeds_only: bool = False) -> DataFrame:
    """Lines of the accepted files; the reader's own filter leaves out other files that lie beside them."""
    reader = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]")
    reader = reader.option("lineSep", "\n") if line_feeds_only else reader
    return reader.text([str(p) for p in (path if isinstance(path, list) else [path])]).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )


def _quote_patterns(delimiter: str, quote: str, skip: bool) -> tuple[str, str]:
    """Patterns of a line that ends inside a quoted cell: begun outside of one, and begun inside.

    A quote opens a cell only where the cell begins; one elsewhere is a sign like others.
    """
    q, d = rf"\x{{{ord(quote):x}}}", rf"\x{{{ord(delimiter):x}}}"
    lead = r"\x20*+" if skip else ""
    inside, rest = rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+", rf"[^{d}]*+"
    cells = rf"(?:{lead}(?:{q}{inside}{q}{rest}|(?!{q}){rest}){d})*+"
    opened = rf"{cells}{lead}{q}{inside}\z"
    return rf"^{opened}", rf"^{inside}(?:\z|{q}{rest}{d}{opened})"


def _layout_bits(delimiter: str | None) -> list[tuple[str, str, bool]]:
    """The layouts that a sniffed sample may name; the place of each is its bit."""
    return [(d, q, skip) for d in (delimiter or DELIMITERS) for q in "\"'" for skip in (False, True)]


def _opens(value: Column, delimiter: str | None) -> Column:
    """For each layout a bit: does the line, begun outside a quoted cell, end inside one?

    The first such line of a file is begun outside, as all before it end there: a file has records over several lines
    if and only if it has such a line.
    """
    bits = F.lit(0)
    for k, (d, q, skip) in enumerate(_layout_bits(delimiter)):
        near = value.rlike(rf"(?:^|\x{{{ord(d):x}}}){' *' if skip else ''}{q}")
        found = F.when(near & value.rlike(_quote_patterns(d, q, skip)[0]), 1 << k).otherwise(0)
        bits = bits.bitwiseOR(found)
    return F.when(value.contains('"') | value.contains("'"), bits).otherwise(0)


def _block_facts(sample_bytes: int):
    """One row per file block: facts of all its lines, and the first lines of a file. Built by value for the workers."""

    def fold(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["path", "is_utf8", "is_cp1252", "opens", "sample"]

        def row(key, state):
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((key[0], *state[:3], state[3]), (pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], names=names
            )

        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, block, utf8, cp1252, opens, value = batch.columns
            changes = pc.or_(pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)), pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)))
            begins = [0, *(pc.indices_nonzero(changes).to_numpy() + 1).tolist(), batch.num_rows]
            for begin, end in zip(begins, begins[1:]):
                own = (path[begin].as_py(), block[begin].as_py())
                if own != key:
                    if key:
                        yield row(key, state)
                    key, state = own, [True, True, 0, b"" if own[1] == 0 else None, False]
                size = end - begin
                state[0] &= pc.all(utf8.slice(begin, size)).as_py()
                state[1] &= pc.all(cp1252.slice(begin, size)).as_py()
                for bits in pc.unique(opens.slice(begin, size)).to_pylist():
                    state[2] |= bits
                at = begin
                while state[3] is not None and len(state[3]) < sample_bytes and at < end:
                    line = value[at].as_py()
                    # The header line is kept whole, however long it is.
                    state[3] = state[3] + b"\n" + line[:sample_bytes] if state[4] else line
                    state[4], at = True, at + 1
        if key:
            yield row(key, state)

    return fold


def _sniffer():
    """One row per file: delimiter, quote and header from the first lines.

    Built inside a function so that workers get it by value and need no copy
    of this package.
    """

    def read(path: str, opens: int, sample: bytes, encoding: str, given: str | None) -> tuple:
        text = sample.decode(encoding, errors="replace").lstrip("\ufeff")
        try:
            dialect = _csv.Sniffer().sniff(text[:SNIFF_CHARS], delimiters=list(DELIMITERS))
            delimiter, quote, skip = dialect.delimiter, dialect.quotechar or '"', dialect.skipinitialspace
        except _csv.Error:
            delimiter, quote, skip = ",", '"', False
        delimiter = given or delimiter
        # Records end at line feeds and carriage returns only, not at the other breaks that splitlines() knows.
        reader = _csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote, skipinitialspace=skip)
        header = [h.strip() for h in next(reader, [])]
        name = path.rsplit("/", 1)[-1]
        error = None if any(header) else f"CSV file '{name}' does not contain a usable header row."
        return path, opens, encoding, delimiter, quote, skip, header, error

    def sniff(batches):
        for pdf in batches:
            records = [read(r.path, r.opens, bytes(r.sample), r.encoding, r.delimiter or None) for r in pdf.itertuples()]
            yield pd.DataFrame(
                records, columns=["path", "opens", "encoding", "delimiter", "quote", "skip_initial_space", "header", "error"]
            )

    return sniff


def audit_files(
    spark: SparkSession,
    path,
    config: Config = Config(),
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """One row per file: size, encoding, layout, header, or why it is refused.

    One splittable pass over the lines gives each file block a mergeable
    state: which encodings read it, whether a line opens a quoted cell that it
    does not close (for every layout that the sample may name), and the first
    lines. Naming ``encoding`` and ``multi_line`` leaves out their part.
    """
    prepare_session(spark)
    unknown = [e for e in config.encoding_candidates if e not in ("utf-8", "utf-8-sig", "cp1252", "latin-1")]
    if unknown:
        raise ValueError(f"Unsupported encoding candidates: {unknown}")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    shown = F.when(suffix == "", "<none>").otherwise(suffix)
    refused = F.when(
        suffix != ".csv",
        F.concat(F.lit("Unsupported file type '"), shown, F.lit("'. Only .csv files are accepted.")),
    )
    files = list_files(spark, path).withColumn("refused", refused)
    if files.filter(F.col("refused").isNull()).isEmpty():
        return files.select(
            "path", "length", *[F.lit(None).cast(t).alias(n) for n, t in fields(AUDIT_SCHEMA)[2:-1]],
            F.col("refused").alias("error"),
        )
    lines = _lines(spark, path)
    value = F.col("value")
    as_bytes = F.decode(value.cast("binary"), "ISO-8859-1")
    known = encoding is not None
    facts = lines.select(
        F.col("_path"), F.col("_block"),
        (F.lit(True) if known else F.is_valid_utf8("value")).alias("is_utf8"),
        (F.lit(True) if known else ~as_bytes.rlike(CP1252_GAPS)).alias("is_cp1252"),
        # Patterns need valid text; a byte is a letter here.
        (F.lit(0) if multi_line is not None else _opens(as_bytes, delimiter)).alias("opens"),
        # Of the later blocks no text is handed on.
        F.when(F.col("_block") == 0, value.cast("binary")).alias("value"),
    )
    # Lines until the sniffed characters are full in any encoding (4 bytes at most).
    blocks = facts.mapInArrow(_block_facts(4 * SNIFF_CHARS), "path string, is_utf8 boolean, is_cp1252 boolean, opens int, sample binary")
    merged = blocks.groupBy("path").agg(
        F.bool_and("is_utf8").alias("is_utf8"), F.bool_and("is_cp1252").alias("is_cp1252"), F.bit_or("opens").alias("opens"), F.max("sample").alias("sample")
    )
    sniffed = merged.select("*", _encoding(config, encoding).alias("encoding"), F.lit(delimiter or "").alias("delimiter")).mapInPandas(
        _sniffer(), "path string, opens int, encoding string, delimiter string, quote string, skip_initial_space boolean, header array<string>, error string"
    )
    bit = F.lit(0)
    for k, (d, q, skip) in enumerate(_layout_bits(delimiter)):
        own = (F.col("delimiter") == d) & (F.col("quote") == q) & (F.col("skip_initial_space") == skip)
        bit = F.when(own, F.col("opens").bitwiseAND(1 << k)).otherwise(bit)
    spans = (bit != 0) if multi_line is None else F.lit(multi_line)
    # The scan reports paths as URIs and the listing does too, so they join as text.
    empty = F.when(F.col("length") == 0, F.format_string("CSV file '%s' is empty.", name))
    return (
        files.join(sniffed, "path", "left")
        .select(
            "path", "length", "encoding", "delimiter", "quote", "skip_initial_space", "header",
            (spans | _is_wide(F.col("encoding"))).alias("multi_line"), F.coalesce("refused", "error", empty).alias("error"),
        )
    )


def _is_wide(encoding: Column) -> Column:
    return encoding.startswith("utf-16") | encoding.startswith("utf-32")


def _encoding(config: Config, given: str | None) -> Column:
    """A file's encoding by its marks, else the first candidate that reads all its lines, else UTF-8."""
    if given:
        return F.lit(given)
    mark = F.hex(F.substring("sample", 1, 4))
    marked = F.when(mark.startswith("FFFE0000") | mark.startswith("0000FEFF"), "utf-32").when(
        mark.startswith("FFFE") | mark.startswith("FEFF"), "utf-16"
    )
    detected = F.lit(None).cast("string")
    for candidate in reversed(config.encoding_candidates):
        fits = {"cp1252": F.col("is_cp1252"), "latin-1": F.lit(True)}.get(candidate, F.col("is_utf8"))
        label = "utf-8" if candidate.startswith("utf-8") else candidate
        detected = F.when(fits, label).otherwise(detected)
    return F.coalesce(marked, detected, F.lit("utf-8"))


def column_names(header: list[str]) -> list[str]:
    """Unique column names: blanks become ``column_N``, later copies ``name__2``."""
    seen: dict[str, int] = {}
    names = []
    for i, h in enumerate(header):
        name = h or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    return names


def _blank_record(raw: Column, delimiter: str, quote: str) -> Column:
    """Whether every cell of the raw record is empty or whitespace."""
    space = character_ranges(WHITESPACE)
    free = character_ranges(WHITESPACE.replace(delimiter, ""))
    q, d = rf"\x{{{ord(quote):x}}}", rf"\x{{{ord(delimiter):x}}}"
    cell = rf"(?:[{free}]*+(?:{q}[{space}]*+{q})?[{free}]*+)"
    return raw.rlike(rf"^{cell}(?:{d}{cell})*+$")


@dataclass(frozen=True)
class _Scan:
    """Raw records of the files of one layout: ``_path``, ``_block`` they begin in, ``_mid``, ``_cells``; ``kept`` tells
    which are no blank ones. ``crossing`` are those that cross a split's border, the last ones of their blocks."""

    layout: object
    frame: DataFrame
    kept: Column
    crossing: DataFrame | None = None


def _cells(layout, text: Column) -> Column:
    width = len(layout["header"])
    return F.from_csv(text, _cell_schema(width), {**_csv_options(layout), "multiLine": str(layout["multi_line"]).lower()})


def _cell_schema(width: int) -> str:
    return ", ".join([*(f"c{i} string" for i in range(width)), "_corrupt string"])


def _csv_options(layout) -> dict[str, str]:
    return {
        "sep": layout["delimiter"],
        "quote": layout["quote"],
        "escape": layout["quote"],
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_corrupt",
        "nullValue": "",
        "ignoreLeadingWhiteSpace": str(layout["skip_initial_space"]).lower(),
        "ignoreTrailingWhiteSpace": "false",
    }


def _decoded(layout, raw: Column) -> Column:
    charset = _JAVA_CHARSET.get(layout["encoding"])
    return F.decode(raw.cast("binary"), charset) if charset else raw


def _records(spark: SparkSession, layout, path, members: DataFrame | None) -> _Scan:
    """Records of the files of a layout; ``members`` (``_path``) names them where there are several layouts."""

    def own(frame: DataFrame) -> DataFrame:
        # One row a file, of which Spark's own listing holds as many on the driver.
        return frame if members is None else frame.join(F.broadcast(members), "_path", "left_semi")

    if layout["encoding"].startswith(("utf-16", "utf-32")):
        return _wide_records(spark, layout, path, members)
    kept = ~_blank_record(F.col("_line"), layout["delimiter"], layout["quote"])
    if layout["multi_line"]:
        joined, crossing = _joined_records(spark, layout, own(_lines(spark, path, line_feeds_only=True)))
        frame = joined.select("_path", "_block", F.monotonically_increasing_id().alias("_mid"), "_line")
        crossing = crossing.select("*", _cells(layout, F.col("_line")).alias("_cells"), kept.alias("_kept"))
        return _Scan(layout, frame.select("*", _cells(layout, F.col("_line")).alias("_cells")), kept, crossing)
    frame = own(_lines(spark, path)).select("_path", "_block", "_mid", _decoded(layout, F.col("value")).alias("_line"))
    return _Scan(layout, frame.select("*", _cells(layout, F.col("_line")).alias("_cells")), kept)


def _wide_records(spark: SparkSession, layout, path, members: DataFrame | None) -> _Scan:
    """Records of files in UTF-16 or UTF-32, which have no line ends of one byte and are read whole."""
    paths = path if members is None else [r["_path"] for r in members.collect()]
    width = len(layout["header"])
    # Column pruning would silently hide malformed records.
    reader = spark.read.schema(_cell_schema(width)).options(
        **_csv_options(layout), multiLine="true", header="false", columnPruning="false",
        encoding=layout["encoding"], pathGlobFilter="*.[cC][sS][vV]",
    )
    frame = reader.csv(paths).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.struct(*[f"c{i}" for i in range(width)], "_corrupt").alias("_cells"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    some = reduce(
        lambda a, b: a | b,
        [F.coalesce(strip(F.col(f"_cells.c{i}")) != "", F.lit(False)) for i in range(width)],
    )
    overflow = F.col("_cells._corrupt").isNotNull() & ~_blank_record(F.col("_cells._corrupt"), layout["delimiter"], layout["quote"])
    return _Scan(layout, frame, some | overflow)


# Records over several lines ------------------------------------------------------------------------
#
# A line's map of states is two bits: the state after it when it begins outside a quoted cell (bit 0) and inside (bit 1).
# 2 leaves the state, 1 changes it, 0 ends outside and 3 inside whatever came before.


def _state_maps():
    """Functions over the lines of a split, built by value for the workers."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def after(codes, entry: int):
        """The state after each line."""
        places = np.arange(len(codes))
        fixed = np.maximum.accumulate(np.where((codes == 0) | (codes == 3), places, -1))
        changes = np.cumsum(codes == 1)
        base = np.where(fixed >= 0, codes[fixed] & 1, entry)
        since = changes - np.where(fixed >= 0, changes[fixed], 0)
        return (base ^ (since & 1)).astype(np.int8)

    def runs(batch):
        """(path, block, begin, end) of the stretches of a batch that belong to one split."""
        path, block = batch.column(0), batch.column(1)
        changes = pc.or_(pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)), pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)))
        begins = [0, *(pc.indices_nonzero(changes).to_numpy() + 1).tolist(), batch.num_rows]
        for begin, end in zip(begins, begins[1:]):
            yield path[begin].as_py(), block[begin].as_py(), begin, end

    return np, pa, after, runs


def _compose():
    """Lines to one row per split: the composition of their maps."""

    def fold(batches):
        np, pa, after, runs = _state_maps()

        def row(key, state):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([state[0] | state[1] << 1], pa.int32())], names=["_path", "_block", "map"])

        key, state = None, (0, 1)
        for batch in batches:
            for path, block, begin, end in runs(batch) if batch.num_rows else ():
                if (path, block) != key:
                    if key:
                        yield row(key, state)
                    key, state = (path, block), (0, 1)
                codes = batch.column(2).slice(begin, end - begin).to_numpy()
                state = tuple(int(after(codes, entry)[-1]) for entry in state)
        if key:
            yield row(key, state)

    return fold


def _join_lines():
    """Lines to records: kind 0 whole ones, 1 what ends a record of an earlier split, 2 what a later split goes on with."""

    def join(batches):
        np, pa, after, runs = _state_maps()

        def out(path, block, kinds, texts):
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names=["_path", "_block", "kind", "_line"]
            )

        key, state, held, begun = None, 0, [], False
        for batch in batches:
            for path, block, begin, end in runs(batch) if batch.num_rows else ():
                if (path, block) != key:
                    if held:
                        yield out(*key, [2 if begun else 1], ["".join(held)])
                    key, held, begun = (path, block), [], False
                    state = int(batch.column(5)[begin].as_py())
                part = batch.slice(begin, end - begin)
                states = after(part.column(2).to_numpy(), state)
                if not held and state == 0 and not states.any():
                    zero = pa.array(np.zeros(part.num_rows, np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), zero, part.column(3)], names=["_path", "_block", "kind", "_line"])
                    continue
                kinds, texts = [], []
                for line, end_of_line, inside in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), states.tolist(), strict=True):
                    if not held:
                        begun = state == 0
                    state = inside
                    held.append(line)
                    if inside:
                        held.append(end_of_line)
                        continue
                    kinds.append(0 if begun else 1)
                    texts.append("".join(held))
                    held = []
                if texts:
                    yield out(path, block, kinds, texts)
        if held:
            yield out(*key, [2 if begun else 1], ["".join(held)])

    return join


def _joined_records(spark: SparkSession, layout, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that lie in one split, records that cross a border), each as ``_path``, ``_block``, ``_line``."""
    value = _decoded(layout, F.col("value"))
    # Carriage returns end lines as well; one before a line feed belongs to the same end.
    several = F.when(value.rlike(r"(?s)\r."), F.split(value, r"\r(?=(?s:.))", -1)).otherwise(F.array(value))
    cut = lines.select("_path", "_block", F.posexplode(several).alias("_piece", "_line"), (F.size(several) - 1).alias("_last"))
    opens, stays = _quote_patterns(layout["delimiter"], layout["quote"], layout["skip_initial_space"])
    code = F.col("_line").rlike(opens).cast("int") + F.col("_line").rlike(stays).cast("int") * 2
    coded = cut.select(
        "_path", "_block", F.when(F.col("_line").contains(layout["quote"]), code).otherwise(2).alias("_code"),
        "_line", F.when(F.col("_piece") < F.col("_last"), "\r").otherwise("\n").alias("_end"),
    )
    splits = coded.select("_path", "_block", "_code").mapInArrow(_compose(), "_path string, _block long, map int")
    # The running composition over a file's splits: the last fixed state before a split, and the changes since.
    order = W.partitionBy("_path").orderBy("_block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    counted = splits.withColumn("changes", F.sum((F.col("map") == 1).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    fixed = F.max(F.when(F.col("map").isin(0, 3), F.struct("_block", F.col("map").bitwiseAND(1).alias("state"), "changes"))).over(before)
    reached = counted.select("_path", "_block", (F.col("changes") - (F.col("map") == 1).cast("int")).alias("changes"), fixed.alias("fixed"))
    since = F.col("changes") - F.coalesce("fixed.changes", F.lit(0))
    entry = (F.coalesce("fixed.state", F.lit(0)) + since) % 2
    inside = cut_lineage(reached.select("_path", "_block", entry.alias("_entry")).filter("_entry = 1"))
    # One row for each split that begins inside a quoted cell; lines stay in the order of their scan.
    placed = coded.join(F.broadcast(inside), ["_path", "_block"], "left").select("_path", "_block", "_code", "_line", "_end", F.coalesce("_entry", F.lit(0)).alias("_entry"))
    found = placed.mapInArrow(_join_lines(), "_path string, _block long, kind int, _line string")
    tidy = lambda text: F.when(text.endswith("\r"), F.expr("substring(_line, 1, length(_line) - 1)")).otherwise(text)
    whole = found.filter("kind = 0").select("_path", "_block", tidy(F.col("_line")).alias("_line"))
    pieces = found.filter("kind > 0")
    # A piece that ends a record belongs to the last split before it that left one open.
    owner = F.when(F.col("kind") == 2, F.col("_block")).otherwise(F.max(F.when(F.col("kind") == 2, F.col("_block"))).over(before))
    crossing = pieces.withColumn("owner", owner).groupBy("_path", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "kind", "_line"))), lambda p: p["_line"]), "").alias("_line")
    )
    # A cell that is still open where the file ends has the end of its last line taken off.
    text = F.regexp_replace("_line", r"\r?\n?\z", "")
    return whole, cut_lineage(crossing.select("_path", F.col("owner").alias("_block"), text.alias("_line")))


def _split_counts(scan: _Scan, number: int) -> DataFrame:
    """One row per file split: first position, records and kept ones; crossing ones apart."""
    counts = scan.frame.groupBy("_path", "_block").agg(
        F.min("_mid").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(scan.kept).alias("kept")
    )
    if scan.crossing is None:
        crossing = counts.select("*", F.lit(0).alias("more"), F.lit(0).alias("more_kept"))
    else:
        own = scan.crossing.select("_path", "_block", F.lit(1).alias("more"), F.col("_kept").cast("int").alias("more_kept"))
        crossing = counts.join(own, ["_path", "_block"], "full").na.fill(0, ["n", "kept", "more", "more_kept"])
    return crossing.withColumn("group", F.lit(number))


def _count_fields(delimiter: str, quote: str, skip: bool):
    def count(batches):
        for pdf in batches:
            # A record may span lines, so the reader gets it in pieces that end at line feeds and carriage returns.
            parsed = [
                next(_csv.reader(io.StringIO(raw, newline=""), delimiter=delimiter, quotechar=quote, skipinitialspace=skip), [])
                for raw in pdf["raw"]
            ]
            yield pdf.drop(columns="raw").assign(
                actual_fields=[len(p) for p in parsed],
                raw_preview=[",".join(p[:_PREVIEW_CELLS]) for p in parsed],
            )

    return count


def scan_csv(
    spark: SparkSession,
    path,
    config: Config = Config(),
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> CsvScan:
    """Read CSV files as text columns plus ``_row``.

    Short records are padded with NULL, long ones cut, both reported as
    malformed; blank records are skipped; empty cells are NULL. One counting
    pass over the lines gives every split its row and line offsets.
    """
    prepare_session(spark)
    audit = cut_lineage(audit_files(spark, path, config, delimiter, encoding, multi_line))
    broken = [r["error"] for r in audit.filter(F.col("error").isNotNull()).select("error").limit(MOST_ERRORS).collect()]
    none = audit.isEmpty()
    if none and not isinstance(path, list) and str(path).lower().endswith(".csv"):
        # A zero-byte file exists but yields no split.
        broken = [f"CSV file '{str(path).rsplit('/', 1)[-1]}' is empty."]
    if broken or none:
        raise SourceError("; ".join(broken) or f"File not found: {path}")
    # As many rows as there are different layouts, in the order of the first file of each.
    key = ["encoding", "delimiter", "quote", "skip_initial_space", "header", "multi_line"]
    layouts = audit.groupBy(key).agg(F.min("path").alias("first")).orderBy("first").collect()
    if any(r["encoding"] == "cp1252" for r in layouts):
        # Spark refuses windows-1252 without this switch.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")

    scans = []
    for layout in layouts:
        members = None
        if len(layouts) > 1:
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.array(*map(F.lit, layout[k])) if k == "header" else F.lit(layout[k])) for k in key])
            members = audit.filter(same).select(F.col("path").alias("_path"))
        scans.append(_records(spark, layout, path, members))
    counts = reduce(DataFrame.unionByName, [_split_counts(scan, number) for number, scan in enumerate(scans)])
    offsets, kept_total = _offsets(counts)

    rows, malformed, headers = [], [], []
    for number, scan in enumerate(scans):
        layout = scan.layout
        names = column_names(layout["header"])
        if ROW in names:
            raise SourceError(f"The column name {ROW!r} is reserved.")
        headers += [n for n in names if n not in headers]
        numbered = _number(scan, offsets.filter(F.col("group") == number))
        rows.append(numbered.select(ROW, *[F.col(f"_cells.c{i}").alias(n) for i, n in enumerate(names)]))
        flagged = numbered.filter(F.col("_cells._corrupt").isNotNull()).select(
            F.col("_path").alias("dataset"),
            F.col("_line_number").alias("line_number"),
            F.lit(len(names)).alias("expected_fields"),
            F.col("_cells._corrupt").alias("raw"),
        )
        bad = flagged.mapInPandas(
            _count_fields(layout["delimiter"], layout["quote"], layout["skip_initial_space"]),
            "dataset string, line_number long, expected_fields int, actual_fields int, raw_preview string",
        )
        malformed.append(bad.filter(F.col("actual_fields") != F.col("expected_fields")).select(*field_names(MALFORMED_SCHEMA)))

    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return CsvScan(
        rows=union(rows).select(ROW, *[F.col("`" + h.replace("`", "``") + "`") for h in headers]),
        malformed=union(malformed),
        findings=_ingest_findings(spark, audit, kept_total),
        headers=headers,
        audit=audit,
    )


def _offsets(counts: DataFrame) -> tuple[DataFrame, int]:
    """Row and line offsets of every split, by running sums over the splits of a file and then over the files; and how
    many rows there are.

    The position of a kept record counts the kept records before it in its
    scan partition; ``kept_base`` is that count at the start of the split. A block's header record is left out.
    """
    first = (F.col("_block") == 0).cast("int")
    part = F.shiftright("first", POSITION_BITS)
    inside = W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    in_part = W.partitionBy("group", part).orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    running = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    rows_of = F.col("kept") + F.col("more_kept") - first
    splits = counts.select(
        "*", rows_of.alias("rows"),
        (F.shiftleft(part, POSITION_BITS) + running("kept", in_part)).alias("kept_base"),
        running(rows_of, inside).alias("inside"), (running(F.col("n") + F.col("more"), inside) + 1).alias("line"),
    )
    files = splits.groupBy("_path").agg(F.sum("rows").alias("rows"))
    before = W.orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("_path", (running("rows", before) + FIRST_ROW).alias("start"))
    # A header that is a crossing record is not among the others of its block.
    header = F.when(F.col("n") > 0, first).otherwise(0)
    found = splits.join(starts, "_path").select(
        "_path", "_block", "group", "first", F.col("line").alias("line_base"), (F.col("kept_base") + header).alias("kept_base"),
        (F.col("start") + F.col("inside")).alias("offset"), "n", (F.col("kept") - header).alias("rows_before"), "rows",
    )
    found = split_table(found)
    return found, int(found.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])


def _number(scan: _Scan, offsets: DataFrame) -> DataFrame:
    """``_path``, ``_cells``, ``_row``, ``_line_number`` of every kept record but the headers."""
    moved = F.raise_error(F.lit("The files or their splits changed while they were scanned."))
    placed = scan.frame.filter(scan.kept).withColumn("_kept_mid", F.monotonically_increasing_id())
    # One row per file split; positions are known, so any kind of join will do.
    located = placed.join(offsets, ["_path", "_block"], "left")
    is_header = (F.col("_block") == 0) & (F.col("_mid") == F.col("first"))
    known = F.col("offset").isNotNull() & F.col("_mid").between(F.col("first"), F.col("first") + F.col("n") - 1)
    row = F.when(~F.coalesce(known, F.lit(False)), moved.cast("long")).otherwise(F.col("_kept_mid") - F.col("kept_base") + F.col("offset"))
    line = F.col("_mid") - F.col("first") + F.col("line_base")
    found = located.filter(F.coalesce(~is_header, F.lit(True))).select("_path", "_cells", row.alias(ROW), line.alias("_line_number"))
    if scan.crossing is None:
        return found
    last = scan.crossing.filter("_kept").join(offsets, ["_path", "_block"]).filter("_block > 0 or n > 0")
    return found.unionByName(
        last.select("_path", "_cells", (F.col("offset") + F.col("rows_before")).alias(ROW), (F.col("line_base") + F.col("n")).alias("_line_number"))
    )


def _ingest_findings(spark, audit: DataFrame, kept_total: int) -> DataFrame:
    """Findings of the headers and encodings of every file, and of a scan without rows."""
    line = F.lit(None).cast("long")
    file = F.create_map(F.lit("path"), F.col("path"))

    def found(severity, code, message, line=line, details=file):
        return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), line.alias("line_number"), details.alias("details")]

    header = F.lit(1).cast("long")
    times = F.size(F.filter("header", lambda h: h == F.col("name")))
    names = audit.select("path", "header", F.explode(F.array_sort(F.array_distinct(F.filter("header", lambda h: h != "")))).alias("name"))
    blanks = F.size(F.filter("header", lambda h: h == ""))
    parts = [
        names.filter(times > 1).select(*found(WARNING, "duplicate_header", F.format_string("Header '%s' appears %d times; later copies were renamed.", F.col("name"), times), header)),
        audit.filter(blanks > 0).select(*found(WARNING, "blank_header", F.format_string("%d blank header name(s) were replaced.", blanks), header)),
        audit.filter("encoding <> 'utf-8'").select(*found(INFO, "encoding_warning", F.format_string("Detected encoding '%s'.", F.col("encoding")))),
    ]
    if kept_total == 0:
        records = [(WARNING, "no_rows", "The CSV file contained a header row but no data rows.", None, {})]
        parts.append(local_frame(spark, records, INGEST_SCHEMA))
    return reduce(DataFrame.unionByName, parts)
