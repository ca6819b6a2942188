"""Row order and durable cut points.

Row numbers come from scan positions or from one range sort; no window ever
pulls the table into a single task.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.config import FIRST_ROW, ROW
from tabsight.functions.cells import col

POSITION_BITS = 33
_POSITION_MASK = (1 << POSITION_BITS) - 1
#: Offsets of so many splits are kept as a local relation (some 10 MB).
LOCAL_SPLITS = 50_000


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the results depend on: UTC timestamps and split sizes that stay put.

    Split sizes follow the core count unless pinned; a cluster that grows or
    loses executors between two scans must still cut the files alike.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder stands in only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("Name a folder that all executors share in spark.checkpoint.dir.")
        named = tempfile.mkdtemp(prefix="tabsight-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Add the dense row number ``_row`` (2, 3, ...).

    Without ``order_by`` the frame must be a file scan and rows are numbered in
    (file path, position) order: one counting pass yields the offset of every
    split. Rows stay in their scan's partitions. With ``order_by`` (unique
    keys) the frame is range-sorted once and cut to the shared folder, so the
    numbers are stable however often the result is read.
    """
    prepare_session(df.sparkSession)
    if order_by:
        return _number_sorted(df, order_by)
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_mid", F.monotonically_increasing_id())
    offsets = _split_offsets(placed)
    located = placed.join(offsets, ["_path", "_block"], "left")
    return located.select(*[col(c) for c in df.columns], row_position("_mid", "_first", "_offset").alias(ROW))


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows with their numbers; of a file scan only the files that hold them are counted and read.

    Files are taken in path order, eight times as many at each step, until they hold enough rows.
    """
    head = F.col(ROW) < rows + FIRST_ROW
    if ROW in df.columns:
        return df.filter(head)
    path = F.col("_metadata.file_path")
    try:
        one = df.select(path.alias("p")).first()
    except AnalysisException:
        return ensure_rows(df).filter(head)
    # The listing and the rows may write the same path in two ways; a way that they share is looked for.
    local = lambda f: f.replace(":///", ":/", 1)
    ways = (list(map(way, df.inputFiles())) for way in (str, local, unquote, lambda f: unquote(local(f))))
    files = sorted(next((found for found in ways if one and one["p"] in found), []))
    taken = 1
    while taken < len(files):
        part = df.filter(path.isin(files[:taken]))
        if part.limit(rows).count() >= rows:
            return number_rows(part).filter(head)
        taken *= 8
    return number_rows(df).filter(head)


def _split_offsets(placed: DataFrame) -> DataFrame:
    """The first position and the row offset of every file split, with no limit to their number.

    Running sums go over the splits of a file and then over the files. The
    table is made once: as a local relation while it is small, which plans as
    a broadcast, as a written table in the shared folder beyond that.
    """
    splits = placed.groupBy("_path", "_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    inside = W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
    files = splits.groupBy("_path").agg(F.sum("_n").alias("_n"))
    starts = files.select("_path", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + FIRST_ROW).alias("_start"))
    rows = splits.select("_path", "_block", "_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_inside"))
    offsets = rows.join(starts, "_path").select("_path", "_block", "_first", (F.col("_start") + F.col("_inside")).alias("_offset"))
    return split_table(offsets)


def split_table(splits: DataFrame) -> DataFrame:
    """A frame of one row a split, made once: a local relation that is broadcast while it is small, a written table in the
    shared folder beyond that."""
    spark = splits.sparkSession
    few = splits.limit(LOCAL_SPLITS + 1).toArrow()
    if few.num_rows <= LOCAL_SPLITS:
        return F.broadcast(spark.createDataFrame(few, splits.schema))
    path = f"{shared_folder(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
    splits.write.parquet(path)
    return spark.read.schema(splits.schema).parquet(path)


def row_position(mid: str, first: str, offset: str):
    moved = F.raise_error(F.lit("The files or their splits changed after row numbers were assigned."))
    position = F.col(mid) - F.col(first) + F.col(offset)
    return F.when(F.col(offset).isNull(), moved.cast("long")).otherwise(position)


def _number_sorted(df: DataFrame, order_by: list[str]) -> DataFrame:
    return _number_parts(df, cut_lineage(df.orderBy(*[col(c) for c in order_by]).withColumn("_mid", F.monotonically_increasing_id())))


def _number_parts(df: DataFrame, staged: DataFrame) -> DataFrame:
    """Number the rows of a frame that was cut with its positions (``_mid``), part by part."""
    part = F.shiftright("_mid", POSITION_BITS)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the staged frame.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + FIRST_ROW).alias("_offset"))
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*[col(c) for c in df.columns], (F.col("_mid").bitwiseAND(_POSITION_MASK) + F.col("_offset")).alias(ROW))
    )


def use_order_key(df: DataFrame, key: str) -> DataFrame:
    """Take an existing key as the row order; it has to be unique, dense and begin at 0, which is checked."""
    place = col(key).cast("long")
    found = df.agg(F.min(place), F.max(place), F.count(F.lit(1)), F.count_distinct(place)).first()
    if found[2] and tuple(found) != (0, found[2] - 1, found[2], found[2]):
        raise ValueError(f"{key!r} is no dense, unique row key from 0; number the rows with order_by=[{key!r}] instead.")
    return df.withColumn(ROW, place + FIRST_ROW)


def ensure_rows(df: DataFrame) -> DataFrame:
    """Numbered rows of any frame: of file scans by position, of all others in the order of one reliable cut."""
    if ROW in df.columns:
        return df
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        prepare_session(df.sparkSession)
        return _number_parts(df, cut_lineage(df.withColumn("_mid", F.monotonically_increasing_id())))
    return number_rows(df)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]
