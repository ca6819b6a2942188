"""Length-delimited binary records of token ids, with a separate offset index.

One record, all numbers little-endian:

    length    8 bytes   of the payload
    check     4 bytes   masked CRC-32 of the 8 length bytes
    payload   9 bytes + ids: doc_id (8), flags (1: bit 0 doc_id is null, bit 1 ids are 4 bytes wide, else 2)
    check     4 bytes   masked CRC-32 of the payload
    end       1 byte    line feed

The mask rotates a CRC and adds a constant, so that a CRC over bytes that hold CRCs stays useful. Files follow one
another in ascending doc_id order (their part numbers), as do the records of a file; equal doc_ids go by their text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.common import keep, new_path, python_tasks
from tabsight.llm.tokens import END_ID, TOKENIZER, TokenEncoder

_MASK_DELTA = 0xA282EAD8
_LENGTH, _HEAD, _CHECK = struct.Struct("<Q"), struct.Struct("<qB"), struct.Struct("<I")
_FRAME = _LENGTH.size + 2 * _CHECK.size + 1
INDEX = "file string, part int, position long, bytes long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = _HEAD.pack(doc_id or 0, (doc_id is None) | wide << 1) + ids
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked_crc(length)), payload, _CHECK.pack(masked_crc(payload)), b"\n"))


def unframe(data: memoryview | bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at a position: doc_id, ids as 4-byte numbers, and where the next one begins. Raises on damage."""
    view = memoryview(data)
    length = bytes(view[at : at + 8])
    if len(length) < 8 or _CHECK.unpack(view[at + 8 : at + 12])[0] != masked_crc(length):
        raise ValueError(f"damaged record length at {at}")
    end = at + 12 + _LENGTH.unpack(length)[0]
    payload = view[at + 12 : end]
    if len(view) < end + 5 or _CHECK.unpack(view[end : end + 4])[0] != masked_crc(payload) or view[end + 4] != 10:
        raise ValueError(f"damaged record at {at}")
    doc_id, flags = _HEAD.unpack(payload[: _HEAD.size])
    ids = np.frombuffer(payload[_HEAD.size :], "<u4" if flags & 2 else "<u2").astype("<u4")
    return None if flags & 1 else doc_id, ids, end + 5


def write_records(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, files: int | None = None
) -> None:
    """Encode ``doc_id``, ``text`` and write record files below ``path``.

    Texts are dealt by ranges of doc_id, sorted inside each range and encoded where they are written, so ids are never
    shuffled. ``files`` defaults to the number of splits of the scan, so a file stays about as large as a split. A null
    text is an empty one (its record holds the end id alone); a null doc_id sorts first. An empty table gives no file.
    """
    python_tasks(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(files or max(1, docs.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenEncoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [frame(i, encoder.encode(t) + end, encoder.dtype.itemsize == 4) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # The text writer puts out the bytes of a value and a line feed: any store that Spark writes to will do.
    framed = rows.mapInArrow(run, "record binary").select(F.expr("substring(record, 1, length(record) - 1)").cast("string"))
    framed.write.option("lineSep", "\n").option("compression", "none").text(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files, checked, as a row of the offset index (``INDEX``)."""

    python_tasks(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view, at, before, rows = memoryview(data.as_buffer()), 0, 0, []
                part = int(file.rpartition("part-")[2].split("-")[0].split(".")[0])
                while at < len(view):
                    doc_id, ids, then = unframe(view, at)
                    rows.append((file, part, at, then - at, doc_id, before, len(ids), zlib.crc32(ids)))
                    at, before = then, before + len(ids)
                names = [c.split()[0] for c in INDEX.split(", ")]
                types = [pa.string(), pa.int32(), *[pa.int64()] * 6]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    except Exception as error:  # a folder that Spark wrote for no rows
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], INDEX)
    return files.select(F.col("path"), F.col("content")).mapInArrow(run, INDEX)


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before. The running sum over files has one row a file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(starts, "part").withColumn("start", F.col("_before") + F.col("start_in_file")).drop("_before")


def token_files(
    docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID, files: int | None = None
) -> tuple[str, DataFrame]:
    """Write the record files, read them back and write the offset index; returns the folder and the index.

    The index (``INDEX`` and ``start``) serves shuffled reads: any order of its rows gives file, position and bytes of
    one record. Repeated rows give repeated records; other columns of the input, whatever their names, play no part.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "records")
    write_records(docs, f"{path}/data", tokenizer, end_id, files)
    index = with_starts(keep(scan_records(spark, f"{path}/data"), "records-scan"))
    index.write.parquet(f"{path}/index")
    return path, spark.read.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of long) of every record of a folder that ``token_files`` wrote."""

    python_tasks(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                view, at = memoryview(data.as_buffer()), 0
                while at < len(view):
                    doc_id, ids, at = unframe(view, at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"]
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select("content").mapInArrow(run, "doc_id long, ids array<long>")
