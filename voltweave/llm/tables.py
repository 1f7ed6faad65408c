"""Helpers shared by the corpus operators: table reads and Arrow batches of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltweave.runtime import cut

#: Bytes of text handled at once inside a Python worker; bounds the numpy arrays built per character.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame, salt: str = "") -> Column:
    """64-bit hash of all columns of a row; a map counts by its entries."""
    columns = [F.map_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(F.lit(salt), *columns)


def file_order(docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with the file and the row in it that each row was read from.

    A scan deals files out by size, so this is what is left of the order in which they were written. Rows
    that don't come straight from files are written first.
    """
    try:
        return docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return file_order(cut(docs), file, row)


def positions(rows: DataFrame, sizes: DataFrame, file: str, row: str, name: str = "position") -> DataFrame:
    """``rows`` with their place in the order of the files instead of ``file`` and ``row``; ``sizes`` are the rows of each file."""
    sizes = sizes.toPandas().to_dict("records")  # a row for each file
    number = lambda f: int((re.search(r"part-(\d+)", f) or [0, 0])[1])
    sizes.sort(key=lambda r: (number(r[file]), r[file]))
    before = np.cumsum([0, *[r["count"] for r in sizes]])[:-1]
    offsets = rows.sparkSession.createDataFrame(pa.table({file: pa.array([r[file] for r in sizes], pa.string()), "_vw_before": pa.array(before, pa.int64())}))
    return rows.join(offsets, file).withColumn(name, F.col("_vw_before") + F.col(row)).drop(file, row, "_vw_before")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    col = batch.column(column)
    ends = text_offsets(col)[1:]
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else text_offsets(col)[0]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string array (n + 1 of them), as they stand in its buffer."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(1, kind)
    return np.frombuffer(col.buffers()[1], kind)[col.offset: col.offset + len(col) + 1]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the offsets of each (NULL counts as empty)."""
    if col.null_count:
        col = col.fill_null("")
    offsets = text_offsets(col).astype(np.int64)
    data = col.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def string_list(values: list[bytes], kind: np.dtype) -> pa.Array:
    """A list column from packed native integers, one byte string per row."""
    kind = np.dtype(kind)
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values)) // kind.itemsize
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), kind)))
