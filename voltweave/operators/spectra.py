"""Autocovariances of long series at all lags by a Fourier transform that is dealt over tasks.

A series of n positions is padded to N = N1 * N2 >= 2n, both powers of two of about the root of N. Position
p = N2 a + b and frequency k = k1 + N1 k2 part the transform in three steps: transforms along a for each
b, a turn by exp(-2 pi i b k1 / N), transforms along b for each k1. The squared magnitudes are turned back the
same way from where they stand. A task holds some columns or rows of that grid, about 2 sqrt(N)
positions each, so neither work nor memory grows with the square of a series, and every
position is shuffled three times.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltweave.operators.series import centred

#: Positions that a task transforms at once; at least one whole column or row.
GROUP = 8192


def _grid(length: int) -> tuple[int, int]:
    """N1 and N2 for series of at most this length."""
    digits = max(2, (2 * length - 1).bit_length())
    return 1 << digits // 2, 1 << digits - digits // 2


def _packed(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a complex array."""
    rows = np.ascontiguousarray(rows, np.complex128)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1] * 16
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _table(key: tuple, names: list[str], columns: list[pa.Array]) -> pa.Table:
    repeated = [pa.array([k.as_py()] * len(columns[0]), type=k.type) for k in key]
    return pa.table([*repeated, *columns], names=names)


def _grid_of(table: pa.Table, down: str, shape: int, first: int, across: str, count: int) -> np.ndarray:
    """Packed rows as an array by the index ``down`` (``shape`` of them) and ``across`` (``count`` from ``first`` on)."""
    values = np.frombuffer(b"".join(table.column("z").to_pylist()), np.complex128).reshape(table.num_rows, -1)
    out = np.zeros((shape, count, values.shape[1]), np.complex128)
    out[table.column(down).to_numpy(), table.column(across).to_numpy() - first] = values
    return out


def all_lag_products(df: DataFrame, keys: Sequence[str], pos: str, x: str, length: int) -> DataFrame:
    """``keys, cell, lag, s`` with s = sum over t of x[t] * x[t + lag], for all lags below ``length``.

    ``x`` is an array of cells at every position 0, 1, ... of a series; ``length`` is that of the longest one.
    A position that stands twice is an error.
    """
    keys = list(keys)
    n1, n2 = _grid(length)
    n = n1 * n2
    wide, high = max(1, GROUP // n1), max(1, GROUP // n2)
    fields = [df.schema[k] for k in keys]
    whole = lambda name: T.StructField(name, T.IntegerType())
    packed = T.StructType([*fields, whole("k1"), whole("b"), T.StructField("z", T.BinaryType())])
    turn = lambda k1, b: np.exp(-2j * np.pi / n * (np.multiply.outer(k1, b) % n))

    def columns(key: tuple, table: pa.Table) -> pa.Table:
        first = key[-1].as_py() * wide
        count = min(wide, n2 - first)
        values = table.column("x").combine_chunks()
        values = values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        at = table.column("p").to_numpy()
        if len(np.unique(at)) != len(at):
            raise ValueError("a position stands twice in a series")
        x_grid = np.zeros((n1, count, values.shape[1]))
        x_grid[at // n2, at % n2 - first] = values
        k1, b = np.arange(n1 // 2 + 1), np.arange(first, first + count)
        z = np.fft.rfft(x_grid, axis=0) * turn(k1, b)[:, :, None]
        return _table(key[:-1], packed.names, [
            pa.array(np.repeat(k1, count).astype(np.int32)), pa.array(np.tile(b, len(k1)).astype(np.int32)), _packed(z.reshape(-1, z.shape[2]))])

    def rows(key: tuple, table: pa.Table) -> pa.Table:
        first = key[-1].as_py() * high
        count = min(high, n1 // 2 + 1 - first)
        # Columns without a position are all 0.
        z = np.fft.fft(_grid_of(table, "b", n2, first, "k1", count), axis=0)
        k1, b = np.arange(first, first + count), np.arange(n2)
        back = np.fft.ifft((z * z.conj()).real, axis=0) / n1 * turn(b, k1).conj()[:, :, None]
        return _table(key[:-1], packed.names, [
            pa.array(np.tile(k1, n2).astype(np.int32)), pa.array(np.repeat(b, count).astype(np.int32)), _packed(back.reshape(-1, back.shape[2]))])

    sums = T.StructType([*fields, whole("lag"), T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def lags(key: tuple, table: pa.Table) -> pa.Table:
        first = key[-1].as_py() * wide
        count = min(wide, n2 - first)
        s = np.fft.irfft(_grid_of(table, "k1", n1 // 2 + 1, first, "b", count), n=n1, axis=0) * n1
        lag = np.add.outer(np.arange(n1) * n2, np.arange(first, first + count))
        keep = lag < length
        found = s[keep]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * s.shape[2]), pa.array(found.ravel()))
        return _table(key[:-1], sums.names, [pa.array(lag[keep].astype(np.int32)), lists])

    spread = df.select(*keys, F.col(pos).cast("long").alias("p"), F.col(x).alias("x"))
    dealt = spread.groupBy(*keys, F.floor(F.col("p") % n2 / wide).cast("int").alias("_g")).applyInArrow(columns, packed)
    turned = dealt.groupBy(*keys, F.floor(F.col("k1") / high).cast("int").alias("_g")).applyInArrow(rows, packed)
    found = turned.groupBy(*keys, F.floor(F.col("b") / wide).cast("int").alias("_g")).applyInArrow(lags, sums)
    return found.select(*keys, "lag", F.posexplode("_s").alias("cell", "s")).select(*keys, "cell", "lag", "s")


def all_autocovariance_sums(df: DataFrame, keys: Sequence[str], pos: str, x: str) -> DataFrame:
    """Centred products at every lag of each series with its length: ``keys, n, cell, lag, s``."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(pos).alias("_low"), F.max(pos).alias("_high"))
    longest, dense = sizes.agg(F.max("n"), F.every((F.col("_low") == 0) & (F.col("_high") == F.col("n") - 1))).first()
    if longest is not None and not dense:
        raise ValueError("series positions must be dense and unique")
    sums = all_lag_products(centred(df, keys, x), keys, pos, x, longest or 1)
    return sums.join(sizes.select(*keys, "n"), keys).where("lag < n")
