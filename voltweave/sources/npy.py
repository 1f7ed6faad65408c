"""Sample stores of ``.npy`` files: ``<path>/chain_<c>/<quantity>_samples.npy``, draws on the last axis.

A scan is dealt by chain and range of draws. The driver reads headers only; a task seeks to its range in every wanted
file, so files are never read whole and quantities that aren't wanted never at all. Files may be in C order (each cell's draws are
together) or Fortran order (each draw's cells are). Paths are those that pyarrow's file systems know; executors
must reach them.
"""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The ending of a quantity's file, and quantities that are left out unless asked for.
ENDING = "_samples.npy"
EXCLUDED = ("mu_h", "phi_h")
MAGIC = b"\x93NUMPY"
#: Draws of a partition.
ROWS = 4096


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass(frozen=True)
class Header:
    """What a file says about itself; ``cells`` values stand for each of ``draws`` draws from byte ``start`` on."""

    dtype: str
    fortran: bool
    shape: tuple[int, ...]
    start: int

    @property
    def draws(self) -> int:
        return self.shape[-1]

    @property
    def cells(self) -> int:
        return int(np.prod(self.shape[:-1], dtype=np.int64))

    @staticmethod
    def of(file) -> Header:
        head = file.read(8)
        if head[:6] != MAGIC:
            raise ValueError("no .npy file")
        width = "<H" if head[6] == 1 else "<I"
        size = struct.unpack(width, file.read(struct.calcsize(width)))[0]
        said = ast.literal_eval(file.read(size).decode("latin1" if head[6] < 3 else "utf8"))
        if not said["shape"] or np.dtype(said["descr"]).hasobject:
            raise ValueError(f"no numeric samples: {said}")
        return Header(said["descr"], said["fortran_order"], tuple(said["shape"]), 8 + struct.calcsize(width) + size)

    def read(self, file, first: int, stop: int) -> np.ndarray:
        """Rows of draws [first, stop), cells in C order."""
        kind = np.dtype(self.dtype)
        if self.fortran:
            file.seek(self.start + first * self.cells * kind.itemsize)
            values = np.frombuffer(file.read((stop - first) * self.cells * kind.itemsize), kind)
            values = values.reshape(*self.shape[:-1], stop - first, order="F").reshape(self.cells, stop - first).T
        else:
            out = np.empty((self.cells, stop - first), kind)
            for cell in range(self.cells):
                file.seek(self.start + (cell * self.draws + first) * kind.itemsize)
                out[cell] = np.frombuffer(file.read((stop - first) * kind.itemsize), kind)
            values = out.T
        return np.ascontiguousarray(values, np.float64)


def headers(
    path: str, n_chains: int, quantities: Sequence[str] = (), exclude: Sequence[str] = EXCLUDED, uneven: bool = False
) -> dict[str, list[Header]]:
    """Headers by quantity and chain.

    Quantities are those of chain 0 without the excluded ones, or the named ones. An error if a chain's folder or one of its files is
    absent, or if chains or quantities differ in length or in what they hold. With ``uneven`` chains may differ in length, the
    quantities of one chain may not.
    """
    fs, root = filesystem(path)
    folders = [f"{root}/chain_{c}" for c in range(n_chains)]
    missing = [c for c, f in enumerate(fs.get_file_info(folders)) if f.type != pafs.FileType.Directory]
    if missing:
        raise FileNotFoundError(f"chains without draws: {missing}")
    names = sorted(f.base_name[: -len(ENDING)] for f in fs.get_file_info(pafs.FileSelector(folders[0])) if f.base_name.endswith(ENDING))
    wanted = list(quantities) or [n for n in names if n not in exclude]
    out: dict[str, list[Header]] = {}
    for name in wanted:
        files = [f"{folder}/{name}{ENDING}" for folder in folders]
        absent = [f.path for f in fs.get_file_info(files) if f.type != pafs.FileType.File]
        if absent:
            raise FileNotFoundError(f"samples missing: {absent}")
        for path_ in files:
            with fs.open_input_file(path_) as file:
                out.setdefault(name, []).append(Header.of(file))
    lengths = {tuple(h.draws for h in found) for found in out.values()}
    if len(lengths) > 1 or not uneven and len({n for found in lengths for n in found}) > 1:
        raise ValueError("chains differ in length: " + str({n: [h.draws for h in f] for n, f in out.items()}))
    for name, found in out.items():
        if len({h.shape[:-1] for h in found}) > 1:
            raise ValueError(f"chains differ in shape: {name}")
    return out


@dataclass
class Range(InputPartition):
    chain: int
    first: int
    stop: int


class NpySource(DataSource):
    """Options: path, chains, quantities and exclude (comma-separated), rows (draws of a partition), uneven (chains may differ in length)."""

    def __init__(self, options):
        super().__init__(options)
        listed = lambda key, default="": tuple(q for q in self.options.get(key, default).split(",") if q)
        self.path, self.chains = self.options["path"], int(self.options["chains"])
        self.rows = int(self.options.get("rows", ROWS))
        self.found = headers(self.path, self.chains, listed("quantities"), listed("exclude", ",".join(EXCLUDED)),
                             self.options.get("uneven", "false") == "true")

    @classmethod
    def name(cls) -> str:
        return "npy_draws"

    def schema(self) -> str:
        kind = lambda h: "double" if len(h.shape) == 1 else "array<double>"
        return ", ".join(["chain int", "draw bigint", *[f"`{q}` {kind(h[0])}" for q, h in self.found.items()]])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.path, self.chains, self.rows, self.found)


class _Reader(DataSourceReader):
    def __init__(self, path: str, chains: int, rows: int, found: dict[str, list[Header]]):
        self.path, self.chains, self.rows, self.found = path, chains, rows, found

    def partitions(self) -> Sequence[InputPartition]:
        draws = next(([h.draws for h in found] for found in self.found.values()), [0] * self.chains)
        return [Range(c, k, min(k + self.rows, n)) for c, n in enumerate(draws) for k in range(0, n, self.rows)] or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        n = partition.stop - partition.first
        columns = [pa.array([partition.chain] * n, pa.int32()), pa.array(np.arange(partition.first, partition.stop))]
        for name, found in self.found.items():
            head = found[partition.chain]
            with fs.open_input_file(f"{root}/chain_{partition.chain}/{name}{ENDING}") as file:
                values = head.read(file, partition.first, partition.stop) if n else np.zeros((0, head.cells))
            flat = pa.array(values.ravel())
            columns.append(flat if len(head.shape) == 1 else pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * head.cells), flat))
        yield pa.RecordBatch.from_arrays(columns, ["chain", "draw", *self.found])


def read_samples(
    spark: SparkSession, path: str, n_chains: int, quantities: Sequence[str] = (), exclude: Sequence[str] = EXCLUDED, rows: int = ROWS,
    uneven: bool = False,
) -> DataFrame:
    """``chain, draw`` and a column per quantity: a number, or the cells of a draw in C order. Files of quantities that
    aren't wanted aren't opened. Chains may differ in length if ``uneven``."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_draws").options(
        path=path, chains=str(n_chains), quantities=",".join(quantities), exclude=",".join(exclude), rows=str(rows),
        uneven=str(uneven).lower()).load()


def write_samples(draws: DataFrame, path: str, shapes: dict[str, tuple[int, ...]], dtype: str = "<f8") -> DataFrame:
    """Write columns of ``draws`` (chain, draw 0, 1, ...; numbers or arrays) as sample files; ``shapes`` are those of a draw.

    A file is one sequence, so each one has a task, which streams the draws in order (Fortran order: a draw's cells
    together) and renames the file when it is whole. Returns chain, quantity and draws written.
    """
    fields = [F.struct(F.lit(q).alias("quantity"), (F.array(F.col(q).cast("double")) if not s else F.col(q).cast("array<double>")).alias("x"))
              for q, s in shapes.items()]
    sizes = {r.chain: r.n for r in draws.groupBy("chain").agg(F.count("*").alias("n")).collect()}  # a row for each chain
    rows = draws.select("chain", "draw", F.inline(F.array(*fields)))
    kind = np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        now, file, at, written = None, None, 0, []

        def close() -> None:
            file.close()
            chain, quantity = now
            if at != sizes[chain]:
                raise ValueError(f"chain {chain}: {sizes[chain]} draws expected, {at} written")
            fs.move(f"{root}/chain_{chain}/{quantity}.{mark}", f"{root}/chain_{chain}/{quantity}{ENDING}")
            written.append((chain, quantity, at))

        mark = f"open-{uuid.uuid4().hex}"
        for batch in batches:
            for chain, draw, quantity, x in zip(*[batch.column(c) for c in ("chain", "draw", "quantity", "x")]):
                chain, draw, quantity = chain.as_py(), draw.as_py(), quantity.as_py()
                if (chain, quantity) != now:
                    if file:
                        close()
                    now, at = (chain, quantity), 0
                    fs.create_dir(f"{root}/chain_{chain}", recursive=True)
                    file = fs.open_output_stream(f"{root}/chain_{chain}/{quantity}.{mark}")
                    file.write(_head(kind, (*shapes[quantity], sizes[chain])))
                if draw != at:
                    raise ValueError(f"chain {chain}: draw {draw} stands where {at} should be")
                values = np.asarray(x.values, np.float64).reshape(shapes[quantity] or 1)
                file.write(values.astype(kind).tobytes(order="F"))
                at += 1
        if file:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([w[k] for w in written], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["chain", "quantity", "draws"])

    ordered = rows.repartition("chain", "quantity").sortWithinPartitions("chain", "quantity", "draw")
    return ordered.mapInArrow(run, "chain int, quantity string, draws bigint")


def _head(kind: np.dtype, shape: tuple[int, ...]) -> bytes:
    said = str({"descr": kind.str, "fortran_order": len(shape) > 1, "shape": shape})
    said += " " * (-(len(said) + 11) % 64) + "\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(said)) + said.encode("latin1")
