"""Draws stored while they are made, in numbered chunks that a manifest commits.

A chunk is a Parquet folder. It counts once its manifest entry stands, which is written under another name and renamed
when all of the chunk is there; so readers see whole chunks only, and a run that was interrupted goes on behind the last of
them, replacing what an unfinished chunk has left.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chunk:
    """Draws [first, stop) of every chain that has them, ``rows`` rows."""

    number: int
    first: int
    stop: int
    rows: int


class ChunkStore:
    """A store below ``path``, any folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, number: int) -> str:
        return f"{self.path}/chunk-{number:06d}"

    def _entry(self, number: int) -> str:
        return f"{self.path}/manifest/{number:06d}.json"

    def chunks(self) -> list[Chunk]:
        """Committed chunks, up to the first one that is missing."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = {s.getPath().getName() for s in self._fs.listStatus(folder)}
        out: list[Chunk] = []
        while f"{len(out):06d}.json" in names:
            stream = self._fs.open(self._path(self._entry(len(out))))
            said = stream.readAllBytes()
            stream.close()
            out.append(Chunk(**json.loads(bytes(said).decode())))
        return out

    def append(self, draws: DataFrame, first: int, stop: int, n_chains: int, lengths: Sequence[int] | None = None) -> Chunk:
        """Write draws [first, stop) of all chains as the next chunk and commit it.

        Where chains 0, 1, ... differ in length, ``lengths`` gives the draws of each. An error, and no commit, if a draw of a chain is
        missing, stands twice or lies outside.
        """
        done = self.chunks()
        expected = done[-1].stop if done else 0
        if first != expected or stop <= first:
            raise ValueError(f"the next chunk starts at draw {expected}, not {first}")
        number = len(done)
        draws.write.mode("overwrite").parquet(self._folder(number))
        kept = self.spark.read.parquet(self._folder(number))
        rows, keys, low, high = kept.agg(
            F.count("*"), F.countDistinct("chain", "draw"), F.min("draw"), F.max("draw")).first()
        ends = [stop] * n_chains if lengths is None else [max(first, min(stop, n)) for n in lengths]
        beyond = lengths is not None and not kept.where(
            F.col("draw") >= F.coalesce(F.get(F.array(*[F.lit(n) for n in lengths]), F.col("chain")), F.lit(0))).isEmpty()
        if rows != sum(ends) - first * n_chains or keys != rows or low != first or high != max(ends) - 1 or beyond:
            raise ValueError(f"chunk {number} has {rows} rows of draws {low} to {high}")
        chunk = Chunk(number, first, stop, rows)
        self._commit(chunk)
        return chunk

    def _commit(self, chunk: Chunk) -> None:
        written = self._path(f"{self._entry(chunk.number)}.open")
        stream = self._fs.create(written, True)
        stream.write(json.dumps(asdict(chunk)).encode())
        stream.close()
        if not self._fs.rename(written, self._path(self._entry(chunk.number))):
            raise OSError(f"chunk {chunk.number} is committed already")

    def run(
        self, make: Callable[[int, int], DataFrame], total: int | Sequence[int], every: int, n_chains: int, until: int | None = None
    ) -> list[Chunk]:
        """Store draws 0 to ``total`` made by ``make(first, stop)`` in chunks of ``every``, behind those that are there.

        ``total`` is one number, or one for each chain where they differ. ``until`` ends the run early, at the first chunk that
        reaches it.
        """
        lengths = None if isinstance(total, int) else list(total)
        total = total if lengths is None else max(lengths)
        done = self.chunks()
        at = done[-1].stop if done else 0
        while at < min(total, until if until is not None else total):
            stop = min(at + every, total)
            self.append(make(at, stop), at, stop, n_chains, lengths)
            at = stop
        return self.chunks()

    def read(self) -> DataFrame:
        """All committed draws; an error if there is none."""
        done = self.chunks()
        if not done:
            raise FileNotFoundError(f"no chunk is committed below {self.path}")
        return self.spark.read.parquet(*[self._folder(c.number) for c in done])
