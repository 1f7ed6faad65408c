"""Stores of sample files and of chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.sources import npy
from voltweave.sources.chunks import ChunkStore


def put(path, chains, order="C"):
    for c, found in enumerate(chains):
        (path / f"chain_{c}").mkdir()
        for name, x in found.items():
            np.save(path / f"chain_{c}" / f"{name}_samples.npy", np.asarray(x, order=order))


def chain(seed, n=23):
    r = np.random.default_rng(seed)
    return {"G0": r.integers(0, 2, (3, 4, n)).astype(np.uint8), "Phi": r.normal(size=(2, 3, 2, n)).astype(np.float32),
            "h": r.normal(size=(5, n)), "sigma_h2": r.normal(size=n), "mu_h": r.normal(size=n)}


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_scan_of_files(spark, tmp_path, order, rows):
    chains = [chain(0), chain(1)]
    put(tmp_path, chains, order)
    df = npy.read_samples(spark, str(tmp_path), 2, rows=rows)
    assert dict(df.dtypes) == {"chain": "int", "draw": "bigint", "G0": "array<double>", "Phi": "array<double>", "h": "array<double>", "sigma_h2": "double"}
    assert df.rdd.getNumPartitions() == 2 * -(-23 // rows)
    got = df.collect()
    assert sorted((r.chain, r.draw) for r in got) == [(c, d) for c in range(2) for d in range(23)]
    for r in got:
        for name in ("G0", "Phi", "h"):
            assert r[name] == chains[r.chain][name][..., r.draw].astype(float).ravel().tolist(), name
        assert r.sigma_h2 == chains[r.chain]["sigma_h2"][r.draw]


def test_only_wanted_files_are_opened(spark, tmp_path):
    put(tmp_path, [chain(0), chain(1)])
    for c in range(2):
        (tmp_path / f"chain_{c}" / "h_samples.npy").write_bytes(b"broken")
        (tmp_path / f"chain_{c}" / "mu_h_samples.npy").write_bytes(b"broken")
    df = npy.read_samples(spark, str(tmp_path), 2, ["sigma_h2", "G0"])
    assert df.columns == ["chain", "draw", "sigma_h2", "G0"] and df.count() == 46
    assert npy.read_samples(spark, f"file://{tmp_path}", 2, exclude=["h", "mu_h"]).count() == 46
    with pytest.raises(Exception, match="no .npy file"):
        npy.read_samples(spark, str(tmp_path), 2).count()


def test_missing_chains_and_files(tmp_path):
    put(tmp_path, [chain(0), {k: v for k, v in chain(1).items() if k != "Phi"}])
    with pytest.raises(FileNotFoundError, match=r"\[2\]"):
        npy.headers(str(tmp_path), 3)
    with pytest.raises(FileNotFoundError, match="Phi"):
        npy.headers(str(tmp_path), 2)
    # A file that chain 0 doesn't have isn't asked for.
    np.save(tmp_path / "chain_1" / "extra_samples.npy", np.zeros(23))
    assert set(npy.headers(str(tmp_path), 2, exclude=["mu_h", "Phi"])) == {"G0", "h", "sigma_h2"}


def test_lengths_and_shapes_must_agree(tmp_path):
    put(tmp_path, [chain(0), chain(1, n=22)])
    with pytest.raises(ValueError, match="length"):
        npy.headers(str(tmp_path), 2)
    np.save(tmp_path / "chain_1" / "h_samples.npy", np.zeros((4, 23)))
    with pytest.raises(ValueError, match="shape"):
        npy.headers(str(tmp_path), 2, ["h"])


def test_written_files_are_numpy_files(spark, tmp_path):
    r = np.random.default_rng(3)
    x, s = r.normal(size=(2, 9, 2, 3)), r.normal(size=(2, 9))
    rows = [(c, d, x[c, d].ravel().tolist(), float(s[c, d])) for c in range(2) for d in range(9)]
    draws = spark.createDataFrame(rows, "chain int, draw long, x array<double>, s double").repartition(4)
    said = npy.write_samples(draws, str(tmp_path), {"x": (2, 3), "s": ()}).collect()
    assert sorted((w.chain, w.quantity, w.draws) for w in said) == [(c, q, 9) for c in range(2) for q in "sx"]
    for c in range(2):
        np.testing.assert_array_equal(np.load(tmp_path / f"chain_{c}" / "x_samples.npy"), np.moveaxis(x[c], 0, -1))
        np.testing.assert_array_equal(np.load(tmp_path / f"chain_{c}" / "s_samples.npy"), s[c])
    back = npy.read_samples(spark, str(tmp_path), 2).select(*draws.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, draws.collect()))
    with pytest.raises(Exception, match="stands where"):
        npy.write_samples(draws.where("draw <> 4"), str(tmp_path / "b"), {"s": ()}).collect()


def made(spark):
    return lambda a, b: spark.range(a, b).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("chain"), F.col("id").alias("draw"), (F.col("id") * 2.0).alias("x"))


def test_interrupted_store_equals_a_whole_one(spark, tmp_path):
    make, whole, broken = made(spark), ChunkStore(spark, str(tmp_path / "a")), ChunkStore(spark, str(tmp_path / "b"))
    assert [c.stop for c in whole.run(make, 23, 5, 2)] == [5, 10, 15, 20, 23]
    assert [c.stop for c in broken.run(make, 23, 5, 2, until=8)] == [5, 10]
    # The third chunk was being written: its data stand, its entry doesn't.
    make(10, 13).write.parquet(str(tmp_path / "b" / "chunk-000002"))
    (tmp_path / "b" / "manifest" / "000002.json.open").write_text("{")
    assert broken.read().count() == 20
    resumed = ChunkStore(spark, str(tmp_path / "b"))
    assert resumed.run(make, 23, 5, 2) == whole.chunks()
    assert sorted(map(tuple, resumed.read().collect())) == sorted(map(tuple, whole.read().collect()))
    assert resumed.run(make, 23, 5, 2) == whole.chunks()  # nothing left to do


def test_chunks_that_are_not_whole_are_not_committed(spark, tmp_path):
    make, store = made(spark), ChunkStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.read()
    for bad in (make(0, 4), make(0, 5).where("chain = 0"), make(0, 5).unionByName(make(2, 3)), make(1, 6)):
        with pytest.raises(ValueError, match="chunk 0"):
            store.append(bad, 0, 5, 2)
    assert store.chunks() == []
    store.append(make(0, 5), 0, 5, 2)
    with pytest.raises(ValueError, match="starts at draw 5"):
        store.append(make(0, 5), 0, 5, 2)
