"""Fingerprints: edited texts, order, the block tables against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from voltweave.llm import fingerprints as fp


def test_compare(docs_of, odd_texts):
    r = random.Random(6)
    texts = odd_texts[:7] + odd_texts[9:] + [" ".join(f"t{r.randint(0, 400)}" for _ in range(r.randint(50, 200))) for _ in range(30)]
    texts += texts[-2:] + [texts[-3] + " more"]
    got = sorted(fp.compare(docs_of(texts, extra=True).repartition(4)).collect(), key=lambda x: x.doc_id)
    plain = [t or "" for t in texts]
    bits = [int(x.fingerprint, 16) for x in got]
    for k, (x, t) in enumerate(zip(got, plain)):
        after = plain[(k + 1) % len(plain)]
        q = len(t) // 4
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
        assert abs(x.near_next - (1 - bin(bits[k] ^ bits[(k + 1) % len(bits)]).count("1") / 64)) < 1e-12
        assert abs(x.near_edited - (1 - bin(bits[k] ^ int(x.edited_fingerprint, 16)).count("1") / 64)) < 1e-12
        assert x.n_near == sum(0 < bin(b ^ bits[k]).count("1") <= 3 for b in set(bits))
    for i, a in enumerate(plain):
        for j in range(i):
            assert a != plain[j] or bits[i] == bits[j]
    long = [x for x, t in zip(got, plain) if len(t) > 100 and t.startswith("t")]
    assert sum(x.near_edited for x in long) / len(long) > 0.7


def test_buckets_with_holes_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 2)
    monkeypatch.setattr(fp, "GROUP_BUCKETS", 3)
    ids = [-500, -3, 0, 1, 2, 50, 51, 10_000, 10_000, 99_999]
    rows = [(k, f"text {n} of many words") for n, k in enumerate(ids)]
    df = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").repartition(3)
    got = fp.compare(df).collect()
    want = ["no id", *[t for _, t in sorted(rows)]]
    expected = set()
    for k, t in enumerate(want):
        q = len(t) // 4
        expected.add(hashlib.sha256((t[: len(t) - q] + want[(k + 1) % len(want)][:q]).encode()).hexdigest())
    assert len(got) == 11 and {r.edited_sha256 for r in got} == expected
    assert fp.compare(df.limit(0)).collect() == []


def test_block_tables_find_every_pair(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = set(base) | {b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 4))) for b in base for _ in range(4)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {(a % (1 << 64), b % (1 << 64)) for a, b in fp.near_pairs(df, df).collect()}
    assert got == {(a, b) for a in fps for b in fps if 0 < bin(a ^ b).count("1") <= 3}
    plan = fp.compare(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan


def signed(values):
    return [(f - (1 << 64) if f >> 63 else f,) for f in values]


def test_near_counts_in_large_groups(spark):
    """Groups filed anew at every level count each neighbour once."""
    r = random.Random(9)
    base = r.getrandbits(64)
    dense = {base ^ sum(1 << k for k in r.sample(range(0, 64, 5), r.randint(0, 5))) for _ in range(500)}
    fps = dense | {r.getrandbits(64) for _ in range(100)} | {base ^ sum(1 << k for k in r.sample(range(64), 3)) for _ in range(300)}
    df = spark.createDataFrame(signed(fps), "fp long")
    known = {a: n for a in fps if (n := sum(0 < bin(a ^ b).count("1") <= 3 for b in fps))}
    for members in (2, 20, 512):
        got = {x.fp % (1 << 64): x.n_near for x in fp.near_counts(df, members=members).collect()}
        assert got == known, members


def test_near_counts_of_a_cluster(spark):
    """One cluster of 5000 different fingerprints."""
    r = random.Random(10)
    base, fps = r.getrandbits(64), set()
    while len(fps) < 5000:
        fps.add(base ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))))
    x = np.array(sorted(fps), np.uint64)
    known = [int((np.bitwise_count(v ^ x) <= 3).sum()) - 1 for v in x]
    df = spark.createDataFrame(signed(fps), "fp long")
    got = {y.fp % (1 << 64): y.n_near for y in fp.near_counts(df).collect()}
    assert got == {int(v): n for v, n in zip(x, known) if n}


def test_parts_cut_all_bits():
    for radius in (1, 2, 3, 5):
        for masks in fp.parts(radius):
            assert len(masks) == radius + 1 and sum(masks) == (1 << 64) - 1
